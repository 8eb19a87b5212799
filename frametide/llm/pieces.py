"""Encoding and decoding with a SentencePiece model of merge type (BPE with byte fallback).

Merging always joins the best-scored adjacent pair, the leftmost of equals.  Two
facts follow.  What merging makes of a text, cut anywhere between two of its
tokens, is what merging makes of the two sides; so each prefix of a text has one
last token, and a prefix table of these holds the encodings of all prefixes.  And
a row of tokens is an encoding if each token by itself is and each two neighbours
are compatible: merging them side by side never joins across their border.

The table is filled from left to right.  An automaton of all pieces gives those
that end at a place; the one that may follow the last token of the prefix before
it is the entry.  Ids are then read backwards from the end.

Compatibility is judged from each token's trace: the scores of the merges that
build it, in order, with the symbol that stands at its left and at its right edge
before each.  Walking two traces in the order of their scores shows every moment
at which the two edge symbols could have been joined.

Pieces never hold a space mark behind another character, so a text falls into
segments at such places; segments that were seen before are looked up.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType

from .common import kept_between_tasks, mapped, unused

MODEL = "piece_bpe_32k.model"
MARK = "▁"  # stands for a space
CACHE_ENTRIES = 300_000
CACHE_CHARS = 32
PAIR_ENTRIES = 1_000_000
_NEVER = float("inf")
#: Kinds of pieces in a model file (fixed values of the format).
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


def _splitter(pieces: list[str]) -> re.Pattern:
    """Cuts where no piece reaches across: before space marks, and around characters that are in no piece of several."""
    joined = [p for p in pieces if len(p) > 1]
    alone = "".join(re.escape(chr(c)) for c in range(128) if not any(chr(c) in p for p in joined))
    single = f"[{alone}]|" if alone else ""
    if any(MARK in p.lstrip(MARK) for p in joined):
        return re.compile(f"{single}[^{alone}]+" if alone else "(?s:.+)")
    return re.compile(f"{single}{MARK}*[^{MARK}{alone}]+|{MARK}+")


class _Segments(dict):
    """Ids of segments; short ones are remembered, those not used for long are let go."""

    def __init__(self, ids_of: Callable[[str], bytes]):
        super().__init__()
        self._ids_of, self._older = ids_of, {}

    def __missing__(self, segment: str) -> bytes:
        ids = self._older.get(segment)
        if ids is None:
            ids = self._ids_of(segment)
        if len(segment) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self._older = dict(self)
                self.clear()
            self[segment] = ids
        return ids


class Codec:
    """Ids of texts and texts of ids, equal to those of the sentencepiece library for the same model."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        kinds = {p.type for p in model.pieces}
        plain = not model.normalizer_spec.precompiled_charsmap and not model.normalizer_spec.remove_extra_whitespaces and model.normalizer_spec.escape_whitespaces
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or not plain or kinds - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
            raise ValueError(f"{path}: only models of merge type with byte fallback, without normalisation and without pieces of the user's are read")
        self._prefix = MARK if model.normalizer_spec.add_dummy_prefix else ""
        pieces = {p.piece: i for i, p in enumerate(model.pieces) if p.type == _NORMAL}
        order = {s: r for r, s in enumerate(sorted({p.score for p in model.pieces if p.type == _NORMAL}, reverse=True))}
        self._rank = {p.piece: order[p.score] for p in model.pieces if p.type == _NORMAL}
        self._byte = np.zeros(256, "<u4")
        self._surface: list[bytes] = []
        self._kind = np.array([p.type for p in model.pieces])
        for i, p in enumerate(model.pieces):
            if p.type == _BYTE:
                self._byte[int(p.piece[1:-1], 16)] = i
                self._surface.append(bytes([int(p.piece[1:-1], 16)]))
            else:
                self._surface.append({_CONTROL: "", _UNKNOWN: model.trainer_spec.unk_surface}.get(p.type, p.piece.replace(MARK, " ")).encode())
        named = {p.piece: i for i, p in enumerate(model.pieces)}
        self.begin, self.end = named[model.trainer_spec.bos_piece], named[model.trainer_spec.eos_piece]
        self._names = [p.piece for p in model.pieces]
        self._sizes = [len(p) for p in self._names]
        self._automaton = ahocorasick.Automaton()
        for piece, i in pieces.items():
            self._automaton.add_word(piece, i)
        self._automaton.make_automaton()
        self._traces: dict[int, list[tuple[float, str, str]] | None] = {}
        self._pairs: dict[int, bool] = {}
        self._segments = _Segments(self._ids_of)
        self._split = _splitter(list(pieces))

    def _name(self, token: int) -> str:
        """Tokens are numbered by their ids, and characters of no piece after those."""
        return self._names[token] if token < len(self._names) else chr(token - len(self._names))

    def _trace(self, token: int) -> list[tuple[float, str, str]] | None:
        """(rank of the next merge, left edge, right edge) before each merge of token and at its end; None if merging doesn't give token back."""
        parts, steps = list(self._name(token)), []
        while len(parts) > 1:
            rank, at = min((self._rank.get(a + b, _NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == _NEVER:
                return None
            steps.append((rank, parts[0], parts[-1]))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [*steps, (_NEVER, parts[0], parts[0])]

    def _traced(self, token: int) -> list[tuple[float, str, str]] | None:
        if token >= len(self._names):
            return self._trace(token)
        if token not in self._traces:  # as many as there are pieces
            self._traces[token] = self._trace(token)
        return self._traces[token]

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging the two tokens side by side leaves their border, and the right one, as they are."""
        before, after = self._traced(left), self._traced(right)
        if after is None:
            return False
        i = j = 0
        while True:
            (soon, _, u), (later, v, _) = before[i], after[j]
            rank = self._rank.get(u + v)
            if rank is not None and rank < soon and rank <= later:  # of equal ranks the leftmost goes first
                return False
            if soon == later == _NEVER:
                return True
            if soon <= later:
                i += 1
            else:
                j += 1

    def tokens(self, segment: str) -> list[int]:
        """The tokens of a text in which spaces are marks; a character of no piece stands alone."""
        none, pairs, others = -1, self._pairs, len(self._names)
        last, sizes = [none] * (len(segment) + 1), self._sizes
        for end, token in self._automaton.iter(segment):
            if last[end + 1] != none:
                continue
            before = end + 1 - sizes[token]
            if not before:
                fits = self._traced(token) is not None
            else:
                left = last[before]
                if left == none:
                    left = last[before] = others + ord(segment[before - 1])
                pair = left << 24 | token
                fits = pairs.get(pair)
                if fits is None:
                    if len(pairs) >= PAIR_ENTRIES:
                        pairs.clear()
                    fits = pairs[pair] = self._compatible(left, token)
            if fits:
                last[end + 1] = token
        out, at = [], len(segment)
        while at:
            token = last[at]
            if token == none:
                token = others + ord(segment[at - 1])
            out.append(token)
            at -= sizes[token] if token < others else 1
        return out[::-1]

    def _ids_of(self, segment: str) -> bytes:
        out, known = [], len(self._names)
        for token in self.tokens(segment):
            out += [token] if token < known else self._byte[np.frombuffer(chr(token - known).encode(), np.uint8)].tolist()
        return np.array(out, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids with begin and end, as little-endian unsigned 32-bit integers."""
        segments = self._split.findall((self._prefix + text).replace(" ", MARK)) if text else ()
        return b"".join([self.begin.to_bytes(4, "little"), *map(self._segments.__getitem__, segments), self.end.to_bytes(4, "little")])

    def decode(self, ids: np.ndarray) -> str:
        """The text of any ids: begin, end and other control pieces are nothing, and the space before the first text goes."""
        raw = b"".join(map(self._surface.__getitem__, ids.tolist()))
        texts = self._kind[ids] != _BYTE
        if self._prefix and raw[:1] == b" ":
            first = next(i for i in ids.tolist() if self._surface[i])
            raw = raw[1:] if self._kind[first] == _NORMAL else raw
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return self._decode_runs(ids, texts)

    def _decode_runs(self, ids: np.ndarray, texts: np.ndarray) -> str:
        """As decode, where bytes don't form characters: each byte that belongs to none becomes U+FFFD, run by run."""
        out, bytes_, begun = [], bytearray(), False

        def flush() -> None:
            rest = bytes(bytes_)
            while rest:
                n = next((n for n in range(1, 5) if _is_character(rest[:n])), 0)
                out.append(rest[:n].decode() if n else "�")
                rest = rest[n or 1 :]
            bytes_.clear()

        for i, is_text in zip(ids.tolist(), texts.tolist(), strict=True):
            if not is_text:
                bytes_ += self._surface[i]
                begun = True
                continue
            flush()
            piece = self._surface[i].decode()
            if self._prefix and not begun and self._kind[i] == _NORMAL and piece[:1] == " ":
                piece = piece[1:]
                begun = True
            begun = begun or bool(piece)
            out.append(piece)
        flush()
        return "".join(out)


def _is_character(raw: bytes) -> bool:
    try:
        return len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


_codecs: dict[str, Codec] = {}
kept_between_tasks("pieces", _codecs.clear)


def codec(model: str = MODEL) -> Codec:
    """model is a path, or the name of one of the public tokenizers' files."""
    if model not in _codecs:
        import public_tokenizers

        _codecs[model] = Codec(model if "/" in model else public_tokenizers.path(model))
    return _codecs[model]


def encode(rows: DataFrame, text: str = "text", *, model: str = MODEL, ids: str = "ids") -> DataFrame:
    """rows with a column ids array<int>, begin and end included; a null text counts as empty: two ids.

    Every row is encoded by itself, whole; repeated rows stay, an empty table gives
    none. A column of the name ids is replaced.
    """
    (key,) = unused(rows.columns, "text_of_ids")
    names = [c for c in rows.columns if c.lower() != ids.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(model)
        for batch in batches:
            found = [coder.encode(x or "") for x in batch.column(batch.num_columns - 1).to_pylist()]
            ends = np.cumsum([0] + [len(x) // 4 for x in found])
            values = pa.array(np.frombuffer(b"".join(found), "<u4").astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], names=[*batch.schema.names[:-1], ids])

    kept = rows.select(*[rows[c] for c in names], rows[text].alias(key))
    schema = kept.drop(key).schema.add(ids, ArrayType(IntegerType()))
    return mapped(kept, run, schema, "pieces")


def decode(rows: DataFrame, ids: str = "ids", *, model: str = MODEL, text: str = "decoded") -> DataFrame:
    """rows with a column of the texts of ids; null ids give a null text, no ids an empty one."""
    (key,) = unused(rows.columns, "ids_of_text")
    names = [c for c in rows.columns if c.lower() != text.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(model)
        for batch in batches:
            found = [None if x is None else coder.decode(np.array(x, np.int64)) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string())], names=[*batch.schema.names[:-1], text])

    kept = rows.select(*[rows[c] for c in names], rows[ids].alias(key))
    return mapped(kept, run, kept.drop(key).schema.add(text, "string"), "pieces")


def digests(documents: DataFrame, *, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, and digests of a document's ids and of the text that they decode to.

    A null text counts as empty; repeated rows and rows without a doc_id are encoded
    each. Only doc_id and text are looked at; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(model)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in batch.column(1):
                raw = coder.encode(text.as_py() or "")
                n.append(len(raw) // 4)
                ids_sha.append(hashlib.sha256(raw).hexdigest())
                text_sha.append(hashlib.sha256(coder.decode(np.frombuffer(raw, "<u4")).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.selectExpr("cast(doc_id as long) doc_id", "text").transform(mapped, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", "pieces")
