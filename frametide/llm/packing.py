"""Hierarchical multi-length packing of token streams.

Each task packs the documents of its own partition, so nothing is shuffled and no
source or group can overload a task. Documents are tokenised once. Whole long
windows are cut off first; what is left of a document is routed to the tier (a
power of two) that just holds it. Tiers are packed from the longest to the
shortest: a document opens a window of its tier, gaps are filled with the largest
documents of shorter tiers that fit (best fit), and a last gap by a cut. What
is left at the end of a partition is split over tiers, pieces too short to open
a window of their own too, so that at most one sequence of a partition, below
the shortest tier, needs padding. A full buffer is packed the same way until half
is left, so that a partition of short documents alone does not pile up.

Step groups: sequences of a tier are dealt in groups of the same number of
tokens, so that each training step has one shape and as much work as any other.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import kept_between_tasks, mapped

TIERS = (64, 128, 256, 512, 1024, 2048)
END = 1
STEP_TOKENS = 1 << 16
BUFFER_TOKENS = 1 << 20
BUFFER_PIECES = 1 << 16
CACHE_ENTRIES = 300_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
_SPECIAL = "<|endoftext|>"
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Texts of these characters are split here, by the same rule as the tokenizer's; others by the tokenizer itself.
_PLAIN = re.compile(rf"[\t\n\r\x20-\x7e{_LETTER}]*")
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\s{_LETTER}0-9]+|\s+(?!\S)|\s+")


class Encoder(dict):
    """Ids of a text as little-endian 32-bit bytes; pieces between merges are remembered."""

    def __init__(self, name: str):
        import public_tokenizers
        import tiktoken

        super().__init__()
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self._codec = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={_SPECIAL: len(ranks)})

    def _encode(self, text: str) -> bytes:
        return np.asarray(self._codec.encode(text, allowed_special="all"), "<u4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        ids = self._encode(piece)
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def ids(self, text: str) -> np.ndarray:
        """The ids that the JSON form of the vocabulary gives, without special tokens added, then END."""
        if _PLAIN.fullmatch(text) and _SPECIAL not in text:
            raw = b"".join(map(self.__getitem__, _SPLIT.findall(text)))
        else:
            raw = self._encode(text)
        return np.frombuffer(raw + END.to_bytes(4, "little"), "<u4")


_encoders: dict[str, Encoder] = {}
kept_between_tasks("packing", _encoders.clear)


def encoder(name: str = "byte_bpe_50k") -> Encoder:
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]


class Packer:
    """Takes documents' ids; gives finished pieces."""

    def __init__(self, base: int, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, buffer_tokens: int = BUFFER_TOKENS):
        self.tiers, self.step_tokens, self.base, self.buffer_tokens = tiers, step_tokens, base, buffer_tokens
        self.longest = tiers[-1]
        self.n_sequences, self.per_tier = 0, dict.fromkeys(tiers, 0)
        self.docs: dict[int, tuple[object, np.ndarray, int, int]] = {}  # id, the ids that wait, ids before those, ids in all
        self.left: dict[int, int] = {}  # pieces of each document that are still to be placed
        self.waiting: list[tuple[int, int, int]] = []  # (length, document, start), by length
        self.tokens, self.n_docs = 0, 0
        self.out: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        key, self.n_docs = self.n_docs, self.n_docs + 1
        self.docs[key], self.left[key] = (doc_id, ids, 0, len(ids)), 0
        whole = len(ids) // self.longest * self.longest
        for start in range(0, whole, self.longest):
            self._emit([(self.longest, key, start)])
        if whole < len(ids):
            self.docs[key] = doc_id, ids[whole:].copy(), whole, len(ids)  # a long document's ids aren't held for its tail
            self._wait(len(ids) - whole, key, whole)
        else:
            del self.docs[key], self.left[key]

    def _wait(self, length: int, key: int, start: int) -> None:
        insort(self.waiting, (length, key, start))
        self.left[key] += 1
        self.tokens += length

    def _take(self, most: int) -> tuple[int, int, int] | None:
        """The longest piece of at most so many tokens."""
        at = bisect_right(self.waiting, (most, 1 << 62, 0)) - 1
        return self._pop(at) if at >= 0 else None

    def _pop(self, at: int) -> tuple[int, int, int]:
        piece = self.waiting.pop(at)
        self.left[piece[1]] -= 1
        self.tokens -= piece[0]
        return piece

    def _emit(self, pieces: list[tuple[int, int, int]]) -> None:
        total = sum(p[0] for p in pieces)
        tier = next(t for t in self.tiers if t >= total)
        group = self.per_tier[tier] // max(1, self.step_tokens // tier)
        self.per_tier[tier] += 1
        sequence, offset = self.base + self.n_sequences, 0
        self.n_sequences += 1
        step = self.base + (self.tiers.index(tier) << 26) + group
        for length, key, start in pieces:
            doc_id, ids, before, n_ids = self.docs[key]
            self.out.append((doc_id, start, length, zlib.crc32(ids[start - before : start - before + length].tobytes()), n_ids, sequence, offset, tier, step))
            offset += length

    def _release(self) -> None:
        for key in [k for k in self.docs if not self.left[k]]:
            del self.docs[key], self.left[key]

    def full(self, share: int = 1) -> bool:
        """Whether what waits fills the buffer, or the given part of it."""
        return self.tokens * share >= self.buffer_tokens or len(self.waiting) * share >= BUFFER_PIECES

    def _fill(self, tier: int) -> None:
        pieces, gap = [], tier
        while gap:
            piece = self._take(gap)
            if piece is None:  # each one is too long: cut what the gap takes off the shortest
                length, key, start = self._pop(0)
                piece = (gap, key, start)
                self._wait(length - gap, key, start + gap)
            pieces.append(piece)
            gap -= piece[0]
        self._emit(pieces)

    def pack(self, last: bool = False) -> None:
        """Pack what waits; without last, up to half a buffer may go on waiting for what comes."""
        for tier in reversed(self.tiers):
            while self.tokens >= tier and self.waiting[-1][0] > tier // 2 and (last or tier == self.longest or self.full(2)):
                self._fill(tier)
        for tier in reversed(self.tiers):  # pieces that open no window
            while self.tokens >= tier and (last or self.full(2)):
                self._fill(tier)
        if last and self.waiting:  # less than the shortest tier
            self._emit([self._pop(0) for _ in range(len(self.waiting))])
        self._release()

    def take(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def pack(documents: DataFrame, *, vocabulary: str = "byte_bpe_50k", tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, buffer_tokens: int = BUFFER_TOKENS) -> DataFrame:
    """One row per piece of a document: where its ids are, and in which sequence.

    Null and empty texts are one id (the end); texts of any length are cut into
    whole windows; repeated rows and rows without a doc_id are packed each; an empty table gives no rows.
    Only doc_id and text are looked at. A sequence's id holds its partition's
    number, so a task that runs again gives the same rows.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer = encoder(vocabulary), Packer(TaskContext.get().partitionId() << 32, tiers, step_tokens, buffer_tokens)

        def done() -> Iterator[pa.RecordBatch]:
            if rows := packer.take():
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                packer.add(doc_id, coder.ids(text or ""))
                if packer.full():
                    packer.pack()
                    yield from done()
                elif len(packer.out) >= 10_000:
                    yield from done()
        packer.pack(last=True)
        yield from done()

    return documents.selectExpr("cast(doc_id as long) doc_id", "text").transform(mapped, run, SCHEMA, "packing")
