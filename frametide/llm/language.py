"""Language identification by cross-parsing against suffix automata.

Per language, a bounded sample of labelled text becomes a suffix automaton over
all of its letters. A text is parsed against it greedily: each phrase is the
longest match that the automaton can follow, or one letter that it doesn't know;
where it can't go on, the phrase ends and the next begins. Few phrases mean low
cross-entropy. Phrases times log2(sample length) over the text's length is
comparable between languages; the least wins, ties go to the name that sorts first.

Parsing is vectorised over lanes of LANE letters: all lanes of a block take a
step through all automata at a time, as if each began a phrase. Then each lane is
parsed again from the state in which the one before it really ended, until both
parses are in the same state, as they are after a few letters; so phrases go
across lanes, and the result is that of a parse from begin to end. Whole texts are parsed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept_between_tasks, mapped

#: Bounds of the sample that is fitted on: documents a language, letters and spaces a language, and in all, that automata are built
#: of, letters of one document; and characters a language that are looked at for the automaton and the limits.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_CHARS_ALL, SAMPLE_DOC_CHARS, SAMPLE_RAW_CHARS = 200, 40_000, 400_000, 8_000, 160_000
#: So many letters of each language have columns in the dense table; the others are looked up. Results don't depend on it.
DENSE = 64
LANE = 256
BLOCK_CHARS = 1 << 20
#: Letters times languages that are parsed at a time.
BLOCK_CELLS = 1 << 22
UNKNOWN = "und"
#: A text with more normalised phrases a character than its language's limit for its length is in no learned language. The
#: limit is REJECT_RATE, or REJECT_MARGIN times what all but 1 % of pieces of the language's own texts of that length have, where that is more.
REJECT_RATE, REJECT_MARGIN = 4.5, 1.5
#: Lengths of the pieces; limits in between are interpolated.
REJECT_LENGTHS = (1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024)
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, phrases_per_char double"


def sample(documents: DataFrame, docs: int = SAMPLE_DOCS) -> DataFrame:
    """(lang, text) of labelled documents that aren't held out, at most docs a language, chosen by a hash of the id.

    Of a long text the first letters are taken, so that a language of long texts alone is learned
    too. Of a language come no more texts than it takes for SAMPLE_RAW_CHARS characters.
    """
    usable = documents.where("lang is not null and doc_id is not null and crc32(cast(doc_id as string)) % 3 <> 1").where(F.col("text").rlike(r"\p{L}"))
    letters = F.when(F.length("text") <= SAMPLE_DOC_CHARS, F.col("text")).otherwise(F.left(F.regexp_replace("text", r"\P{L}+", " "), F.lit(SAMPLE_DOC_CHARS)))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "_h")
    dealt = usable.select("lang", "doc_id", letters.alias("text"), F.xxhash64("text").alias("_h")).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= docs)
    before = F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("_before", before).where(F.col("_before") < SAMPLE_RAW_CHARS).select("lang", "text", "_n")


def normal(text: str) -> str:
    """Lower case; runs of anything but letters become one space."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def automaton(codes: list[int]) -> list[dict[int, int]]:
    """The suffix automaton of codes: the transitions of each state; 0 is the root."""
    link, length, go = [-1], [0], [{}]
    last = 0
    for c in codes:
        now = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = now
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                twin = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
                link[q] = link[now] = twin
        last = now
    return go


@cache
def _alphabetic() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


class Model:
    """Automata of all languages, and the map from code points to symbols.

    A state is a number over all automata. Transitions are 2 * the next state, plus
    1 where a phrase ends first. Of a state with one way on, the symbol and the
    transition are kept; states with several have a row in a dense table: the
    space, the language's DENSE most frequent letters, and one column for letters that
    it doesn't have; transitions by its other letters are looked up by sorted keys.
    What a state can't follow ends the phrase and starts the next one from the root;
    after a letter that the root doesn't know either comes the dead state, where
    each letter starts a phrase. Row 0 of a language's table is the dead state's.
    """

    def __init__(self, texts: dict[str, str], dense: int = DENSE):
        self.langs = sorted(texts)
        letters = np.unique(np.frombuffer("".join(texts.values()).replace(" ", "").encode("utf-32-le"), np.uint32))
        self.unknown = len(letters) + 1
        self.symbol = np.where(_alphabetic(), self.unknown, 0).astype(np.min_scalar_type(self.unknown))
        self.symbol[letters] = np.arange(1, len(letters) + 1)
        # column of each symbol in each language's rows; -1: looked up by key
        self.column = np.zeros((len(self.langs), self.unknown + 1), np.int32)
        self.from_root = np.zeros(self.column.shape, np.int32)
        tables, keys, values, rows, only, way, at, base = [], [], [], [], [], [], 0, 0
        self.roots, self.bits = np.zeros(len(self.langs), np.int32), np.ones(len(self.langs))
        for k, lang in enumerate(self.langs):
            codes = self.symbols(texts[lang])
            count = np.bincount(codes, minlength=self.unknown + 1)
            count[0] = 0
            own = np.argsort(-count, kind="stable")[: np.count_nonzero(count)]
            column = self.column[k]
            column[:] = min(dense, len(own)) + 1
            column[own] = -1
            column[own[:dense]] = np.arange(1, min(dense, len(own)) + 1)
            column[0] = 0
            width = min(dense, len(own)) + 2
            go = automaton(codes.tolist())
            dead = base + len(go)
            self.from_root[k] = 2 * dead + 1
            for c, to in go[0].items():
                self.from_root[k, c] = 2 * (base + to) + 1
            miss = np.full(width, 2 * dead + 1, np.int32)
            has = column >= 0
            miss[column[has]] = self.from_root[k][has]
            made = [miss]
            row, one, on = np.full(len(go) + 1, at, np.int32), np.full(len(go) + 1, -1, np.int32), np.zeros(len(go) + 1, np.int32)
            for state, edges in enumerate(go):
                if len(edges) == 1 and state:
                    ((c, to),) = edges.items()
                    one[state], on[state] = c, 2 * (base + to)
                elif edges or not state:
                    row[state] = at + len(made) * width
                    x = miss.copy() if state else np.where(miss == 2 * dead + 1, 2 * dead, miss).astype(np.int32)
                    for c, to in edges.items():
                        if column[c] >= 0:
                            x[column[c]] = 2 * (base + to)
                        else:
                            keys.append((base + state) * (self.unknown + 1) + c)
                            values.append(2 * (base + to))
                    made.append(x)
                go[state] = None
            tables.append(np.concatenate(made)), rows.append(row), only.append(one), way.append(on)
            self.roots[k], self.bits[k] = base, np.log2(max(2, len(codes)))
            at, base = at + len(made) * width, dead + 1
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int32)
        self.table, self.row, self.only, self.way = join(tables), join(rows), join(only), join(way)
        self.sparse = bool((self.column < 0).any())
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.values = np.array(keys, np.int64)[order], np.array(values, np.int32)[order]

    def _move(self, lang: np.ndarray, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Transitions of states of languages by symbols, all of one length."""
        column = self.column.ravel()[lang * self.column.shape[1] + symbol]
        moved = self.table[self.row[state] + (np.maximum(column, 0) if self.sparse else column)]
        one = self.only[state]
        if not self.sparse:
            return np.where(one == symbol, self.way[state], moved)
        if len(self.keys):
            at = np.flatnonzero((column < 0) & (one < 0))
            key = state[at] * np.int64(self.unknown + 1) + symbol[at]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            moved[at] = np.where(self.keys[place] == key, self.values[place], self.from_root[lang[at], symbol[at]])
        other = np.flatnonzero((column < 0) & (one >= 0))
        moved[other] = self.from_root[lang[other], symbol[other]]
        return np.where(one == symbol, self.way[state], moved)

    def symbols(self, text: str) -> np.ndarray:
        got = self.symbol[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        keep = got != 0
        keep[1:] |= got[:-1] != 0  # one of a run of spaces
        return got[keep]

    def phrases(self, texts: list[np.ndarray], lane: int = LANE, cells: int = BLOCK_CELLS) -> np.ndarray:
        """Phrases of each text against each language: (texts, languages). At most about cells states are held at a time."""
        sizes = np.array([len(x) for x in texts], np.int64)
        n = len(self.langs)
        out = np.where(sizes[:, None] > 0, 1.0, 0.0) * np.ones((1, n))
        if not sizes.sum() or not n:
            return out
        lanes = -(-sizes // lane)
        owner = np.repeat(np.arange(len(texts)), lanes)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        many = max(1, cells // (lane * n))
        carried = self.roots
        for lo in range(0, len(owner), many):
            who, which = owner[lo : lo + many], nth[lo : lo + many]
            parts = [texts[i][j * lane : (j + 1) * lane] for i, j in zip(who.tolist(), which.tolist(), strict=True)]
            ends, carried = self._block(parts, which == 0, carried)
            for k in range(n):
                out[:, k] += np.bincount(who, ends[k], len(texts))
        return out

    def _block(self, parts: list[np.ndarray], first: np.ndarray, carried: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ended phrases of each lane, (languages, lanes), and the last lane's states; carried are the states before the first lane."""
        n, m = len(self.langs), len(parts)
        length = np.array([len(x) for x in parts])
        flat, start = np.concatenate(parts).astype(np.int32), np.cumsum(length) - length
        order = np.argsort(-length, kind="stable")
        lang = np.arange(n)
        path = np.zeros((int(length.max()), n, m), np.int32)
        state = np.repeat(self.roots[:, None], m, 1)
        if not first[0]:
            state[:, 0] = carried
        state = state[:, order]
        for t in range(len(path)):
            active = int(np.searchsorted(-length[order], -t, side="left"))
            lanes = order[:active]
            moved = self._move(np.repeat(lang, active), state[:, :active].ravel(), np.tile(flat[start[lanes] + t], n)).reshape(n, active)
            path[t][:, lanes] = moved
            state[:, :active] = moved >> 1
        final = np.empty((n, m), np.int32)
        final[:, order] = state
        # from where the lane before really ended, until the path is met again
        k, x = np.nonzero(np.repeat(~first[None], n, 0))
        k, x = (v[x > 0] for v in (k, x))
        entry = final[k, x - 1]
        while len(k):
            late_k, late_x = [], []
            t, now = 0, entry
            while len(k):
                over = length[x] <= t
                if over.any():  # not met within the lane: the next one begins elsewhere, too
                    final[k[over], x[over]] = now[over]
                    late_k.append(k[over]), late_x.append(x[over])
                    k, x, now = k[~over], x[~over], now[~over]
                    continue
                moved = self._move(k, now, flat[start[x] + t])
                apart = moved != path[t, k, x]
                k, x, moved = k[apart], x[apart], moved[apart]
                path[t, k, x] = moved
                now, t = moved >> 1, t + 1
            k, x = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (late_k, late_x))
            on = np.flatnonzero(x + 1 < m)
            on = on[~first[x[on] + 1]]
            entry, k, x = final[k[on], x[on]], k[on], x[on] + 1
        ends = np.zeros((n, m), np.int32)
        for t, moved in enumerate(path):
            ends += (moved & 1) * (length > t)
        return ends, final[:, -1]


_models: dict[int, Model] = {}
kept_between_tasks("language", _models.clear)


def model_of(texts: dict[str, str]) -> Model:
    """Built once a worker."""
    key = hash(tuple(sorted(texts.items())))
    if key not in _models:
        _models.clear()
        _models[key] = Model(texts)
    return _models[key]


def learned(documents: DataFrame) -> dict[str, list[str]]:
    """The sample's normal texts of each language, in order."""
    by: dict[str, list] = {}
    for row in sample(documents).collect():
        by.setdefault(row["lang"], []).append((row["_n"], normal(row["text"])))
    return {k: [x for _, x in sorted(v) if x] for k, v in by.items() if any(x for _, x in v)}


def _cut(by: dict[str, list[str]]) -> dict[str, str]:
    most = min(SAMPLE_CHARS, SAMPLE_CHARS_ALL // max(1, len(by)))
    return {k: " ".join(v)[:most] for k, v in by.items()}


def fit(documents: DataFrame) -> dict[str, str]:
    """The sample's text of each language, cut to at most the same number of letters."""
    return _cut(learned(documents))


def limits(by: dict[str, list[str]], least: float = REJECT_RATE) -> dict[str, list[float]]:
    """By language, the rates of REJECT_LENGTHS from which a text is not in the nearest language; at least least.

    From the language's own texts that its automaton has not seen, in pieces of
    each length. Where the sample has few such texts, the last third of it is held
    against the rest. Where there are too few letters for a piece, there is no limit: nothing is
    turned away without knowing.
    """
    out = {}
    for lang, text in _cut(by).items():
        unseen = " ".join(by[lang])[len(text) :]
        if len(unseen) < 5 * REJECT_LENGTHS[-1]:
            whole = text + unseen
            text, unseen = whole[: len(whole) * 2 // 3], whole[len(whole) * 2 // 3 :]
        model, out[lang] = Model({lang: text}), []
        unseen = model.symbols(unseen[:SAMPLE_CHARS])
        for n in REJECT_LENGTHS:
            pieces = [unseen[i : i + n] for i in range(0, len(unseen) - n + 1, max(n, len(unseen) // 200))]
            rates = verdicts(model, [x for x in pieces if x.any()])[2]
            out[lang].append(max(least, REJECT_MARGIN * float(np.quantile(rates, 0.99))) if rates else float("inf"))
    return out


def limit_at(own: list[float], letters: int) -> float:
    """The limit for a text of so many letters."""
    if not np.isfinite(own).all():
        own = [x if np.isfinite(x) else np.inf for x in own]
        return own[int(np.searchsorted(REJECT_LENGTHS, max(1, letters), side="left").clip(0, len(own) - 1))]
    return float(np.interp(np.log2(max(1, letters)), np.log2(REJECT_LENGTHS), own))


def verdicts(model: Model, symbols: list[np.ndarray]) -> tuple[list[str], list[float], list[float]]:
    """Language, score and normalised phrases of each text."""
    counts = model.phrases(symbols)
    size = np.array([max(1, len(x)) for x in symbols])
    rates = counts * model.bits / size[:, None] if model.langs else counts
    langs, scores, best_rates = [], [], []
    for r, x in zip(rates, symbols, strict=True):
        if not model.langs or not x.any():
            langs.append(UNKNOWN), scores.append(0.0), best_rates.append(0.0)
            continue
        best = int(np.argmin(r))
        rest = np.delete(r, best)
        langs.append(model.langs[best])
        scores.append(float(1 - r[best] / rest.min()) if len(rest) else 1.0)
        best_rates.append(float(r[best]))
    return langs, scores, best_rates


def _judged(model: Model, texts: list, most: int = BLOCK_CHARS) -> Iterator[tuple[list[str], list[float], list[float], list[int]]]:
    """Verdicts and sizes of texts in order, a bounded number of letters at a time."""
    symbols, total = [], 0
    for i, text in enumerate(texts):
        symbols.append(model.symbols(text or ""))
        total += len(symbols[-1])
        if total >= most or i + 1 == len(texts):
            yield *verdicts(model, symbols), [len(x) for x in symbols]
            symbols, total = [], 0


def keep_identified(documents: DataFrame, texts: dict[str, str] | None = None, limit: dict[str, list[float]] | None = None) -> DataFrame:
    """The rows of documents whose language is known, with all their columns.

    und goes; so does a text that even the nearest language parses into more
    normalised phrases a character than its limit for that length: it is in none of
    the learned languages. limit is by language, see limits; a language without
    one turns nothing away. Both texts and limit are learned from documents where texts aren't given.
    """
    if texts is None:
        by = learned(documents)
        texts, limit = _cut(by), limits(by) if limit is None else limit
    limit = limit or {}
    at = documents.columns.index("text")
    inf = [float("inf")] * len(REJECT_LENGTHS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(texts)
        for batch in batches:
            lo = 0
            for langs, _, rates, sizes in _judged(model, batch.column(at).to_pylist()):
                keep = [lang != UNKNOWN and r <= limit_at(limit.get(lang, inf), n) for lang, r, n in zip(langs, rates, sizes, strict=True)]
                yield batch.slice(lo, len(keep)).filter(pa.array(keep, pa.bool_()))
                lo += len(keep)

    return documents.transform(mapped, run, documents.schema, "language")


def classify(documents: DataFrame, texts: dict[str, str] | None = None) -> DataFrame:
    """One row per row of documents: doc_id, held_out, lang_pred, score, phrases_per_char.

    und with score 0 where the text is null or has no letter, or where no
    language was learned. score is 1 less the ratio of the best to the second
    normalised phrase count. A null doc_id isn't held out and is never learned from.
    """
    texts = fit(documents) if texts is None else texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(texts)

        for batch in batches:
            lo = 0
            for langs, scores, rates, sizes in _judged(model, batch.column(2).to_pylist()):
                part = batch.slice(lo, len(sizes))
                lo += len(sizes)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score", "phrases_per_char"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.expr("coalesce(crc32(cast(doc_id as string)) % 3 = 1, false)").alias("held_out"), "text")
    return rows.transform(mapped, run, SCHEMA, "language")
