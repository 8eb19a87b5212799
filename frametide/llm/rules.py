"""Quality rules by distribution divergence.

References come from all labelled rows: per language, the counts of character
classes and of the language's COMMON most frequent words (all others together
are one more class). A document's two histograms are held against each
language's with the Jensen-Shannon distance (base 2, so 0 to 1); the language
with the least sum of both counts. A document is kept unless a base rule fails or
a distance is above its limit; distances of documents shorter than the guards
aren't judged, since few characters or words diverge by chance.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, gram_hashes, mapped, materialize

COMMON = 50
# Limits of the distances, least characters and words for them, base limits.
CHAR_LIMIT, WORD_LIMIT = 0.3, 0.45
LEAST_CHARS, LEAST_WORDS = 200, 100
BASE_WORDS, REPEAT_PERCENT = 50, 50
SYMBOLS = b"#*$%&|<>"
CLASSES = ["lower", "upper", "digit", "space", "newline", "sentence", "symbol", "punctuation", "beyond_ascii", "control"]
FLUSH = 200_000
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "nearest string, char_distance double, word_distance double"
)


def _class_table() -> np.ndarray:
    """Class of each byte of UTF-8; len(CLASSES) for a continuation byte."""
    out = np.full(256, CLASSES.index("punctuation"), np.uint8)
    out[:32] = CLASSES.index("control")
    out[127] = CLASSES.index("control")
    for name, chars in (("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)), ("space", b" \t\r"), ("newline", b"\n"), ("sentence", b".,!?;:'\"-"), ("symbol", SYMBOLS), ("beyond_ascii", range(192, 256))):
        out[list(chars)] = CLASSES.index(name)
    out[128:192] = len(CLASSES)
    return out


_CLASS = _class_table()


def _class_counts(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    k = len(CLASSES) + 1
    owner = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    return np.bincount(owner * k + _CLASS[data], minlength=(len(rows) - 1) * k).reshape(-1, k)[:, :-1]


def _words_of(raw: bytes) -> list[bytes]:
    return raw.lower().split()


def references(documents: DataFrame, common: int = COMMON) -> dict[str, tuple[np.ndarray, dict[bytes, int], np.ndarray]]:
    """Per language: shares of the character classes, places of common words, and their shares with all others last.

    Counts are over every labelled row, for every language. Tasks send sums, not rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes: dict[str, np.ndarray] = {}
        words: dict[str, Counter] = {}
        held = 0  # words of all languages together

        def flush(final: bool) -> Iterator[pa.RecordBatch]:
            rows = [(lang, "word", w.decode("utf-8", "replace"), n) for lang, c in words.items() for w, n in c.items()]
            words.clear()
            if final:
                rows += [(lang, "class", CLASSES[i], int(n)) for lang, c in classes.items() for i, n in enumerate(c)]
            if rows:
                a, b, c, d = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c), pa.array(d, pa.int64())], names=["lang", "kind", "key", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = text.encode()
                got = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=len(CLASSES) + 1)[:-1]
                classes[lang] = classes.get(lang, 0) + got
                counted = words.setdefault(lang, Counter())
                held -= len(counted)
                counted.update(_words_of(raw))
                held += len(counted)
                if held > FLUSH:
                    yield from flush(False)
                    held = 0
        yield from flush(True)

    counted = documents.where("lang is not null and text is not null").select("lang", "text").transform(mapped, run, "lang string, kind string, key string, n long")
    sums = materialize(counted.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")), "word-counts")  # read twice, counted once
    order = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "key")
    totals = sums.groupBy("lang", "kind").agg(F.sum("n").alias("total"))
    top = sums.withColumn("r", F.row_number().over(order)).where(F.col("r") <= common)
    by: dict[str, dict] = {}
    for r in totals.collect():
        by.setdefault(r["lang"], {})[r["kind"]] = r["total"]
    ranked: dict[str, list] = {}
    for r in top.orderBy("lang", "kind", "r").collect():
        ranked.setdefault(r["lang"], []).append(r)
    out = {}
    for lang in sorted(lang for lang, t in by.items() if t.get("class") and t.get("word")):
        share = np.zeros(len(CLASSES))
        common_words, counts = {}, []
        for r in ranked[lang]:
            if r["kind"] == "class":
                share[CLASSES.index(r["key"])] = r["n"]
            else:
                common_words[r["key"].encode()] = len(counts)
                counts.append(r["n"])
        counts.append(by[lang]["word"] - sum(counts))
        out[lang] = share / share.sum(), common_words, np.array(counts) / by[lang]["word"]
    return out


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of each row of p to q, in base 2; rows without any count are at distance 0."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(-1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.where(p.sum(-1) > 0, np.sqrt(np.clip((left + right) / 2, 0, 1)), 0)


def judge(documents: DataFrame, refs: dict | None = None) -> DataFrame:
    """One row per row of documents, see SCHEMA.

    Null texts have no words and fail a base rule, as do empty ones. Where no
    language is known, the base rules alone decide. Repeated rows are judged each.
    """
    refs = references(documents) if refs is None else refs
    langs = sorted(refs)
    # the place of each common word, and of all others, in each language's shares; the last column is of words that are common nowhere
    known: dict[bytes, int] = {}
    for lang in langs:
        for w in refs[lang][1]:
            known.setdefault(w, len(known))
    others = np.array([len(refs[lang][1]) for lang in langs], np.int64)
    place = np.repeat(others[:, None], len(known) + 1, 1).astype(np.min_scalar_type(int(others.max(initial=0))))
    for k, lang in enumerate(langs):
        for w, i in refs[lang][1].items():
            place[k, known[w]] = i

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for b in blocks(batch.column(1)):
                rows = b.hi - b.lo
                points = np.concatenate([[0], np.cumsum(_CLASS[b.data] < len(CLASSES))])
                in_words = np.concatenate([[0], np.cumsum(points[b.ends] - points[b.starts])])
                word_chars = in_words[b.wptr[1:]] - in_words[b.wptr[:-1]]
                bounds = b.rows
                classes = _class_counts(b.data, bounds)
                n_words = b.n_words
                grams = gram_hashes(b.hashes(), 3)
                repeats, dups = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
                words = [np.zeros(0, np.int64)] * rows
                raw = b.data.tobytes()
                for i in range(rows):
                    lo, hi = int(b.wptr[i]), int(b.wptr[i + 1])
                    if hi - lo >= 4:
                        own = grams[lo : hi - 2]
                        _, inverse, count = np.unique(own, return_inverse=True, return_counts=True)
                        again = np.flatnonzero(count[inverse] >= 2)
                        if len(again):
                            hit = np.zeros(hi - lo, bool)
                            for j in range(3):
                                hit[again + j] = True
                            repeats[i] = hit.sum()
                    text = raw[bounds[i] : bounds[i + 1]]
                    lines = [x for x in text.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
                    dups[i] = len(lines) - len(set(lines))
                    found = _words_of(text)
                    words[i] = np.fromiter((known.get(x, -1) for x in found), np.int64, len(found))
                p = classes / np.maximum(classes.sum(1, keepdims=True), 1)
                best, nearest = np.full((rows, 2), np.inf), np.full(rows, -1)
                n_found = np.array([len(w) for w in words])
                owner, of_known = np.repeat(np.arange(rows), n_found), np.concatenate([*words, np.zeros(0, np.int64)])
                for k, lang in enumerate(langs):
                    share, _, counts = refs[lang]
                    width = len(counts)
                    q = np.bincount(owner * width + place[k, of_known], minlength=rows * width).reshape(rows, width) / np.maximum(n_found, 1)[:, None]
                    d = np.stack([js_distance(p, share), js_distance(q, counts)], 1)
                    nearer = d.sum(1) < best.sum(1)
                    best[nearer], nearest[nearer] = d[nearer], k
                failed = (n_words < BASE_WORDS) | (100 * repeats > REPEAT_PERCENT * n_words)
                judged = (nearest >= 0) & (classes.sum(1) >= LEAST_CHARS) & (n_words >= LEAST_WORDS)
                diverges = judged & ((best[:, 0] > CHAR_LIMIT) | (best[:, 1] > WORD_LIMIT))
                known_lang = nearest >= 0
                columns = [
                    ids[b.lo : b.hi], pa.array(n_words, pa.int64()), pa.array(word_chars, pa.int64()), pa.array(classes[:, CLASSES.index("symbol")], pa.int64()), pa.array(dups), pa.array(repeats), pa.array(failed), pa.array(~failed & ~diverges),
                    pa.array([langs[k] if k >= 0 else None for k in nearest], pa.string()), pa.array(best[:, 0], pa.float64(), mask=~known_lang), pa.array(best[:, 1], pa.float64(), mask=~known_lang),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCHEMA.split(", ")])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(mapped, run, SCHEMA)


#: The base part, which SQL can say.
BASE_ORACLE = """
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text,'') AS text, list_filter(string_split_regex(coalesce(text,''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT rid, i, array_to_string(w[i:i+2], ' ') AS g FROM (SELECT rid, w, unnest(generate_series(1, len(w)-2)) AS i FROM w WHERE len(w) >= 3)),
c AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n > 1),
r AS (SELECT rid, count(DISTINCT i + o) AS n FROM c, (SELECT unnest(range(3)) AS o) GROUP BY rid),
l AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM w),
d AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(d.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(r.n, 0) > 50 * len(w) AS base_failed
FROM w LEFT JOIN r USING (rid) LEFT JOIN d USING (rid)
"""
