"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

Native throughout: benchmark windows become a small keyed relation that a
broadcast hash join holds as a hash set. Documents are scanned as streams of
token windows. The first HEAD words of each window are looked up by their hash in
a bitmap of the benchmark's; only of windows that pass is the text made, which
probes the set and is the key itself, so a probe that succeeds is a verified hit.
Long documents are cut into parts, each with the words that its windows reach
into. Documents are read once, and one shuffle of a row for each document and
hit brings hits together; equal ones are merged before it.

A benchmark of more than ``broadcast_windows`` windows or ``broadcast_chars``
characters is broadcast in several blocks of that size, each of which is probed
in a pass of its own; the windows of documents are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key, unused

NGRAM, HEAD = 10, 3
PART, LONG_CHARS = 4096, 200_000
KEY = ["_k1", "_k2"]
BROADCAST_WINDOWS = 400_000
BROADCAST_CHARS = 40_000_000
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Lower-cased (A-Z) runs of characters outside ASCII or in [0-9a-z]."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _NOT_WORD), lambda w: w != "")


def _windows(w: Column, k: int) -> Column:
    """Texts of the k-word windows, in order; none where there are fewer words."""
    return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.array_join(F.slice(w, i, k), " "))).otherwise(F.array().cast("array<string>"))


def benchmark_windows(benchmark: DataFrame, n: int = NGRAM) -> DataFrame:
    """(k, win, items): distinct windows with the ids of the items that have them.

    An item of fewer than n words, but not none, is one window. Items without
    words have none. A null item_id still marks words, but is listed nowhere.
    """
    got = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    short = got.where(F.size("w") < n).select("item", F.size("w").alias("k"), F.array_join("w", " ").alias("win"))
    full = got.where(F.size("w") >= n).select("item", F.lit(n).alias("k"), F.explode(_windows(F.col("w"), n)).alias("win"))
    return full.unionByName(short).groupBy("k", "win").agg(F.collect_set("item").alias("items"))


def _parts(rows: DataFrame, most: int, part_words: int, long_chars: int) -> DataFrame:
    """KEY, doc_id, at, starts, w: the words of each document, of long ones in parts of part_words window starts.

    A part has the words that its windows reach into, too. A document without
    words has one empty part.
    """
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), _UPPER, _LOWER)
    word = rf"{_WORD}++{_NOT_WORD[:-1]}*+"
    head = rf"^(?:{word}){{1,{max(1, most - 1)}}}+"
    cut = F.when(F.length(text) > long_chars, F.regexp_extract_all(text, F.lit(rf"(?:{word}){{1,{part_words}}}+"), F.lit(0)))

    def dealt(pieces: Column) -> Column:
        after = lambda j: F.regexp_extract(F.coalesce(F.get(pieces, j + 1), F.lit("")), head, 0)
        parts = F.transform(pieces, lambda x, j: F.struct((j * part_words).alias("at"), F.concat(x, F.lit(" "), after(j)).alias("text")))
        return F.when(F.size(pieces) > 1, parts).otherwise(F.array(F.struct(F.lit(0).alias("at"), text.alias("text"))))

    held = rows.select(*KEY, "doc_id", F.explode(F.get(F.transform(F.array(F.coalesce(cut, F.array().cast("array<string>"))), dealt), F.lit(0))).alias("p"), (F.length(text) > long_chars).alias("long"))
    w = F.filter(F.split("p.text", _NOT_WORD), lambda x: x != "")
    each = held.select(*KEY, "doc_id", "p.at", "long", w.alias("w"))
    return each.select(*KEY, "doc_id", "at", F.when(F.col("long"), F.least(F.lit(part_words), F.size("w"))).otherwise(F.size("w")).alias("starts"), "w")


def _head_hash(w: Column, i: Column, n: int) -> Column:
    return F.xxhash64(*[F.get(w, i + j) for j in range(n)])


def _bits(found: DataFrame, lengths: list[int], windows: int) -> dict[int, tuple[Column, int]]:
    """By the words of a window that are looked at first: a bitmap, as 64-bit words, of the hashes of these words in the benchmark.

    16 places a window, so a bounded block of windows has a bounded bitmap.
    """
    out = {}
    for n in sorted({min(k, HEAD) for k in lengths}):
        size = 1 << max(4, (windows // 4).bit_length())
        at = found.where(F.least("k", F.lit(HEAD)) == n).select(_head_hash(F.split("win", " "), F.lit(0), n).alias("h"))
        bits = at.select(F.pmod(F.shiftrightunsigned("h", 6), F.lit(size)).cast("int").alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
        full = [0] * size
        for r in bits.groupBy("at").agg(F.bit_or("bit").alias("bits")).collect():
            full[r["at"]] = r["bits"]
        out[n] = F.split(F.lit(",".join(map(str, full))), ",").cast("array<bigint>"), size  # folded to a constant by the optimizer
    return out


def _probes(w: Column, starts: Column, lengths: list[int], bits: dict[int, tuple[Column, int]], marked: bool) -> Column:
    """(pos, k, win) of each window whose first words are in the bitmap; with marked also (-1, 0, null)."""
    none = F.array().cast("array<struct<pos:int,k:int,win:string>>")
    mark = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(0).alias("k"), F.lit(None).cast("string").alias("win"))) if marked else none

    def of(k: int) -> Column:
        n = min(k, HEAD)
        places, size = bits[n]

        def may(i: Column) -> Column:
            def is_set(h: Column) -> Column:
                return F.getbit(F.get(places, F.pmod(F.shiftrightunsigned(h, 6), F.lit(size)).cast("int")), h.bitwiseAND(F.lit(63)).cast("int")) == 1

            return F.exists(F.array(_head_hash(w, i, n)), is_set)

        last = F.least(starts, F.size(w) - k + 1) - 1
        win = lambda i: F.struct(i.alias("pos"), F.lit(k).alias("k"), F.concat_ws(" ", *[F.get(w, i + j) for j in range(k)]).alias("win"))
        return F.when(last >= 0, F.transform(F.filter(F.sequence(F.lit(0), last), may), win)).otherwise(none)

    return F.concat(mark, *[of(k) for k in lengths])


def scan(documents: DataFrame, benchmark: DataFrame, *, n: int = NGRAM, broadcast_windows: int = BROADCAST_WINDOWS, broadcast_chars: int = BROADCAST_CHARS, part_words: int = PART, long_chars: int = LONG_CHARS) -> DataFrame:
    """A row's key, doc_id, n_words, hit_positions and items, for each row of documents."""
    if part_words < n:
        raise ValueError("a window reaches into the next part only")
    found = benchmark_windows(benchmark, n)
    sizes = found.groupBy("k").agg(F.count("*").alias("n"), F.sum(F.length("win") + F.length(F.array_join("items", ","))).alias("chars")).collect()  # at most n rows
    windows, chars = sum(r.n for r in sizes), sum(r.chars for r in sizes)
    blocks = max(1, -(-windows // max(1, broadcast_windows)), -(-chars // max(1, broadcast_chars)))
    lengths = sorted(r.k for r in sizes)
    rows = documents.select("doc_id", "text").withColumns(row_key("doc_id", "text"))
    parts = _parts(rows, max(lengths, default=1), part_words, long_chars)
    hits = None
    for block in range(blocks):
        keys = found.where(F.pmod(F.xxhash64("win"), F.lit(blocks)) == block)
        probes = _probes(F.col("w"), F.col("starts"), lengths, _bits(keys, lengths, windows // blocks), block == 0)
        asked = parts.select(*KEY, "doc_id", "at", "starts", F.explode(probes).alias("x")).select(*KEY, "doc_id", "at", "starts", "x.pos", "x.k", "x.win")
        met = asked.join(F.broadcast(keys.select("win", "items")), "win", "left").where((F.col("pos") < 0) | F.col("items").isNotNull())
        got = met.select(*KEY, "doc_id", "at", "starts", (F.col("at") + F.col("pos")).alias("pos"), "k", "items")
        hits = got if hits is None else hits.unionByName(got)
    is_hit = F.col("k") > 0
    per = hits.groupBy(*KEY).agg(
        F.first("doc_id").alias("doc_id"), F.count(F.when(~is_hit & (F.col("at") == 0), 1)).alias("rows"), F.sum(F.when(~is_hit, F.col("starts")).otherwise(0)).alias("words"),
        F.collect_set(F.when(is_hit, F.struct("pos", "k"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(is_hit, F.col("items")))))).alias("items"),
    )
    places = F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda x: F.sequence(x["pos"], x["pos"] + x["k"] - 1)))))
    each = per.select(*KEY, "doc_id", F.expr("words div rows").alias("n_words"), places.alias("hit_positions"), "items", "rows")
    return each.withColumn("rows", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).drop("rows")


def decontaminate(documents: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """One row per row of documents: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, hit_positions.

    hit_positions are the word places (from 0) inside any occurrence of a
    benchmark window. Null or empty texts have no words and no hits; repeated
    rows each get their row; an empty benchmark hits nothing; columns other than
    doc_id and text are not looked at.
    """
    out = scan(documents, benchmark, **how)
    return out.select(
        "doc_id", "n_words", F.size("hit_positions").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hit_positions") > 0).alias("contaminated"), "items", "hit_positions",
    )


def remove_documents(documents: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of documents without any hit, with all their columns, whatever their names.

    Windows are probed row by row, so a repeated doc_id is judged by its own text.
    """
    keys = row_key("doc_id", "text")
    names = unused(documents.columns, *keys)
    rows = documents.withColumns(dict(zip(names, keys.values(), strict=True)))
    bad = scan(documents, benchmark, **how).where(F.size("hit_positions") > 0).select(*(F.col(k).alias(a) for k, a in zip(keys, names, strict=True))).distinct()
    return rows.join(bad, names, "left_anti").select(*documents.columns)


ORACLE = """
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w),10) AS k, array_to_string(w[i:i+least(len(w),10)-1],' ') AS win
  FROM b, LATERAL (SELECT unnest(generate_series(1, len(w)-least(len(w),10)+1)) AS i) WHERE len(w) > 0),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT rid, k, i, array_to_string(w[i:i+k-1],' ') AS win
  FROM (SELECT rid, w, k, unnest(generate_series(1, len(w)-k+1)) AS i FROM d, ks WHERE len(w) >= k)),
h AS (SELECT rid, dw.k, i, item FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
p AS (SELECT rid, count(DISTINCT i+o) AS n_hit FROM (SELECT DISTINCT rid, i, k FROM h), LATERAL (SELECT unnest(generate_series(0,k-1)) AS o) GROUP BY rid),
t AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit,0) AS BIGINT) AS n_hit, CAST(coalesce(n_items,0) AS BIGINT) AS n_items,
  sha256(coalesce(items,'')) AS items_sha256, coalesce(n_hit,0) > 0 AS contaminated
FROM d LEFT JOIN p USING (rid) LEFT JOIN t USING (rid)
"""
