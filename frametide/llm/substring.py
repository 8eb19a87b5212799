"""Substring dedup: windows of WINDOW words that occur elsewhere, by FM-indexes per shard.

Sharding by content. Each window has a minimizer, the least hash of its GRAM-word
parts; equal windows have equal minimizers. A maximal run of windows with one
minimizer is a segment. A first pass counts minimizers; one that is seen once
cannot be in a repeated window. Segments of the others go to the shard of their
minimizer, so that all that may be equal meets, and each text is moved about
once however many shards there are.

Index. A shard's distinct segments, with how often each occurs, are laid out as
sequences of PHRASE-word symbols (those at distances of PHRASE words follow each
other), the Burrows-Wheeler transform of which is kept as a wavelet matrix of
packed bits with block counts. Streamed segments are searched backwards, all
windows of the shard at once: each step narrows the suffix intervals by one
symbol, and a window whose interval holds fewer than two occurrences leaves: its
matching statistic is below the threshold. What is left are the intervals of
length WINDOW or more that are reported.

Hot minimizers (more than HOT segments) would fill one shard: their windows go
singly, by the hash of the whole window, so equal ones still meet. Equal segments
of a batch are merged with a count before they are moved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MAP_BITS, Block, among, bitmap_of, blocks, gram_hashes, in_bitmap, map_bits_for, mapped, materialize, mix, powers, row_key

WINDOW, GRAM, PHRASE = 35, 12, 5
HOT = 20_000
SHARD_WORDS = 1 << 18
_U = np.uint64
_FULL = _U(0xFFFFFFFFFFFFFFFF)


def _long(x: np.ndarray) -> np.ndarray:
    return x.astype(_U).view(np.int64)


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each width neighbours."""
    made, have = x, 1
    while have * 2 <= width:
        made = np.minimum(made[:-have], made[have:])
        have *= 2
    return np.minimum(made[: len(made) - (width - have)], made[width - have :]) if width > have else made


class Segments:
    """Segments of a block: first word, number of windows, minimizer and how often it is there, two hashes of their words."""

    def __init__(self, b: Block, window: int, gram: int):
        h = b.hashes()
        n = len(h) - window + 1
        self.start = self.windows = self.times = np.zeros(0, np.int64)
        self.least = np.zeros(0, _U)
        self.prefix: list[np.ndarray] = []
        self.window = window
        if n <= 0:
            return
        grams = mix(gram_hashes(h, gram) + _U(0x632BE59BD9B4E019))
        least = _sliding_least(grams, window - gram + 1)[:n]
        valid = np.flatnonzero(b.room(window)[:n])
        if not len(valid):
            return
        new = np.ones(len(valid), bool)
        new[1:] = (valid[1:] != valid[:-1] + 1) | (least[valid[1:]] != least[valid[:-1]])
        first = np.flatnonzero(new)
        self.start, smallest = valid[first], least[valid[first]]
        self.least = mix(smallest ^ _U(0x2545F4914F6CDD1D))  # the least of many hashes is small: spread it again, for bitmaps and routes
        self.windows = np.diff(np.append(first, len(valid)))
        # how often the minimizer is in its segment: a window may repeat inside one
        span = self.windows + window - gram
        begin = np.cumsum(span) - span
        at = np.repeat(self.start - begin, span) + np.arange(span.sum())
        self.times = np.add.reduceat((grams[at] == np.repeat(smallest, span)).astype(np.int64), begin)
        up, self.down = powers(len(h) + 1)
        for salt in (_U(0), _U(0xA0761D6478BD642F)):
            p = np.zeros(len(h) + 1, _U)
            np.cumsum(mix(h ^ salt) * up[: len(h)], out=p[1:])
            self.prefix.append(p)

    def hashes(self, start: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(mix((p[start + words] - p[start]) * self.down[start] + words.astype(_U)) for p in self.prefix)


class Filter:
    """Which minimizers to send, and which are hot."""

    def __init__(self, repeated: np.ndarray, hot: np.ndarray):
        self.repeated, self.hot = repeated, hot

    def pick(self, s: Segments) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, windows, route) of what is sent; hot segments as single windows."""
        keep = in_bitmap(self.repeated, s.least)
        hot = keep & in_bitmap(self.hot, s.least)
        keep &= ~hot
        start, windows, route = s.start[keep], s.windows[keep], s.least[keep]
        if hot.any():
            many = s.windows[hot]
            each = np.repeat(s.start[hot], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            one = np.ones(len(each), np.int64)
            own, _ = s.hashes(each, one * s.window)
            start, windows, route = np.r_[start, each], np.r_[windows, one], np.r_[route, own]
        return start, windows, route


def _minimizers(documents: DataFrame, window: int, gram: int) -> DataFrame:
    """(least, n): how often each minimizer is in segments that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Segments(b, window, gram) for b in blocks(batch.column(0))]
            if found:
                least, place = np.unique(np.concatenate([s.least for s in found]), return_inverse=True)
                n = np.bincount(place, np.concatenate([s.times for s in found]), len(least))
                yield pa.RecordBatch.from_arrays([pa.array(_long(least)), pa.array(n.astype(np.int64))], names=["least", "n"])

    return documents.select("text").transform(mapped, run, "least long, n long").groupBy("least").agg(F.sum("n").alias("n"))


_SENT = "route long, c1 long, c2 long, weight long, words binary"


def _sent(documents: DataFrame, chosen, window: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple[int, int], list] = {}
            size = 0

            def made() -> pa.RecordBatch:
                columns = list(zip(*((r, a, b, w, t) for (a, b), (r, w, t) in seen.items()), strict=True))
                seen.clear()
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(),) * 4 + (pa.binary(),), strict=True)], names=["route", "c1", "c2", "weight", "words"])

            for b in blocks(batch.column(0)):
                s = Segments(b, window, gram)
                start, windows, route = chosen.value.pick(s)
                if not len(start):
                    continue
                c1, c2 = (_long(c).tolist() for c in s.hashes(start, windows + window - 1))
                lo, hi = b.starts[start].tolist(), b.ends[start + windows + window - 2].tolist()
                raw = b.data.tobytes()
                for r, key1, key2, i, j in zip(_long(route).tolist(), c1, c2, lo, hi, strict=True):
                    if (known := seen.get((key1, key2))) is not None:
                        known[1] += 1
                    else:
                        seen[key1, key2] = [r, 1, raw[i:j]]
                        size += j - i
                if size > 4 << 20:
                    yield made()
                    size = 0
            if seen:
                yield made()

    return documents.select("text").transform(mapped, run, _SENT)


class WaveletMatrix:
    """Symbols below 2**levels; rank by packed words and counts before them."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.n = levels, len(symbols)
        self.words, self.before, self.zeros = [], [], []
        now = symbols
        for level in range(levels - 1, -1, -1):
            bit = (now >> level) & 1
            padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
            padded[: self.n] = bit
            words = np.packbits(padded, bitorder="little").view(_U)
            counts = np.bitwise_count(words).astype(np.int32)
            self.words.append(words)
            self.before.append(np.concatenate([[0], np.cumsum(counts[:-1])]).astype(np.int32))
            self.zeros.append(int(self.n - bit.sum()))
            now = np.concatenate([now[bit == 0], now[bit == 1]])

    def _ones(self, k: int, i: np.ndarray) -> np.ndarray:
        at = i >> 6
        mask = (_U(1) << (i & 63).astype(_U)) - _U(1)
        return self.before[k][at] + np.bitwise_count(self.words[k][at] & mask)

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Place after all levels of the first i symbols' last c; the same for i = 0 is taken off by the caller's starts."""
        for k in range(self.levels):
            one = (c >> (self.levels - 1 - k)) & 1 > 0
            ones = self._ones(k, i)
            i = np.where(one, self.zeros[k] + ones, i - ones)
        return i


class FMIndex:
    """Of integer sequences that are each ended by symbol 0; patterns of at most depth - 1 symbols, none 0."""

    def __init__(self, text: np.ndarray, weights: np.ndarray, depth: int = 8):
        n = len(text)
        rank, span = text.astype(np.int64), 1
        while span < depth:
            after = np.zeros(n, np.int64)
            after[: n - span] = rank[span:] + 1
            _, rank = np.unique(rank * (n + 2) + after, return_inverse=True)
            span *= 2
        order = np.argsort(rank, kind="stable")
        bwt = text[order - 1]
        sigma = int(text.max()) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.matrix = WaveletMatrix(bwt, max(1, int(sigma - 1).bit_length()))
        # where each symbol's part begins after the matrix's last level
        symbols = np.arange(sigma)
        self.base = self.matrix.rank(symbols, np.zeros(sigma, np.int64))
        self.weight = np.concatenate([[0], np.cumsum(weights[order])])

    def search(self, text: np.ndarray, at: np.ndarray, length: int, least: int) -> np.ndarray:
        """Whether the length symbols of text from each place occur least times or more by weight."""
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(text), np.int64)
        alive = np.arange(len(at))
        for j in range(length - 1, -1, -1):
            c = text[at[alive] + j]
            lo, hi = (self.first[c] + self.matrix.rank(c, i) - self.base[c] for i in (lo, hi))
            stay = self.weight[hi] - self.weight[lo] >= least
            alive, lo, hi = alive[stay], lo[stay], hi[stay]
        out = np.zeros(len(at), bool)
        out[alive] = True
        return out


def repeated_windows(segments: list[bytes], weights: list[int], window: int = WINDOW, phrase: int = PHRASE) -> list[np.ndarray]:
    """For each segment, which of its windows occur twice or more among all segments, each counted weight times."""
    known: dict[bytes, int] = {}
    words = [[known.setdefault(w, len(known)) for w in s.split()] for s in segments]
    sizes = np.array([len(w) for w in words], np.int64)
    flat = np.fromiter((x for w in words for x in w), np.int64, int(sizes.sum()))
    if window % phrase:
        raise ValueError("a window is a whole number of phrases")
    # phrases of words as symbols: exact, by ranking pairs
    n, code, have = len(flat), flat, 1
    while have < phrase:
        step = min(have, phrase - have)
        after = np.zeros(n, np.int64)
        after[: n - step] = code[step:] + 1
        _, code = np.unique(code * (n + 2) + after, return_inverse=True)
        have += step
    begin = np.cumsum(sizes) - sizes
    counts = sizes - phrase + 1
    owner = np.repeat(np.arange(len(sizes)), counts)
    i = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    # order of symbols: by segment, then place modulo phrase, then place; an end after each such run
    order = np.lexsort((i, i % phrase, owner))
    run = owner[order] * phrase + i[order] % phrase
    ends = np.flatnonzero(np.append(run[1:] != run[:-1], True))
    at = np.arange(len(order)) + np.concatenate([[0], np.cumsum(np.bincount(ends, minlength=len(order)))[:-1]])
    text = np.zeros(len(order) + len(ends), np.int64)
    _, symbol = np.unique(code[begin[owner] + i], return_inverse=True)
    text[at] = symbol[order] + 1
    weight = np.zeros(len(text), np.int64)
    weight[at] = np.asarray(weights, np.int64)[owner[order]]
    place = np.empty(len(order), np.int64)
    place[order] = at
    starts = np.flatnonzero(i + window <= sizes[owner])
    once = np.asarray(weights)[owner[starts]] < 2
    found = np.ones(len(starts), bool)
    if once.any():
        found[once] = FMIndex(text, weight).search(text, place[starts[once]], window // phrase, 2)
    return np.split(found, np.cumsum(sizes - window + 1)[:-1])


def _found(sent: DataFrame, window: int, phrase: int, shard_words: int) -> DataFrame:
    """(c1, c2, bits): segments with a repeated window; shards end where a route ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: dict[tuple[int, int], list] = {}
        size, last = 0, None

        def searched() -> Iterator[pa.RecordBatch]:
            keys = list(shard)
            bits = repeated_windows([v[1] for v in shard.values()], [v[0] for v in shard.values()], window, phrase)
            hit = [(a, b, np.packbits(x).tobytes()) for (a, b), x in zip(keys, bits, strict=True) if x.any()]
            shard.clear()
            if hit:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*hit, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["c1", "c2", "bits"])

        for batch in batches:
            for route, c1, c2, weight, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if route != last and size >= shard_words:
                    yield from searched()
                    size = 0
                last = route
                if (known := shard.get((c1, c2))) is not None:
                    known[0] += weight
                else:
                    shard[c1, c2] = [weight, words]
                    size += words.count(b" ") + 1
        if shard:
            yield from searched()

    parts = int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sent.repartition(parts, "route").sortWithinPartitions("route").transform(mapped, run, "c1 long, c2 long, bits binary")


def _places(rows: DataFrame, chosen, window: int, gram: int) -> DataFrame:
    """(_k1, _k2, c1, c2, start): where each sent segment is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.asarray(batch.column(i)) for i in range(2)]
            for b in blocks(batch.column(2)):
                s = Segments(b, window, gram)
                start, windows, _ = chosen.value.pick(s)
                if len(start):
                    row = np.searchsorted(b.wptr, start, side="right") - 1
                    c1, c2 = s.hashes(start, windows + window - 1)
                    yield pa.RecordBatch.from_arrays([*(pa.array(k[b.lo + row]) for k in keys), pa.array(_long(c1)), pa.array(_long(c2)), pa.array((start - b.wptr[row]).astype(np.int32))], names=["_k1", "_k2", "c1", "c2", "start"])

    return rows.select("_k1", "_k2", "text").transform(mapped, run, "_k1 long, _k2 long, c1 long, c2 long, start int")


def _cut(rows: DataFrame, window: int) -> DataFrame:
    """Words without the covered ones, from the repeated windows' places."""
    schema = "doc_id long, n_words long, n_removed long, kept string, removed array<struct<start:int,end:int>>"
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                n_words, n_removed, kept, removed = [], [], [], []
                for text, found in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    words = (text or "").encode().split()
                    n_words.append(len(words))
                    if not found:
                        n_removed.append(0), kept.append(b" ".join(words).decode()), removed.append([])
                        continue
                    edge = np.zeros(len(words) + 1, np.int64)
                    for x in found:
                        at = x["start"] + np.flatnonzero(np.unpackbits(np.frombuffer(x["bits"], np.uint8)))
                        np.add.at(edge, at, 1)
                        np.add.at(edge, at + window, -1)
                    covered = np.cumsum(edge[:-1]) > 0
                    step = np.flatnonzero(np.diff(np.r_[False, covered, False].astype(np.int8)))
                    n_removed.append(int(covered.sum()))
                    kept.append(b" ".join(w for w, c in zip(words, covered.tolist(), strict=True) if not c).decode())
                    removed.append([{"start": int(a), "end": int(b)} for a, b in step.reshape(-1, 2)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(removed, spans)], names=["doc_id", "n_words", "n_removed", "kept", "removed"])

    return rows.select("doc_id", "text", "found").transform(mapped, run, schema)


def dedup(documents: DataFrame, *, window: int = WINDOW, gram: int = GRAM, phrase: int = PHRASE, hot: int = HOT, shard_words: int = SHARD_WORDS, map_bits: int = MAP_BITS) -> DataFrame:
    """One row per row of documents: doc_id, n_words, n_removed, kept (words joined by a space), removed (word spans).

    A word goes if a window over it starts anywhere else, in the same document
    too. Null and empty texts have no words; texts shorter than the window lose
    nothing, as a window is never cut. Repeated rows count as
    occurrences of each other. Ids may be null or repeat: rows of equal id and
    text lose the same words. The bitmap of minimizers has at most 2**map_bits
    places; where repeated minimizers are so many that it is full, every segment is sent.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumns(row_key("doc_id", "text"))
    repeated = materialize(_minimizers(rows, window, gram).where("n > 1"), "minimizers")
    n, n_hot = repeated.agg(F.count("*"), F.count(F.when(F.col("n") > hot, 1))).first()
    hot_bits = max(3, min(map_bits, max(10, (64 * n_hot).bit_length())))
    chosen = spark.sparkContext.broadcast(Filter(bitmap_of(repeated.select("least"), map_bits_for(n, map_bits)), bitmap_of(repeated.where(F.col("n") > hot).select("least"), hot_bits)))
    found = materialize(_found(_sent(rows, chosen, window, gram), window, phrase, shard_words), "repeated")
    # a place once, however many rows are equal in id and text; then only texts with places are shuffled
    once = _places(rows, chosen, window, gram).join(found, ["c1", "c2"]).groupBy("_k1", "_k2", "start").agg(F.first("bits").alias("bits"))
    placed = materialize(once.groupBy("_k1", "_k2").agg(F.collect_list(F.struct("start", "bits")).alias("found")), "places")
    maybe = among(placed.select("_k1", "_k2"), "_k1", "_k2", map_bits=map_bits)
    nothing = F.lit(None).cast(placed.schema["found"].dataType).alias("found")
    asked = rows.where(maybe).join(placed, ["_k1", "_k2"], "left").select("doc_id", "text", "found")
    return _cut(rows.where(~maybe).select("doc_id", "text", nothing).union(asked), window)


ORACLE = """
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(coalesce(text,''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT rid, i, md5(array_to_string(w[i:i+34],' ')) AS g FROM (SELECT rid, w, unnest(generate_series(1, len(w)-34)) AS i FROM w WHERE len(w) >= 35)),
r AS (SELECT rid, i FROM g WHERE g IN (SELECT g FROM g GROUP BY g HAVING count(*) > 1)),
c AS (SELECT DISTINCT rid, i + o AS p FROM r, (SELECT unnest(range(35)) AS o)),
x AS (SELECT w.rid, doc_id, w, unnest(CASE WHEN len(w) = 0 THEN [NULL] ELSE generate_series(1, len(w)) END) AS p FROM w),
t AS (SELECT x.rid, any_value(doc_id) AS doc_id, any_value(len(w)) AS n, count(c.p) AS n_removed, coalesce(string_agg(w[x.p], ' ' ORDER BY x.p) FILTER (WHERE c.p IS NULL AND x.p IS NOT NULL), '') AS kept
  FROM x LEFT JOIN c ON x.rid = c.rid AND x.p = c.p GROUP BY x.rid)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(kept) AS kept_sha256 FROM t
"""
