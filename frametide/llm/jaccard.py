"""N-gram Jaccard join by T-occurrence search with DivideSkip.

1. One pass over the texts makes each document's set of word shingles (64-bit
   hashes), its size and a 128-bit fingerprint, and adds all shingles to a sketch
   of fixed size. Documents with equal sets are one node from here on.
2. Two sets that link share at least c shingles of their prefixes (n - T + c first
   ones in any order that holds for all); c is COMMON_PERCENT of the smaller set,
   so that texts aren't candidates for a few shingles that they share by chance.
   The order is the sketch's count, then the hash: very frequent shingles come
   last and seldom are in a prefix. Prefix rows are sorted by shingle. Of those
   under a shingle of at most RARE sets, pairs (at most RARE - 1 a row) are counted.
   Of c shingles either half are rare, and the pairs' count tells, or more than the
   other half are frequent. Then neighbours of compatible size are chained under
   each, so any frequency costs a linear stream; sets with fewer frequent shingles
   in their prefix than that are in no chain. The components of both are candidates.
3. Sets of a candidate component meet in blocks of bounded size. In a block, a
   set's inverted lists are divided: the L longest are put aside, the short ones
   are merged and what occurs T - L times or more is probed by binary search in
   the long ones. Sets already known to be connected aren't probed again.
4. Components of several blocks: leaders of the blocks' components are joined
   first; then pairs of blocks are searched for what is still apart: a set is sent
   to a block only if that has a set of another component under one of its prefix
   shingles. So no link between components is lost, and a group of near copies,
   which is one component by then, is not squared.

The k-way merge of short lists is one numpy sort of their postings instead of a
Python heap; it gives the same sorted run with counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import among, blocks, discard, gram_hashes, look_up, mapped, materialize, mix
from .graph import Forest, components, small, sorted_groups

SHINGLE, PERCENT = 5, 80
SKETCH_BITS, SKETCH_PARTS = 20, 16
BLOCK_SETS, BLOCK_SHINGLES = 1_024, 2_000_000
MU = 0.0085
COMMON_PERCENT, LEAST_COMMON, RARE = 4, 4, 8
PAIRS_HELD = 1 << 18
_U = np.uint64
_SETS = "doc_id long, n long, s1 long, s2 long, alt long, part int, counts binary"


def _long(x: np.ndarray) -> np.ndarray:
    return x.astype(_U).view(np.int64)


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each row; A-Z lower-cased; fewer than k words are one shingle."""
    for b in blocks(column, lower=True):
        h = b.hashes()
        grams = gram_hashes(h, k)
        for i in range(b.hi - b.lo):
            lo, hi = int(b.wptr[i]), int(b.wptr[i + 1])
            if hi - lo >= k:
                yield b.lo + i, np.unique(grams[lo : hi - k + 1])
            elif hi > lo:
                yield b.lo + i, gram_hashes(h[lo:hi], hi - lo)
            else:
                yield b.lo + i, np.zeros(0, _U)


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, whatever the order."""
    both = np.array([mix(s).sum(dtype=_U), mix(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U)], _U)
    both = mix(both + _U(len(s)))
    return int(both[:1].view(np.int64)[0]), int(both[1:].view(np.int64)[0])


def _measure(documents: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        names = [x.split()[0] for x in _SETS.split(", ")]
        waiting, held = [], 0

        def add() -> None:
            nonlocal held
            if waiting:
                np.add(counts, np.bincount((np.concatenate(waiting) >> _U(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts)).astype(np.uint32), out=counts)
                waiting.clear()
                held = 0

        for batch in batches:
            n, s1, s2 = [], [], []
            for _, s in shingle_sets(batch.column(1), k):
                a, b = fingerprint(s)
                n.append(len(s)), s1.append(a), s2.append(b)
                waiting.append(s)
                held += len(s)
                if held > 1 << 20:
                    add()
            nothing = [None] * len(n)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((batch.column(0).to_pylist(), n, s1, s2, batch.column(2).to_pylist(), nothing, nothing), kinds, strict=True)], names=names)
        add()
        none = [None] * SKETCH_PARTS
        pieces = [p.tobytes() for p in np.split(counts, SKETCH_PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((none, none, none, none, none, list(range(SKETCH_PARTS)), pieces), kinds, strict=True)], names=names)

    # a text without an id is found again by its hash
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.when(F.col("doc_id").isNull(), F.xxhash64("text")).alias("alt")).transform(mapped, run, _SETS)


def _sketch(measured: DataFrame) -> np.ndarray:
    """The sum of the tasks' sketches: SKETCH_PARTS rows of fixed size reach the driver."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(raw, np.uint32)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["part", "counts"])

    out = np.zeros((SKETCH_PARTS, (1 << SKETCH_BITS) // SKETCH_PARTS), np.uint32)
    pieces = measured.where("part is not null").select("part", "counts")
    for r in pieces.repartition(SKETCH_PARTS, "part").transform(mapped, total, "part int, counts binary").collect():
        out[r["part"]] += np.frombuffer(r["counts"], np.uint32)
    return out.ravel()


def least_overlap(n: int, m: int, percent: int = PERCENT) -> int:
    """Least i with 100 * i >= percent * (n + m - i)."""
    return -(-percent * (n + m) // (100 + percent))


def _least_own(n: int, percent: int) -> int:
    """Least overlap of a set of n with any set that it may link with."""
    return -(-percent * n // 100)


def _least_common(n: np.ndarray, percent: int) -> np.ndarray:
    """How many prefix shingles sets of n share at least with any set that they link with and that isn't smaller."""
    n = np.asarray(n, np.int64)
    return np.maximum(1, np.minimum(np.maximum(n * COMMON_PERCENT // 100, LEAST_COMMON), _least_own(n, percent)))


def _least_common_of(n: Column, percent: int) -> Column:
    """The same of a column."""
    return F.greatest(F.lit(1), F.least(F.greatest(F.floor(n * COMMON_PERCENT / 100), F.lit(LEAST_COMMON)), F.ceil(n * percent / 100)))


def _prefix(s: np.ndarray, counts: np.ndarray, percent: int, common: int = 1) -> np.ndarray:
    """The first n - T + common shingles in the sketch's order; sets that link share as many of them as the lesser common says."""
    order = np.lexsort((s, counts[(s >> _U(64 - SKETCH_BITS)).astype(np.int64)]))
    return s[order[: len(s) - _least_own(len(s), percent) + common]]


def _prefixes(documents: DataFrame, sketch, k: int, percent: int) -> DataFrame:
    """(token, s1, n): the prefix of each set under the sketch's order; a task tells each set once while it remembers it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = sketch.value, set()
        for batch in batches:
            tokens, owners, sizes = [], [], []
            rows = 0

            def made() -> pa.RecordBatch:
                lengths = [len(t) for t in tokens]
                return pa.RecordBatch.from_arrays([pa.array(_long(np.concatenate(tokens))), pa.array(np.repeat(np.array(owners, np.int64), lengths)), pa.array(np.repeat(np.array(sizes, np.int32), lengths))], names=["token", "s1", "n"])

            for _, s in shingle_sets(batch.column(0), k):
                if not len(s):
                    continue
                a, _ = fingerprint(s)
                if a in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(a)
                tokens.append(_prefix(s, counts, percent, int(_least_common(len(s), percent)))), owners.append(a), sizes.append(len(s))
                rows += len(tokens[-1])
                if rows > 100_000:
                    yield made()
                    tokens, owners, sizes, rows = [], [], [], 0
            if rows:
                yield made()

    return documents.select("text").transform(mapped, run, "token long, s1 long, n int")


def _met(prefixes: DataFrame, percent: int) -> DataFrame:
    """(a, b, need, common): pairs of sets that may link, with how many rare shingles they share; (a, token, null, n): a set under a frequent shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)  # the last shingle's rows; of a frequent one, the last, which was told
        frequent = False
        waiting: list[tuple[np.ndarray, ...]] = []

        def pairs(token: np.ndarray, s1: np.ndarray, n: np.ndarray, hot: np.ndarray) -> None:
            least = _least_common(n, percent)
            for d in range(1, RARE):
                at = np.flatnonzero((token[d:] == token[:-d]) & (100 * n[:-d] >= percent * n[d:]) & ~hot[d:])
                if len(at):  # rows are by size, so the first of a pair is the smaller set
                    waiting.append((np.minimum(s1[at], s1[at + d]), np.maximum(s1[at], s1[at + d]), least[at]))

        def counted() -> pa.RecordBatch:
            a, b, need = (np.concatenate(c) for c in zip(*waiting, strict=True))
            waiting.clear()
            order = np.lexsort((b, a))
            a, b, need = a[order], b[order], need[order]
            first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            return told(a[first], b[first], need[first], np.diff(np.r_[first, len(a)]))

        def told(*columns: np.ndarray | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.nulls(len(columns[0]), pa.int64()) if c is None else pa.array(c) for c in columns], names=["a", "b", "need", "common"])

        for batch in batches:
            token, s1, n = (np.r_[h, np.asarray(c)].astype(np.int64) for h, c in zip(held, batch.columns, strict=True))
            if not len(token):
                continue
            once = np.r_[True, (token[1:] != token[:-1]) | (s1[1:] != s1[:-1])]  # tasks may tell a set again
            token, s1, n = token[once], s1[once], n[once]
            begin = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            size = np.diff(np.r_[begin, len(token)])
            hot = size > RARE
            hot[0] |= frequent
            new = np.repeat(hot, size)
            new[0] &= not frequent
            frequent = bool(hot[-1])
            until = len(token) if frequent else begin[-1]  # a rare shingle waits for the rest of its rows
            pairs(token[:until], s1[:until], n[:until], np.repeat(hot, size)[:until])
            at = np.flatnonzero(new[:until])
            if len(at):
                yield told(s1[at], token[at], None, n[at])
            if sum(len(w[0]) for w in waiting) > PAIRS_HELD:
                yield counted()
            keep = len(token) - 1 if frequent else begin[-1]
            held = token[keep:], s1[keep:], n[keep:]
        if len(held[0]) > 1:
            pairs(*held, np.zeros(len(held[0]), bool))
        if waiting:
            yield counted()

    parts = int(prefixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return prefixes.repartition(parts, "token").sortWithinPartitions("token", "n", "s1").transform(mapped, run, "a long, b long, need long, common long")


def _chained(rows: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b): under each shingle of rows(token, s1, n), sets of compatible size are chained."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        last = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            token, s1, n = (np.r_[h, np.asarray(c)].astype(np.int64) for h, c in zip(last, batch.columns, strict=True))
            at = np.flatnonzero((token[1:] == token[:-1]) & (100 * n[:-1] >= percent * n[1:]))
            joined = np.array([x for x in zip(s1[at].tolist(), s1[at + 1].tolist(), strict=True) if forest.join(*x)], np.int64).reshape(-1, 2)
            if len(joined):
                yield pa.RecordBatch.from_arrays([pa.array(joined[:, 0]), pa.array(joined[:, 1])], names=["a", "b"])
            last = token[-1:], s1[-1:], n[-1:]

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "token").sortWithinPartitions("token", "n", "s1").transform(mapped, run, "a long, b long")


def _chains(prefixes: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between sets that may link: with enough rare shingles in common, or chained under a frequent one that they have room to share enough of.

    Sets that link share c shingles of their prefixes, of which at most f are frequent
    if the one with fewer frequent ones has f. So they share c - f rare ones at least,
    and either half of c, or more than the other half are frequent: a set with fewer
    frequent ones than that needs no chain.
    """
    met = materialize(_met(prefixes, percent), "met")
    frequent = met.where("need is null").select(F.col("b").alias("token"), F.col("a").alias("s1"), F.col("common").alias("n"))
    most = materialize(frequent.groupBy("s1").agg(F.count("*").alias("f"), F.min("n").alias("n")), "frequent")
    pairs = met.where("need is not null").groupBy("a", "b").agg(F.sum("common").alias("common"), F.min("need").alias("need")).where("2 * common >= need")
    of = lambda name: most.select(F.col("s1").alias(name), F.col("f").alias(f"f{name}"))
    enough = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.col("common") >= F.col("need") - F.coalesce(F.least(F.coalesce("fa", F.lit(0)), F.coalesce("fb", F.lit(0))), F.lit(0)))
    dense = most.where(F.col("f") > F.floor(_least_common_of(F.ceil(F.col("n") * percent / 100), percent) / 2)).select("s1")  # the smallest set that it may link with
    chains = materialize(enough.select("a", "b").unionByName(_chained(frequent.where(among(dense, "s1")).select("token", "s1", "n"), percent)), "chains")
    discard(met, most)
    return chains


def divide_skip(sets: list[np.ndarray], labels: list, sides: list | None = None, percent: int = PERCENT) -> Forest:
    """Joins the labels of sets that link; labels that are equal already are connected.

    With sides, only sets of different sides are compared.
    """
    forest = Forest()
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sizes = np.array([len(sets[i]) for i in order], np.int64)
    flat = np.concatenate([sets[i] for i in order]) if sets else np.zeros(0, _U)
    _, token, frequency = np.unique(flat, return_inverse=True, return_counts=True)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(order)), sizes)
    by_token = np.argsort(token, kind="stable")
    postings = owner[by_token]  # of a token: owners ascending, so by size
    begin = np.concatenate([[0], np.cumsum(frequency)])
    filled = np.zeros(len(frequency), np.int64)  # how many postings of a token came before
    own = [np.sort(token[bounds[x] : bounds[x + 1]]) for x in range(len(order))]
    for x in range(len(order)):
        tokens = own[x]
        lists = tokens[filled[tokens] > 0]
        filled[tokens] += 1
        size = int(sizes[x])
        need = _least_own(size, percent)
        if len(lists) < need:
            continue
        length = filled[lists] - 1  # without x itself
        by_length = np.argsort(length, kind="stable")
        longest = int(length[by_length[-1]])
        aside = min(need - 1, int(need / (MU * math.log2(longest + 1) + 1)))
        short, long_ = lists[by_length[: len(lists) - aside]], np.sort(lists[by_length[len(lists) - aside :]])
        merged = np.concatenate([postings[begin[t] : begin[t] + filled[t] - 1] for t in short.tolist()])
        candidate, count = np.unique(merged, return_counts=True)
        fit = (count >= need - aside) & (100 * sizes[candidate] >= percent * size)
        candidate, count = candidate[fit], count[fit]
        label = labels[order[x]]
        for y, c in zip(candidate.tolist(), count.tolist(), strict=True):
            other = labels[order[y]]
            if sides is not None and sides[order[x]] == sides[order[y]] or forest.root(label) == forest.root(other):
                continue
            place = np.searchsorted(own[y], long_)
            found = c + int((own[y][np.minimum(place, len(own[y]) - 1)] == long_).sum())
            if found >= least_overlap(size, int(sizes[y]), percent):
                forest.join(label, other)
    return forest


def _search(rows: DataFrame, keys: list[str], labelled: bool, k: int, percent: int) -> DataFrame:
    """Per group of keys: (comp, block, of, s1, s2, root) of its sets; with labels, (a, b) links between them.

    Texts are moved and their shingles made here: these take more room than the text.
    """
    schema = "a long, b long" if labelled else "comp long, block int, of int, s1 long, s2 long, root long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def made() -> pa.RecordBatch:
            kinds = [pa.int64()] * 2 if labelled else [pa.int64(), pa.int32(), pa.int32()] + [pa.int64()] * 3
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])
            out.clear()
            return batch

        for group in sorted_groups(batches, keys):
            sets, first, texts = [], {}, group.pop("text")
            for i, (x, (_, tokens)) in enumerate(zip(zip(group["s1"], group["s2"], strict=True), shingle_sets(pa.array(texts, pa.large_string()), k), strict=True)):
                if x not in first and fingerprint(tokens) == x:  # ids may repeat: a set may come twice, or with another's text
                    first[x] = i
                    sets.append(tokens)
            group = {c: [v[i] for i in first.values()] for c, v in group.items()}
            if labelled:
                forest = divide_skip(sets, group["label"], group.get("side"), percent)
                out += [(a, forest.root(a)) for a in forest.up]
            else:
                names = list(first)
                forest = divide_skip(sets, names, None, percent)
                out += [(c, b, of, *name, forest.root(name)[0]) for c, b, of, name in zip(group["comp"], group["block"], group["of"], names, strict=True)]
            if len(out) > 20_000:
                yield made()
        if out:
            yield made()

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys).transform(mapped, run, schema)


def _apart(members: DataFrame, texts: DataFrame, sketch, k: int, percent: int) -> DataFrame:
    """(comp, left, right, side, s1, s2, label): sets to send to a pair of blocks.

    A set goes to each other block that has a set of another label under one of its prefix shingles.
    """
    schema = "token long, comp long, block int, s1 long, s2 long, label long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small(batches):
            found = [_prefix(x, sketch.value, percent) for _, x in shingle_sets(part.column(5), k)]
            if found:
                rows = part.select(range(5)).take(pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found])))
                yield pa.RecordBatch.from_arrays([pa.array(_long(np.concatenate(found))), *(rows.column(i) for i in range(5))], names=[x.split()[0] for x in schema.split(", ")])

    rows = members.join(texts, ["s1", "s2"]).select("comp", "block", "s1", "s2", "label", "text").transform(mapped, run, schema)
    there = rows.groupBy("token", "comp", "block").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).withColumnRenamed("block", "other")
    return rows.join(there, ["token", "comp"]).where("other <> block and (lo <> label or hi <> label)").select(
        "comp", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), F.col("block").alias("side"), "s1", "s2", "label").distinct()


def _across(whole: DataFrame, local: DataFrame, sketch, k: int, percent: int, block_sets: int) -> DataFrame:
    """Links (a, b) between roots of different blocks of one component; empty where each has one block.

    Who meets whom is settled on narrow rows; texts are joined to those that are sent.
    """
    narrow = local.where("of > 1").select("comp", "block", "s1", "s2", "root")
    texts = whole.where("of > 1").select("s1", "s2", "text")
    leaders = narrow.where("s1 = root")
    groups = leaders.groupBy("comp").agg(F.ceil(F.count("*") / block_sets).cast("int").alias("groups"))
    first = leaders.join(groups, "comp").select("comp", F.pmod(F.hash("s1", F.lit(1)), "groups").alias("block"), "s1", "s2", F.col("root").alias("label")).join(texts, ["s1", "s2"])
    joined = materialize(_search(first, ["comp", "block"], True, k, percent), "leader-links")
    named = components(joined).select(F.col("node").alias("root"), F.col("root").alias("top"))
    members = narrow.join(named, "root", "left").select("comp", "block", "s1", "s2", F.coalesce("top", "root").alias("label"))
    sent = materialize(_apart(members, texts, sketch, k, percent), "apart")
    return joined.unionByName(_search(sent.join(texts, ["s1", "s2"]), ["comp", "left", "right"], True, k, percent))


def join(documents: DataFrame, *, k: int = SHINGLE, percent: int = PERCENT, block_sets: int = BLOCK_SETS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row per row of documents: doc_id, n_shingles, component_id.

    Null and empty texts, and texts of white space, have no shingles and are
    linked with nothing, not even each other. Equal sets are linked. component_id
    is the least doc_id of the component (nulls aside); a null doc_id takes part
    in linking. Rows that repeat each give a row. Only doc_id and text are read.
    """
    spark = documents.sparkSession
    measured = materialize(_measure(documents, k), "sets")
    rows = measured.where("part is null").select("doc_id", "n", "s1", "s2", "alt")
    sketch = spark.sparkContext.broadcast(_sketch(measured))  # 4 MB at any input
    candidates = components(_chains(_prefixes(documents, sketch, k, percent), percent)).select(F.col("node").alias("s1"), F.col("root").alias("comp"))
    sets = rows.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.min("alt").alias("alt"), F.count("*").alias("copies"))
    inside = materialize(sets.join(candidates, "s1"), "candidates")
    load = inside.groupBy("comp").agg(F.ceil(F.greatest(F.count("*") / block_sets, F.sum("n") / block_shingles)).cast("int").alias("of"))
    asked = materialize(inside.join(load, "comp").select("comp", "s1", "s2", "of", F.pmod(F.hash("s1", "s2"), "of").alias("block"), F.coalesce("rep", "alt").alias("id"), F.col("rep").isNull().alias("nameless")), "asked")
    named = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), F.lit(False).alias("nameless"), "text")
    nameless = documents.where("doc_id is null and text is not null").select(F.xxhash64("text").alias("id"), F.lit(True).alias("nameless"), "text").dropDuplicates(["id"])
    texts = named.union(nameless).where(among(asked.select("id", "nameless"), "id", "nameless"))  # the others' texts aren't shuffled
    whole = materialize(asked.join(texts, ["id", "nameless"]).select("comp", "s1", "s2", "of", "block", "text"), "texts")
    local = materialize(_search(whole, ["comp", "block"], False, k, percent), "links")
    roots = local.select("s1", "s2", "root")
    tops = components(_across(whole, local, sketch, k, percent, block_sets))
    named_tops = tops.select(F.col("node").alias("root"), F.col("root").alias("top"))
    labelled = materialize(look_up(roots, named_tops, "root").select("s1", "s2", F.coalesce("top", "root").alias("root")), "labelled")
    discard(whole)
    least = inside.join(labelled, ["s1", "s2"]).groupBy("root").agg(F.min("rep").alias("component_id"))
    linked = look_up(labelled, least, "root").select("s1", "s2", "component_id")
    copied = sets.where("copies > 1").select("s1", "s2", "rep")
    special = copied.join(linked, ["s1", "s2"], "full_outer").select("s1", "s2", F.coalesce("component_id", "rep").alias("component_id"))
    return rows.join(special, ["s1", "s2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(documents: DataFrame, **how) -> DataFrame:
    """The rows of documents of which none links with a smaller id, with all their columns.

    Of each component the document with the least id stays; so do documents
    without shingles. Where ids repeat, one row of equal id and text stays.
    """
    found = materialize(join(documents, **how), "components")
    ids = materialize(found.groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("n"), F.max(F.expr("component_id <=> doc_id")).alias("stays")), "ids")
    gone = ids.where("not stays").select("_id")
    maybe = F.coalesce(among(gone, F.col("doc_id").cast("long")), F.lit(False))
    asked = documents.where(maybe)
    out = documents.where(~maybe).union(asked.join(gone, asked["doc_id"].cast("long").eqNullSafe(gone["_id"]), "left_anti"))
    if not ids.where("n > 1").isEmpty():
        out = out.dropDuplicates(["doc_id", "text"])
    return out


ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w,' ')] ELSE list_transform(range(1, len(w)-3), lambda i: array_to_string(w[i:i+4],' ')) END)) AS s FROM w),
g AS (SELECT min(doc_id) AS rep, s, len(s) AS n FROM s GROUP BY s),
t AS (SELECT rep, n, unnest(s) AS tok FROM g WHERE n > 0),
tt AS (SELECT * FROM t WHERE tok IN (SELECT tok FROM t GROUP BY tok HAVING count(*) > 1)),
p AS (SELECT a.rep AS a, b.rep AS b FROM tt a JOIN tt b ON a.tok = b.tok AND a.rep < b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r(rep, reach) AS (SELECT rep, rep FROM g UNION SELECT r.rep, e.b FROM r JOIN e ON r.reach = e.a),
c AS (SELECT rep, min(reach) AS component_id FROM r GROUP BY rep)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE c.component_id END AS component_id
FROM s JOIN g ON s.s = g.s JOIN c ON g.rep = c.rep
"""
