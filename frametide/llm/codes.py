"""Compression of vectors to codes: product quantisation with whole numbers, nearest entries by slices and bitmasks.

A codebook keeps its entries' coordinates sorted by dimension, and for each place
in that order a mask of the entries before it. The entries within a radius of a
point in one dimension are a slice of that order, so two bisections and one
exclusive or of masks give them; all dimensions' masks ANDed leave the entries in
a cube around the point. The first radius is the codebook's own scale. The
best entry in the cube is the nearest of all if its distance is within the radius;
where it isn't, that distance is the radius of a second cube, which holds every
entry as near as that.

All numbers are integers, so results don't depend on how rows are dealt out.
A round leaves counts and sums of the codebooks' entries; nothing else reaches the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, materialize
from .whitening import integers, largest, matrix, width

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: Labels with at least one in so many rows are joined by broadcast: there can be no more of them than this.
HOT_LABELS = 4096
_LONG = 1 << 63


class Codebook:
    """The entries of one part, of at most 256."""

    def __init__(self, entries: list[list[int]]):
        size = max((abs(v) for e in entries for v in e), default=0)
        self.small = 4 * size * size * max(1, len(entries[0])) < _LONG >> 1
        self.entries = np.array(entries, np.int64 if self.small else object)
        self.largest = size
        order = np.argsort(self.entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.entries, order, 0)
        self.words = -(-len(entries) // 64)
        self.before = np.zeros((self.words, len(entries) + 1, self.entries.shape[1]), np.uint64)
        for word in range(self.words):
            bits = np.where(order // 64 == word, np.uint64(1) << (order % 64).astype(np.uint64), np.uint64(0))
            self.before[word, 1:] = np.bitwise_or.accumulate(bits, axis=0)
        apart = [min((sum((a - b) ** 2 for a, b in zip(e, f, strict=True)) for f in entries if f != e), default=0) for e in entries]
        self.radius = math.isqrt(sorted(apart)[len(apart) // 2])

    def within(self, x: np.ndarray, radius) -> np.ndarray:
        """Masks (words x points) of the entries that differ from x by radius or less in every dimension."""
        out = np.full((self.words, len(x)), ~np.uint64(0))
        for j in range(x.shape[1]):
            column = self.sorted[:, j]
            low, high = np.searchsorted(column, x[:, j] - radius, "left"), np.searchsorted(column, x[:, j] + radius, "right")
            out &= self.before[:, high, j] ^ self.before[:, low, j]
        return out

    def _measure(self, x: np.ndarray, masks: np.ndarray, entry: np.ndarray, best: np.ndarray, found: np.ndarray) -> None:
        """Takes the nearest of each mask's entries over into entry and best, of equals the lower."""
        for i in range(len(self.entries)):
            at = np.flatnonzero(masks[i // 64] & (np.uint64(1) << np.uint64(i % 64)))
            if len(at):
                far = ((x[at] - self.entries[i]) ** 2).sum(1)
                take = ~found[at] | (far < best[at]) | ((far == best[at]) & (i < entry[at]))
                entry[at[take]], best[at[take]], found[at[take]] = i, far[take], True

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each point its nearest entry, of equals the first, and the squared distance; exact whatever the radius."""
        if not self.small or largest(x) > self.largest:
            reach = largest(x) + self.largest
            x = x.astype(object) if reach * reach * max(1, x.shape[1]) >= _LONG or not self.small else x
        entry, best, found = np.zeros(len(x), np.int64), np.zeros(len(x), x.dtype), np.zeros(len(x), bool)
        self._measure(x, self.within(x, self.radius), entry, best, found)
        lost = np.flatnonzero(~found)  # an empty cube: any entry's distance will do as a radius
        entry[lost], found[lost] = 0, True
        best[lost] = ((x[lost] - self.entries[0]) ** 2).sum(1)
        again = np.flatnonzero(best > self.radius * self.radius)
        if len(again):
            y, e, b, f = x[again], entry[again], best[again], found[again]
            radius = np.array([math.isqrt(int(v)) for v in b.tolist()], y.dtype)
            self._measure(y, self.within(y, radius), e, b, f)
            entry[again], best[again] = e, b
        return entry, best


def _means(x: np.ndarray, entry: np.ndarray, k: int) -> list[tuple[int, int, list[int]]]:
    """(entry, count, sums) of the entries in use."""
    out = []
    for i in range(k):
        mine = x[entry == i]
        if len(mine):
            mine = mine if largest(mine) * len(mine) < _LONG else mine.astype(object)
            out.append((i, len(mine), mine.sum(0).tolist()))
    return out


def _round(rows: DataFrame, books: list[Codebook], d: int) -> list[list[list[int]]]:
    """The entries after one round: whole means of the parts nearest to each; an entry without any stays."""
    w, k = d // len(books), len(books[0].entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], tuple[int, list[int]]] = {}
        for batch in batches:
            x = matrix(batch.column(0), d)
            for p, book in enumerate(books):
                part = x[:, p * w : (p + 1) * w]
                for i, n, sums in _means(part, book.nearest(part)[0], k):
                    m, before = total.get((p, i), (0, [0] * w))
                    total[p, i] = m + n, [a + b for a, b in zip(before, sums, strict=True)]
        flat = [(p, i, j, n, str(s)) for (p, i), (n, sums) in total.items() for j, s in enumerate(sums)]
        if flat:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat, strict=True), [pa.int32()] * 3 + [pa.int64(), pa.string()], strict=True)], names=["part", "entry", "place", "n", "total"])

    found = rows.select("x").transform(mapped, run, "part int, entry int, place int, n long, total string").groupBy("part", "entry", "place").agg(F.sum("n"), F.sum(F.col("total").cast("decimal(38,0)"))).collect()
    out = [[[int(v) for v in e] for e in book.entries.tolist()] for book in books]
    for p, i, j, n, total in found:
        out[p][i][j] = int(total) // n
    return out


def fit(rows: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[list[list[int]]]:
    """Codebooks (part, entry, place) of rows(vec_id, x): begun with the parts of the least vec_ids, moved to their means in each round.

    Of equal ids the lesser vector comes first, null ids come last; of fewer rows
    than entries each is one. No rows give no codebooks.
    """
    d = width(rows)
    if d % parts:
        raise ValueError(f"{d} entries can't be cut into {parts} equal parts")
    first = [r["x"] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()]
    if not first:
        return []
    w = d // parts
    books = [[x[p * w : (p + 1) * w] for x in first] for p in range(parts)]
    for _ in range(rounds):
        books = _round(rows, [Codebook(b) for b in books], d)
    return books


def encode(rows: DataFrame, books: list[list[list[int]]], *others: str) -> DataFrame:
    """others of rows(x), code (two hex digits a part) and error, the squared distance to what the code stands for; null where a long can't hold it."""
    schema = rows.select(*others).schema.add("code", "string").add("error", "long")
    d, n = sum(len(b[0]) for b in books), len(others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [Codebook(b) for b in books]
        for batch in batches:
            x, codes, errors, at = matrix(batch.column(n), d), [], [], 0
            for book in made:
                w = book.entries.shape[1]
                entry, far = book.nearest(x[:, at : at + w])
                codes.append(entry.astype(np.uint8))
                errors.append(far.astype(object) if len(far) and largest(far) * len(made) >= _LONG else far)
                at += w
            error = [e if e < _LONG else None for e in sum(errors).tolist()] if errors else []
            code = [c.tobytes().hex() for c in np.stack(codes, 1)] if len(x) else []
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(code, pa.string()), pa.array(error, pa.int64())], names=schema.names)

    return rows.select(*others, "x").transform(mapped, run, schema)


def decode(rows: DataFrame, books: list[list[list[int]]], code: str = "code") -> DataFrame:
    """rows with a column x array<long> of the vectors that codes stand for; a null code gives null."""
    table = F.array(*[F.array(*[F.array(*[F.lit(v).cast("long") for v in e]) for e in b]) for b in books])
    at = lambda p: F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int")
    return rows.withColumn("x", F.concat(*[F.get(F.get(table, F.lit(p)), at(p)) for p in range(len(books))]))


def digest(books: list[list[list[int]]]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()


def with_sums_by_label(rows: DataFrame) -> DataFrame:
    """rows(label, error) with label_error, the sum of error over rows of an equal label, nulls together; null where a long can't hold it or one of the errors.

    Frequent labels, of which there can be no more than HOT_LABELS, are joined by
    broadcast; only rows of rarer ones are shuffled by label.
    """
    sums = materialize(rows.groupBy("label").agg(F.when(F.count("error") == F.count("*"), F.try_sum("error")).alias("label_error"), F.count("*").alias("n")), "label-errors")
    enough = (sums.agg(F.sum("n")).first()[0] or 0) / HOT_LABELS
    hot = sums.where(F.col("n") >= enough).select(F.col("label").alias("of"), "label_error", F.lit(True).alias("hot"))
    near = rows.join(F.broadcast(hot), F.col("label").eqNullSafe(F.col("of")), "left").drop("of")
    rare = sums.where(F.col("n") < enough).select("label", "label_error")  # a label's null is one label: it may be rare too
    far = near.where("hot is null").drop("label_error", "hot")
    joined = far.join(rare.withColumnRenamed("label", "of"), F.col("label").eqNullSafe(F.col("of"))).drop("of")
    return near.where("hot").drop("hot").unionByName(joined)


def compress(rows: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and the digest of all codebooks, for each row of rows(vec_id, embedding, label) with a sound embedding.

    Rows without one go (null, without entries, or with null, NaN or infinite ones);
    repeated rows stay, each with its code; an empty table gives no rows. Other columns are
    not looked at.
    """
    kept = materialize(integers(rows, SCALE, F.col("vec_id").cast("long").alias("vec_id"), "label"), "code-vectors")
    books = fit(kept, parts=parts, entries=entries, rounds=rounds)
    if not books:
        return kept.selectExpr("vec_id", "'' code", "0L error", "0L label_error", "'' codebooks_sha256")
    coded = materialize(encode(kept, books, "vec_id", "label"), "codes")
    return with_sums_by_label(coded).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    out = [
        """kept as materialized (
  select row_number() over (order by vec_id nulls last, x) - 1 as row, * from (
    select vec_id, label, list_transform(embedding, lambda c: cast(floor(4096 * cast(c as double)) as bigint)) as x
    from embeddings where len(embedding) > 0 and len(list_filter(embedding, lambda c: c is null or isnan(c) or isinf(c))) = 0)),
cells as materialized (
  select row, (i - 1) // (len(x) // 8) as part, (i - 1) % (len(x) // 8) as place, x[i] as v
  from (select row, x, unnest(range(1, len(x) + 1)) as i from kept)),
book0 as materialized (select part, row as entry, place, v from cells where row < 16)"""
    ]
    for r in range(ROUNDS + 1):
        out.append(f"""near{r} as materialized (
  select row, part, min(d * 256 + entry) % 256 as entry, min(d) as d from (
    select c.row, c.part, b.entry, cast(sum((c.v - b.v) * (c.v - b.v)) as bigint) as d
    from cells c join book{r} b on c.part = b.part and c.place = b.place group by c.row, c.part, b.entry)
  group by row, part)""")
        if r < ROUNDS:
            out.append(f"""book{r + 1} as materialized (
  select b.part, b.entry, b.place, case when m.n is null then b.v else (m.s - ((m.s % m.n) + m.n) % m.n) // m.n end as v
  from book{r} b left join (
    select c.part, a.entry, c.place, cast(sum(c.v) as bigint) as s, count(*) as n
    from cells c join near{r} a on c.row = a.row and c.part = a.part group by c.part, a.entry, c.place) m
  on b.part = m.part and b.entry = m.entry and b.place = m.place)""")
    return (
        "with "
        + ",\n".join(out)
        + f""",
codes as (select row, string_agg(printf('%02x', cast(entry as integer)), '' order by part) as code, cast(sum(d) as bigint) as error from near{ROUNDS} group by row)
select k.vec_id, c.code, c.error, cast(sum(c.error) over (partition by k.label) as bigint) as label_error,
  sha256((select string_agg(cast(v as varchar), ',' order by part, entry, place) from book{ROUNDS})) as codebooks_sha256
from kept k join codes c on k.row = c.row"""
    )


ORACLE = _oracle()
