"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on its factor.

The table is read in passes that leave numbers a dimension behind (sums), then
numbers a pair of dimensions (centred products); tasks add up their own rows
first. From these the factor and its rotation are found on the driver, in time
and memory that depend on the number of dimensions alone, and the rows are
projected where they are. Entries are integers, so counts, sums and deviations
are exact; entries are centred before they are multiplied.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, materialize

SCALE = 256
COMPONENTS = 4
_LONG = 1 << 63
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def integers(rows: DataFrame, scale: int, *others: str) -> DataFrame:
    """others, and x array<long>: floor(scale * entry) of each embedding.

    Rows whose embedding is null, has no entries, or holds null, NaN or infinite
    ones go. An entry too large for a long becomes the nearest long.
    """
    sound = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return rows.where(sound).select(*others, F.transform("embedding", lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long")).alias("x"))


def width(rows: DataFrame) -> int:
    """How many entries every x has; 0 if there is no row."""
    least, most = rows.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if least != most:
        raise ValueError(f"embeddings of {least} and of {most} entries in one table")
    return least or 0


def matrix(column: pa.ListArray, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def largest(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def pivoted_cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower factor and order with v[order][:, order] = factor @ factor.T, the largest rest first; a column for each rank."""
    v, d = v.astype(float).copy(), len(v)
    order, factor = np.arange(d), np.zeros((d, d))
    rest = v.diagonal().copy()
    limit = d * np.finfo(float).eps * max(rest.max(initial=0.0), 0.0)
    for k in range(d):
        at = k + int(np.argmax(rest[order[k:]]))
        if rest[order[at]] <= limit:
            return factor[:, :k], order
        order[[k, at]], factor[[k, at]] = order[[at, k]], factor[[at, k]]
        top = np.sqrt(rest[order[k]])
        factor[k, k] = top
        below = order[k + 1 :]
        factor[k + 1 :, k] = (v[below, order[k]] - factor[k + 1 :, :k] @ factor[k, :k]) / top
        rest[below] -= factor[k + 1 :, k] ** 2
    return factor, order


def jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """factor's columns, rotated in pairs until each two are orthogonal to double precision.

    Pairs that share no column are rotated at once, in the order of a round-robin
    tournament: all pairs meet once a sweep.
    """
    a, r = factor.copy(), factor.shape[1]
    seats = np.append(np.arange(r), [-1] * (r % 2)).astype(int)
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(seats) - 1):
            one, two = seats[: len(seats) // 2], seats[len(seats) // 2 :][::-1]
            both = (one >= 0) & (two >= 0)
            p, q = one[both], two[both]
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            size = np.sqrt(xx * yy)
            off = np.abs(xy) / np.where(size > 0, size, 1)
            worst = max(worst, off.max(initial=0.0))
            turn = off > np.finfo(float).eps
            zeta = (yy - xx) / (2 * np.where(turn, xy, 1))
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            c = np.where(turn, 1 / np.hypot(1, t), 1.0)
            s = np.where(turn, c * t, 0.0)
            a[:, p], a[:, q] = c * x - s * y, s * x + c * y
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if worst <= len(a) * np.finfo(float).eps:
            break
    return a


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues above zero, falling, and their unit eigenvectors as columns; of each the largest entry is positive."""
    factor, order = pivoted_cholesky(v)
    turned = np.empty_like(factor)
    turned[order] = jacobi(factor)
    values = (turned**2).sum(0)
    by = np.argsort(-values, kind="stable")
    values, turned = values[by], turned[:, by] / np.sqrt(values[by])
    signs = np.sign(turned[np.abs(turned).argmax(0), np.arange(len(by))]) if len(by) else np.ones(0)
    return values, turned * signs


@dataclass(frozen=True)
class Whitening:
    """What fit found: n distinct vectors with sums by dimension, eigenvalues and components (columns) of their covariance."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x minus the mean: the mean's whole part as an integer first, so that large offsets cost no digits."""
        whole = [s // self.n for s in self.sums]
        part = np.array([(s - w * self.n) / self.n for s, w in zip(self.sums, whole, strict=True)])
        if largest(x) + max(map(abs, whole), default=0) < _LONG:
            return (x - np.array(whole, np.int64)).astype(float) - part
        return (x.astype(object) - np.array(whole, object)).astype(float) - part

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n * x - sums) ** 2, exact; None beyond a long."""
        if len(self.sums) * (self.n * largest(x) + max(map(abs, self.sums))) ** 2 < _LONG:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(1).tolist()
        found = ((self.n * x.astype(object) - np.array(self.sums, object)) ** 2).sum(1).tolist()
        return [f if f < _LONG else None for f in found]

    def project(self, x: np.ndarray, k: int) -> np.ndarray:
        return self.centred(x) @ (self.components[:, :k] / np.sqrt(self.values[:k]))


def _sums(vectors: DataFrame, d: int) -> tuple[int, tuple[int, ...]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * d
        for batch in batches:
            x = matrix(batch.column(0), d)
            n += len(x)
            more = x.sum(0).tolist() if largest(x) * len(x) < _LONG else x.astype(object).sum(0).tolist()
            sums = [a + b for a, b in zip(sums, more, strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(map(str, sums), pa.string())], names=["i", "n", "total"])

    found = vectors.transform(mapped, run, "i int, n long, total string").groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("i").collect()
    return found[0]["n"], tuple(int(r["total"]) for r in found)


def _products(vectors: DataFrame, d: int, of, k: int) -> np.ndarray:
    """Sums of w and of its products with itself over all rows, for w = of(x) of k numbers: (k + 1) x k, the sums last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = of(matrix(batch.column(0), d))
            total[:k] += w.T @ w
            total[k] += w.sum(0)
        i, j = np.nonzero(np.tril(np.ones((k + 1, k))))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j], pa.float64())], names=["i", "j", "total"])

    out = np.zeros((k + 1, k))
    for i, j, total in vectors.transform(mapped, run, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total")).collect():
        out[i, j] = total
        if i < k:
            out[j, i] = total
    return out


def fit(rows: DataFrame, *, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct integer vectors of rows(embedding); None if there is none.

    Equal vectors count once, however many rows have them. What reaches the driver
    are (dimensions + 1) ** 2 / 2 sums. identity_error is that of the first components.
    """
    vectors = materialize(integers(rows, SCALE).distinct(), "fit-vectors")
    d = width(vectors)
    if not d:
        return None
    n, sums = _sums(vectors, d)
    start = Whitening(n, sums, np.zeros(0), np.zeros((d, 0)), 0.0)
    v = _products(vectors, d, start.centred, d)[:d] / n
    values, axes = eigen(v)
    k = min(components, len(values))
    made = Whitening(n, sums, values, axes, float(v.trace()))
    if not k:
        return made
    seen = _products(vectors, d, lambda x: made.project(x, k), k)
    mean = seen[k] / n  # nothing but rounding, as w is centred already
    error = float(np.abs(seen[:k] / n - np.outer(mean, mean) - np.eye(k)).max())
    return Whitening(n, sums, values, axes, made.trace, error)


def whiten(rows: DataFrame, model: Whitening | None, *, components: int = COMPONENTS) -> DataFrame:
    """A row for each row of rows(vec_id, embedding) and component, up to components, where the covariance has so many eigenvalues above zero.

    Rows without a sound embedding give none; repeated rows and null ids give theirs
    each; a table of one distinct vector, or an empty one, gives no row. deviation is
    null where a long can't hold it. Other columns are not looked at.
    """
    kept = integers(rows, SCALE, F.col("vec_id").cast("long").alias("vec_id"))
    if model is None or not len(model.values):
        return kept.where("false").selectExpr(*[f"cast(null as {kind}) {name}" for name, kind in (x.split() for x in SCHEMA.split(", "))])
    k, d = min(components, len(model.values)), len(model.sums)
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), d)
            rows_, n = np.repeat(np.arange(len(x)), k), len(x) * k
            columns = [
                batch.column(0).take(pa.array(rows_)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(n, model.n)),
                pa.array(model.deviations(x), pa.int64()).take(pa.array(rows_)),
                pa.array(model.project(x, k).ravel()),
                pa.array(np.tile(model.values[:k] / model.trace, len(x))),
                pa.array(np.full(n, model.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return kept.transform(mapped, run, SCHEMA)


#: What SQL can say of the query: rows, counts and deviations; four components, as any table of five vectors in general position has.
BASE_ORACLE = """
with kept as (
  select vec_id, list_transform(embedding, lambda c: cast(floor(256 * cast(c as double)) as bigint)) as x
  from embeddings where len(embedding) > 0 and len(list_filter(embedding, lambda c: c is null or isnan(c) or isinf(c))) = 0),
fit as (select distinct x from kept),
sums as (select i, count(*) as n, sum(x[i]) as s from (select x, unnest(range(1, len(x) + 1)) as i from fit) group by i),
lists as (select max(n) as n, list(s order by i) as s from sums)
select vec_id, cast(component as integer) as component, cast(n as bigint) as n,
  cast(list_sum(list_transform(range(1, len(x) + 1), lambda i: (n * x[i] - s[i]) * (n * x[i] - s[i]))) as bigint) as deviation
from kept, lists, range(1, 5) c(component)
"""
