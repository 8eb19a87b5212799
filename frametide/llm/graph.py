"""Connected components of an edge table, and streams of sorted groups."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

ROUNDS = 40


class Forest:
    """Union-find over any hashable values; the root is the least member."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        top = x
        while (y := self.up.get(top, top)) != top:
            top = y
        while x != top:
            self.up[x], x = top, self.up.get(x, x)
        return top

    def join(self, a, b) -> bool:
        """Whether a and b were apart."""
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.up[b] = a
        return True


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b); root is the least node that can be reached.

    Alternating large and small stars, each written to the shared folder; the
    number of edges never grows. Only counts reach the driver. Nulls aren't nodes.
    """
    stars = materialize(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if stars.isEmpty():
        return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    before = None
    for _ in range(ROUNDS):
        both = stars.union(stars.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.where("m < a").select("a", F.col("m"))).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a > b").distinct()
        stars = materialize(small, "edges")
        # all is done when each node has one parent and no parent has one
        now = stars.agg(F.count("*"), F.countDistinct("a"), F.sum(F.hash("a", "b").cast("long"))).first()
        if now == before and now[0] == now[1] and stars.join(stars.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty():
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(stars.select("b", "b").distinct())


def small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices of few rows, so that what Python makes of wide rows stays small."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, list]]:
    """Rows that follow each other with equal keys, as lists by column; one group is held at a time."""
    held: dict[str, list] | None = None
    last = None
    for batch in small(batches):
        names = batch.schema.names
        columns = [c.to_pylist() for c in batch.columns]
        where = [names.index(k) for k in keys]
        for row in zip(*columns, strict=True):
            key = tuple(row[i] for i in where)
            if key != last:
                if held is not None:
                    yield held
                held, last = {n: [] for n in names}, key
            for n, x in zip(names, row, strict=True):
                held[n].append(x)
    if held is not None:
        yield held
