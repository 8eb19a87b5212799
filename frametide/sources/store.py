"""The query store: embedded query clips in shards, each one committed write; what is done isn't done again.

Layout: root/shards/shard-<name>-<writer> with Parquet of STORED, root/failures likewise with
(query_id, error), root/meta.json. A shard is there when root/shards/commits/<name>.json, which
names its folder, is: that file is created in one step, so readers see whole
shards only, and of several writers of a name one succeeds.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate
from .library import LibraryError, _create, _files

STORED = "query_id string, q_idx int, q_t float, vector array<float>, decode_ms double, embed_ms double"
FAILURES = "query_id string, error string"


class QueryStore:
    def __init__(self, spark: SparkSession, root: str, embedder: str, dim: int, answer_key: str | None = None):
        """Opens or creates; a store of another embedder, dimension or answer key (its digest) is refused."""
        self.spark, self.root, self.embedder, self.dim = spark, root.rstrip("/"), embedder, dim
        meta = {"embedder": embedder, "dim": dim, "answer_key": answer_key}
        fs, path = _files(spark, f"{self.root}/meta.json")
        if fs.exists(path):
            held = json.loads("".join(r["value"] for r in spark.read.text(str(path)).collect()))
            if held != meta:
                raise LibraryError(f"store of {held}, not {meta}")
        else:
            stream = fs.create(path, False)
            stream.write(bytearray(json.dumps(meta).encode()))
            stream.close()

    def _read(self, kind: str, schema: str) -> DataFrame:
        fs, path = _files(self.spark, f"{self.root}/{kind}/commits")
        names = sorted(str(s.getPath()) for s in fs.listStatus(path) if s.getPath().getName().endswith(".json")) if fs.exists(path) else []
        folders = [r["value"] for r in self.spark.read.text(names).collect()] if names else []  # a line a shard
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{kind}/{json.loads(f)['folder']}" for f in sorted(folders)]) if folders else self.spark.createDataFrame([], schema)

    def load(self) -> DataFrame:
        """All shards as one table."""
        return self._read("shards", STORED)

    def failures(self) -> DataFrame:
        return self._read("failures", FAILURES)

    def append(self, vectors: DataFrame, name: str, failures: DataFrame | None = None) -> bool:
        """Adds a shard; False, and nothing is written, where there is one of that name."""
        rows = vectors.select(*[F.col(c.split()[0]) if c.split()[0] in vectors.columns else F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in STORED.split(", ")])
        if failures is not None:
            self._commit(failures.select("query_id", "error"), "failures", name)
        return self._commit(rows, "shards", name)

    def _commit(self, rows: DataFrame, kind: str, name: str) -> bool:
        fs, done = _files(self.spark, f"{self.root}/{kind}/commits/{name}.json")
        if fs.exists(done):
            return False
        folder = f"shard-{name}-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(f"{self.root}/{kind}/{folder}")
        if _create(self.spark, str(done), json.dumps({"folder": folder})):
            return True
        fs.delete(_files(self.spark, f"{self.root}/{kind}/{folder}")[1], True)
        return False

    def todo(self, specs: DataFrame, limit: int | None = None) -> DataFrame:
        """Queries neither stored nor failed; the first ones by id where there is a limit."""
        rest = evaluate.missing(specs, self.load(), self.failures())
        return rest if limit is None else rest.orderBy("query_id").limit(limit)

    def present(self, specs: DataFrame, allow_partial: bool = False) -> DataFrame:
        """Specs that are stored; with queries neither stored nor failed it is an error unless allow_partial."""
        rest = self.todo(specs)
        if not allow_partial and not rest.isEmpty():
            raise LibraryError(f"{rest.count()} queries are missing, for example {rest.orderBy('query_id').first()['query_id']}")
        return specs.join(self.load().select("query_id").distinct(), "query_id", "left_semi")

    def status(self, specs: DataFrame) -> DataFrame:
        """(embedder, done, failed, todo)."""
        return progress(specs.withColumn("embedder", F.lit(self.embedder)), self.load(), self.failures(), "embedder")

    def embed(self, specs: DataFrame, make: Callable[[DataFrame], tuple[DataFrame, DataFrame]], name: str, limit: int | None = None) -> bool:
        """One resumable step: make(todo) gives vectors and failures, which become a shard."""
        vectors, failures = make(self.todo(specs, limit))
        return self.append(vectors, name, failures)


def progress(specs: DataFrame, stored: DataFrame, failures: DataFrame, *by: str, key: str = "query_id") -> DataFrame:
    """(by, n, done, failed, todo): counts of specs by what is stored, failed and to do."""
    done = stored.select(key).distinct().withColumn("_done", F.lit(True))
    bad = failures.select(key).distinct().withColumn("_bad", F.lit(True))
    met = specs.join(done, key, "left").join(bad, key, "left")
    return met.groupBy(*by).agg(
        F.count("*").alias("n"), F.count("_done").alias("done"), F.count(F.when(F.col("_done").isNull() & F.col("_bad").isNotNull(), 1)).alias("failed"), F.count(F.when(F.col("_done").isNull() & F.col("_bad").isNull(), 1)).alias("todo"))


def shard_starts(rows: DataFrame, group: str, order: str, size) -> DataFrame:
    """rows with start: how many elements of the group come before, a running sum that leaves out the row itself; null in front."""
    from pyspark.sql import Window

    return rows.withColumn("start", F.sum(size).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)))
