"""Tables written once in the folder that driver and executors share, and read again: what follows doesn't compute them anew."""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LOCAL_DIR = "/tmp/checkpoints"
_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where none is set and all run on one machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or _LOCAL_DIR).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/frametide-{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and a lost executor costs nothing that was written."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, order: str, size: str | None = None) -> DataFrame:
    """rows with _n, their place by a column without repeats, from 0, and _before, the sum of size over the rows before.

    Rows are dealt out by ranges of order and written with their range's number; each range's count
    and sum, a row a range, give where it begins; places within a range are counted in parallel.
    """
    size_of = F.col(size).cast("long") if size else F.lit(1).cast("long")
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = staged(rows.repartitionByRange(parts, order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = sorted((r["_range"], r["n"], r["s"]) for r in dealt.groupBy("_range").agg(F.count("*").alias("n"), F.sum(size_of).alias("s")).collect())
    starts, n, s = [], 0, 0
    for part, count, total in totals:
        starts.append((part, n, s))
        n, s = n + count, s + (total or 0)
    begun = F.broadcast(spark.createDataFrame(starts, "_range int, _start long, _sum long"))  # a row a range
    within = Window.partitionBy("_range").orderBy(order)
    out = dealt.join(begun, "_range")
    before = F.coalesce(F.sum(size_of).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return out.withColumns({"_n": F.col("_start") + F.row_number().over(within) - 1, "_before": F.col("_sum") + before}).drop("_range", "_start", "_sum")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table of new_path."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def clean() -> None:
    """Removes what was written so far."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            remove(spark, path)
        except Exception:  # the session has ended: the shared folder's owner cleans up
            return


atexit.register(clean)
