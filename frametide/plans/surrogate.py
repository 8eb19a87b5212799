"""A library and query clips made of the embeddings table.

A video is a label, its frames the label's vectors at 2 frames a second. Labels
0 to 6 are indexed, the others held out. A clip is twelve consecutive frames of a
video (six at least), each blended with another vector by a strength.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import l2_normalize

STRENGTHS = (0.0, 0.6, 0.78, 0.85)
INDEXED, FRAMES, LEAST = 7, 12, 6


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select("vec_id", F.col("label").alias("key"), F.col("embedding").alias("vector"), (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).alias("rn"))


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).where(F.col("key") < INDEXED).select(F.col("vec_id").alias("vector_id"), "key", (F.col("rn") * 0.5).alias("t"), "vector")


def clips(spark: SparkSession, sf_dir: str, strengths: tuple[float, ...] = STRENGTHS) -> DataFrame:
    """q_frames(clip_id, q_idx, q_t, vector) with label, chunk and strength."""
    rows = frames(spark, sf_dir)
    n = rows.count()
    blended = rows.withColumn("other", (F.col("vec_id") + 37) % n).join(rows.select(F.col("vec_id").alias("other"), F.col("vector").alias("ov")), "other")
    held = blended.withColumns({"chunk": F.floor(F.col("rn") / FRAMES), "q_idx": (F.col("rn") % FRAMES).cast("int")}).withColumn("of", F.count("*").over(Window.partitionBy("key", "chunk"))).where(F.col("of") >= LEAST)
    each = held.withColumn("a", F.explode(F.array(*map(F.lit, strengths))))
    mixed = l2_normalize(F.zip_with("vector", "ov", lambda x, y: x.cast("double") + F.col("a") * y.cast("double")))
    return each.select(F.format_string("%d-%d-%s", "key", "chunk", F.col("a").cast("string")).alias("clip_id"), "q_idx", (F.col("q_idx") * 0.5).alias("q_t"), mixed.alias("vector"), F.col("key").alias("label"), "chunk", F.col("a").alias("strength"))


def clip_table(q: DataFrame) -> DataFrame:
    return q.groupBy("clip_id").agg(F.count("*").alias("n_frames"), F.first("label").alias("label"), F.first("chunk").alias("chunk"), F.first("strength").alias("strength"))
