"""Time-grid sampling and timestamp repair of frame tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-6


def grid_sample(frames: DataFrame, fps: float, max_frames: int | None = None, video: str = "video_id", t: str = "t") -> DataFrame:
    """The first decodable frame at or after each grid point 0, 1/fps, ...; at most max_frames of a video.

    In closed form the first row of each bucket floor((t + 1e-6) * fps). Frames
    that can't be decoded (column decodable, where there is one) use up no bucket.
    """
    rows = frames.where("decodable") if "decodable" in frames.columns else frames
    ties = [c for c in ("frame_idx",) if c in frames.columns]  # frames of equal times in their order
    first = Window.partitionBy(video, "bucket").orderBy(t, *ties)
    out = rows.withColumn("bucket", F.floor((F.col(t) + EPSILON) * fps)).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    if max_frames is not None:
        out = out.withColumn("_n", F.row_number().over(Window.partitionBy(video).orderBy(t, *ties))).where(F.col("_n") <= max_frames).drop("_n")
    return out


def repair_times(frames: DataFrame, fps: float = 30.0) -> DataFrame:
    """Adds t: pts where it is after the one before, else that plus 1/fps; the one before the first is -1.

    A recurrence: rows are sorted by video and frame within partitions, and a task carries each video's last time.
    """
    kind = frames.schema["pts"].dataType
    rows = frames.withColumn("t", F.lit(None).cast("double"))
    at = [rows.columns.index(c) for c in ("video_id", "pts", "t")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        video, before = None, -1.0
        for batch in batches:
            times = []
            for v, pts in zip(batch.column(at[0]).to_pylist(), batch.column(at[1]).to_pylist(), strict=True):
                if v != video:
                    video, before = v, -1.0
                before = float(pts) if pts is not None and pts > before else before + 1.0 / fps
                times.append(before)
            yield batch.set_column(at[2], batch.schema.field(at[2]), pa.array(times, pa.float64()))

    assert kind.typeName() in ("double", "float", "integer", "long"), kind
    parts = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "video_id").sortWithinPartitions("video_id", "frame_idx").mapInArrow(run, rows.schema)
