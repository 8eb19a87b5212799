"""Indexing a batch of videos: probe, hash, look for duplicates, embed, then one change of the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.columns import is_video_id, now_utc, video_id_of
from ..sources import videos
from ..sources.library import Library
from ..staging import staged
from . import embedders


def content_duplicates(rows: DataFrame, identity: str, digest: str) -> DataFrame:
    """(identity, other): of rows that share a digest, the least other identity: from the two least of each digest, so that no group is squared."""
    two = rows.groupBy(digest).agg(F.min(identity).alias("_a"), F.max(identity).alias("_z")).where("_a <> _z")
    again = rows.join(two, digest)
    second = again.where(F.col(identity) > F.col("_a")).groupBy(digest).agg(F.min(identity).alias("_b"))
    return again.join(second, digest).select(identity, F.when(F.col(identity) == F.col("_a"), F.col("_b")).otherwise(F.col("_a")).alias("other")).distinct()


def digests(rows: DataFrame, content: str = "content") -> DataFrame:
    """rows with sha256 and md5 of their content."""
    return rows.withColumns({"sha256": F.sha2(F.col(content), 256), "md5": F.md5(F.col(content))})


def checked(rows: DataFrame, library: Library, replace: bool = False) -> DataFrame:
    """rows(path, content) with video_id (from the path where there is none), probe's columns, sha256 and error.

    Errors: what can't be opened; a bad id; an id or content that is in the
    library under another content or id (the same of both is up to date, not an error, and
    is told as 'exists' unless replace); an id or content that comes twice in the
    batch: of these the least path stays.
    """
    named = rows if "video_id" in rows.columns else rows.withColumn("video_id", video_id_of(F.col("path")))
    probed = videos.probe(digests(named), "video_id", "sha256")  # contents are read once
    known = library.videos.select("video_id", F.col("sha256").alias("_has"))
    same = library.videos.groupBy("sha256").agg(F.min("video_id").alias("_same"))
    met = probed.join(known, "video_id", "left").join(same, "sha256", "left")
    fine = F.col("error").isNull()
    by_id = Window.partitionBy("video_id", fine).orderBy("path")
    by_content = Window.partitionBy("sha256", fine).orderBy("path")
    numbered = met.withColumns({"_i": F.row_number().over(by_id), "_c": F.row_number().over(by_content)})
    error = F.coalesce(
        F.col("error"), F.when(~is_video_id(F.col("video_id")), "bad video id"), F.when(F.col("_i") > 1, "the id comes twice"), F.when(F.col("_c") > 1, "the content comes twice"),
        F.when(F.col("_same").isNotNull() & (F.col("_same") != F.col("video_id")), F.concat(F.lit("the same content is there as "), F.col("_same"))), F.when(F.col("_has").isNotNull() & F.lit(not replace), "exists"),
    )
    return numbered.withColumn("error", error).drop("_i", "_c", "_has", "_same")


def index(library: Library, rows: DataFrame, settings: Settings | None = None, *, replace: bool = False, indexed_at: str | None = None) -> tuple[Library, DataFrame]:
    """The library with the good ones of rows(path, content), and a report (path, video_id, n_vectors, duration_s, error).

    A bad file is a row with an error and stops no other. Nothing is changed
    before all is embedded; save() commits the batch at once.
    """
    settings = settings or Settings()
    judged = staged(checked(rows, library, replace), "probed")
    good = judged.where("error is null").select("path", "video_id", "duration_s", "sha256")
    frames = videos.sample(rows.join(good.select("path"), "path", "left_semi"), settings.index_fps, short_side=settings.frame_short_side)
    # one pass decodes, embeds and tells what can't be decoded
    both = staged(embedders.embed_or_tell(frames.withColumnRenamed("path", "video_id"), [library.embedder], settings.frame_short_side).withColumnRenamed("video_id", "path"), "embedded")
    vectors = both.where("error is null").select("path", "t", "vector")
    counts = vectors.groupBy("path").agg(F.count("*").alias("n_vectors"))
    failed = both.where("error is not null").groupBy("path").agg(F.min("error").alias("decode_error"))
    report = judged.join(failed, "path", "left").join(counts, "path", "left").select("path", "video_id", F.coalesce("n_vectors", F.lit(0)).alias("n_vectors"), "duration_s", F.coalesce("error", "decode_error", F.when(F.coalesce("n_vectors", F.lit(0)) == 0, "no frames")).alias("error"))
    kept = good.join(report.where("error is null").select("path"), "path", "left_semi")
    new = kept.select("video_id", F.col("path").alias("source_path"), "sha256", "duration_s", F.lit(float(settings.index_fps)).alias("sample_fps"), (F.lit(indexed_at) if indexed_at is not None else now_utc()).alias("indexed_at"))
    return library.add(new, vectors.join(kept.select("path", "video_id"), "path").select("video_id", "t", "vector"), replace=replace), report


def query_frames(rows: DataFrame, embedder: str, settings: Settings | None = None) -> tuple[DataFrame, DataFrame]:
    """q_frames(clip_id, q_idx, q_t, vector) of clips(path, content), by path, and failures (clip_id, error); decoded once, now."""
    settings = settings or Settings()
    frames = videos.sample(rows, settings.query_fps, short_side=settings.frame_short_side, max_frames=settings.query_max_frames, adaptive=True)
    both = staged(embedders.embed_or_tell(frames.withColumnRenamed("path", "video_id"), [embedder], settings.frame_short_side), "query-frames")
    order = Window.partitionBy("video_id").orderBy("t")
    out = both.where("error is null").select(F.col("video_id").alias("clip_id"), (F.row_number().over(order) - 1).alias("q_idx"), F.col("t").cast("float").alias("q_t"), "vector")
    return out, both.where("error is not null").select(F.col("video_id").alias("clip_id"), "error")
