"""From clips' frames to answers: search, decide, shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.columns import rounded
from ..sources.library import Library
from ..staging import staged
from . import aligned, search, voting


def decide(hits: DataFrame, clips: DataFrame, settings: Settings) -> DataFrame:
    if settings.algorithm == "v1":
        return voting.decide(hits, clips, min_conf=settings.v1_min_conf, min_vote_ratio=settings.v1_min_vote_ratio)
    return aligned.decide(hits, clips, min_score=settings.v2_min_score, max_ratio=settings.v2_max_ratio, tolerance=settings.v2_tolerance_s)


def results(decisions: DataFrame, videos: DataFrame, algorithm: str, embedder: str) -> DataFrame:
    """Public answers: rounded; id, offset and window only where accepted; the candidate always."""
    named = decisions.join(videos.select(F.col("key").alias("candidate_key"), F.col("video_id").alias("_id")), "candidate_key", "left")
    ok = F.col("accepted")
    features = ("base_conf", "align_ratio", "vote_ratio", "est_timestamp") if algorithm == "v1" else ("runner_up", "ratio", "coverage", "offset_spread_s")
    evidence = F.transform("evidence", lambda e: F.struct(rounded(e["query_t"], 3).alias("query_t"), rounded(e["ref_t"], 3).alias("ref_t"), rounded(e["score"], 4).alias("score")))
    return named.select(
        "clip_id", F.when(ok, "match").otherwise("unknown").alias("status"), F.when(ok, F.col("_id")).alias("video_id"), rounded(F.col("confidence"), 4).alias("confidence"), F.when(ok, rounded(F.col("offset_s"), 3)).alias("offset_s"),
        F.when(ok, F.struct(F.col("window_start").alias("start"), F.col("window_end").alias("end"))).alias("ref_window"),
        F.when(F.col("_id").isNotNull(), F.struct(F.col("_id").alias("video_id"), rounded(F.col("offset_s"), 3).alias("offset_s"))).alias("candidate"), "reason", "votes", evidence.alias("evidence"),
        F.struct(*[rounded(F.col(c).cast("double"), 4).alias(c) for c in features]).alias("diagnostics"), F.lit(algorithm).alias("algorithm"), F.lit(embedder).alias("embedder"), F.col("n_frames").cast("int").alias("n_query_frames"),
    )


def match(q_frames: DataFrame, library: Library, settings: Settings | None = None, embedder: str | None = None) -> DataFrame:
    """Answers for all clips of q_frames(clip_id, q_idx, q_t, vector); another embedder than the library's is refused."""
    settings = settings or Settings()
    if embedder is not None and embedder != library.embedder:
        raise ValueError(f"clips of {embedder}, library of {library.embedder}")
    hits = staged(search.topk(q_frames, library.vectors, settings.top_k, library.dim), "hits")  # the rule reads them several times
    clips = q_frames.groupBy(F.col("clip_id").cast("string").alias("clip_id")).agg(F.count("*").alias("n_frames"))
    return results(decide(hits, clips, settings), library.videos, settings.algorithm, library.embedder)
