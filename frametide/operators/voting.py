"""Decision rule v1: every neighbour is a vote, then an offset histogram of the winner's hits.

Offsets, estimated times and top-1 scores are single precision where the rule
says so. Too few inliers fall back to all hits, with an align ratio of 1: the rule's known
flaw, kept. Score sums are compared after rounding to 9 digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clipped, rounded

WINDOW_S, BIN_S, INLIER_S, STRONG = 6.0, 0.5, 0.75, 0.90


def gate(confidence: Column, vote_ratio: Column, min_conf, min_vote_ratio) -> Column:
    return F.coalesce((confidence >= min_conf) & (vote_ratio >= min_vote_ratio), F.lit(False))


def votes(hits: DataFrame) -> DataFrame:
    """(clip_id, key, votes, score_sum, first): per video over all hits; first is where it is first seen."""
    place = F.struct("q_idx", "rank")
    return hits.where("key >= 0").groupBy("clip_id", "key").agg(F.count("*").alias("votes"), F.round(F.sum(F.col("score").cast("double")), 9).alias("score_sum"), F.min(place).alias("first"))


def winner(counted: DataFrame) -> DataFrame:
    """(clip_id, key, vote_ratio): most votes, then score, then first seen."""
    order = Window.partitionBy("clip_id").orderBy(F.desc("votes"), F.desc("score_sum"), "first")
    every = Window.partitionBy("clip_id")
    return counted.withColumns({"n": F.row_number().over(order), "vote_ratio": F.col("votes") / F.sum("votes").over(every)}).where("n = 1").select("clip_id", "key", "vote_ratio")


def winner_hits(hits: DataFrame, won: DataFrame) -> DataFrame:
    """The winner's hits with pos, their place by score in stable order, and off32 and bin."""
    order = Window.partitionBy("clip_id").orderBy(F.desc("score"), "q_idx", "rank")
    off = F.col("ref_t").cast("double") - F.col("q_t").cast("double")
    return hits.join(won.select("clip_id", "key"), ["clip_id", "key"]).withColumns({"pos": F.row_number().over(order), "off": off, "off32": off.cast("float")}).withColumn("bin", F.floor(F.col("off32").cast("double") / BIN_S))


def base_confidence(own: DataFrame) -> DataFrame:
    top = own.where("rank = 0")
    strong = F.avg((F.col("score").cast("float") >= F.lit(STRONG).cast("float")).cast("double"))
    return top.groupBy("clip_id").agg((0.7 * F.avg(F.col("score").cast("float").cast("double")) + 0.3 * strong).alias("base_conf"))


def histogram_mode(own: DataFrame) -> DataFrame:
    """(clip_id, best_offset): centre of the fullest bin; equals go to the bin of the better hit."""
    order = Window.partitionBy("clip_id").orderBy(F.desc("n"), "first")
    bins = own.groupBy("clip_id", "bin").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    return bins.withColumn("r", F.row_number().over(order)).where("r = 1").select("clip_id", ((F.col("bin") + 0.5) * BIN_S).alias("best_offset"))


def inliers(own: DataFrame, mode: DataFrame) -> DataFrame:
    """Hits near the offset, or all where these are too few; with n_hits, n_used, aligned."""
    every = Window.partitionBy("clip_id")
    near = F.abs(F.col("off") - F.col("best_offset")) <= INLIER_S
    counted = own.join(mode, "clip_id").withColumns({"near": near, "n_hits": F.count("*").over(every), "n_near": F.sum(near.cast("int")).over(every)})
    enough = F.col("n_near") >= F.greatest(F.lit(5), F.floor(0.3 * F.col("n_hits")))
    return counted.withColumn("aligned", enough).where("near or not aligned").withColumns({"time32": (F.col("q_t").cast("double") + F.col("best_offset")).cast("float"), "n_used": F.when(F.col("aligned"), F.col("n_near")).otherwise(F.col("n_hits"))})


def densest_window(used: DataFrame, seconds: float = WINDOW_S) -> DataFrame:
    """(clip_id, window_start, window_end): most times, then score, then the earliest."""
    t = F.col("time32").cast("double")
    span = f"over (partition by clip_id order by t range between current row and {float(seconds)}D following)"
    order = Window.partitionBy("clip_id").orderBy(F.desc("n"), F.desc("total"), "t")
    held = used.withColumn("t", t).withColumns({"n": F.expr(f"count(*) {span}"), "total": F.expr(f"round(sum(cast(score as double)) {span}, 9)"), "end": F.expr(f"max(t) {span}")})
    return held.withColumn("r", F.row_number().over(order)).where("r = 1").select("clip_id", rounded(F.col("t"), 2).alias("window_start"), rounded(F.col("end"), 2).alias("window_end"))


def evidence(own: DataFrame) -> DataFrame:
    """The first 10 hits by score with distinct reference times (2 digits)."""
    ref = rounded(F.col("ref_t").cast("double"), 2)
    once = Window.partitionBy("clip_id", "ref").orderBy("pos")
    order = Window.partitionBy("clip_id").orderBy("pos")
    kept = own.withColumn("ref", ref).withColumn("n", F.row_number().over(once)).where("n = 1").withColumn("m", F.row_number().over(order)).where("m <= 10")
    rows = F.sort_array(F.collect_list(F.struct("m", F.col("q_t").cast("double").alias("query_t"), F.col("ref_t").cast("double").alias("ref_t"), F.col("score").cast("double").alias("score"))))
    return kept.groupBy("clip_id").agg(F.transform(rows, lambda x: F.struct(x["query_t"].alias("query_t"), x["ref_t"].alias("ref_t"), x["score"].alias("score"))).alias("evidence"))


def decide(hits: DataFrame, clips: DataFrame, *, min_conf: float = 0.83, min_vote_ratio: float = 0.90) -> DataFrame:
    """One row per clip: accepted, candidate_key, confidence, offset_s, window_start, window_end, reason, base_conf, align_ratio, aligned, vote_ratio, est_timestamp, evidence.

    The steps above in one pass: hits are dealt out by clip once, the winner's hits
    come out of one aggregate, and every later step is a window or an aggregate
    within the clip, so that nothing is joined again or dealt out anew.
    """
    f32 = lambda c: c.cast("float").cast("double")
    hit = F.struct((-F.col("score").cast("double")).alias("neg"), "q_idx", "rank", F.col("ref_t").cast("double").alias("ref_t"), F.col("q_t").cast("double").alias("q_t"))
    dealt = hits.where("key >= 0").repartition("clip_id")
    counted = dealt.groupBy("clip_id", "key").agg(F.count("*").alias("votes"), F.round(F.sum(F.col("score").cast("double")), 9).alias("score_sum"), F.min(F.struct("q_idx", "rank")).alias("first"), F.collect_list(hit).alias("own"))
    order = F.struct((-F.col("votes")).alias("a"), (-F.col("score_sum")).alias("b"), "first", "key")
    each = counted.groupBy("clip_id").agg(
        F.min_by(F.struct("key", "votes", "own"), order).alias("won"), F.sum("votes").alias("every"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", F.col("votes").cast("int").alias("n"))))).alias("tally"))
    told = each.select("clip_id", F.col("won.key").alias("key"), (F.col("won.votes") / F.col("every")).alias("vote_ratio"), "tally", F.posexplode(F.sort_array("won.own")).alias("pos", "h"))
    clip, off = Window.partitionBy("clip_id"), F.col("h.ref_t") - F.col("h.q_t")
    rows = told.select("clip_id", "key", "vote_ratio", "tally", (F.col("pos") + 1).alias("pos"), (-F.col("h.neg")).alias("score"), F.col("h.rank").alias("rank"), F.col("h.q_t").alias("q_t"), F.col("h.ref_t").alias("ref_t"), off.alias("off")).withColumn("bin", F.floor(f32(F.col("off")) / BIN_S))
    by_bin = Window.partitionBy("clip_id", "bin")
    rows = rows.withColumns({"_n": F.count("*").over(by_bin), "_p": F.min("pos").over(by_bin)})
    rows = rows.withColumn("best_offset", (F.max(F.struct("_n", (-F.col("_p")).alias("p"), "bin")).over(clip)["bin"] + 0.5) * BIN_S)
    near = F.abs(F.col("off") - F.col("best_offset")) <= INLIER_S
    rows = rows.withColumns({"near": near, "n_hits": F.count("*").over(clip), "n_near": F.sum(near.cast("int")).over(clip)})
    rows = rows.withColumn("aligned", F.col("n_near") >= F.greatest(F.lit(5), F.floor(0.3 * F.col("n_hits"))))
    rows = rows.withColumns({"used": F.col("near") | ~F.col("aligned"), "t": f32(F.col("q_t") + F.col("best_offset")), "ref": rounded(F.col("ref_t"), 2)})
    span = f"over (partition by clip_id order by t range between current row and {WINDOW_S}D following)"
    rows = rows.withColumns({"_in": F.expr(f"count_if(used) {span}"), "_total": F.expr(f"round(sum(if(used, score, 0D)) {span}, 9)"), "_end": F.expr(f"max(if(used, t, null)) {span}")})
    rows = rows.withColumn("_once", F.row_number().over(Window.partitionBy("clip_id", "ref").orderBy("pos")))
    best = F.max(F.when(F.col("used"), F.struct("_in", "_total", (-F.col("t")).alias("neg"), "_end")))
    w = F.greatest(f32(F.col("score")), F.lit(1e-6))
    used, top = lambda x: F.sum(F.when(F.col("used"), x)), lambda x: F.avg(F.when(F.col("rank") == 0, x))
    shown = F.slice(F.sort_array(F.collect_list(F.when(F.col("_once") == 1, F.struct("pos", F.col("q_t").alias("query_t"), "ref_t", "score")))), 1, 10)
    shape = rows.groupBy("clip_id").agg(
        F.first("key").alias("key"), F.first("vote_ratio").alias("vote_ratio"), F.first("tally").alias("votes"), F.first("best_offset").alias("offset_s"), F.first("aligned").alias("aligned"),
        (F.first(F.when(F.col("aligned"), F.col("n_near")).otherwise(F.col("n_hits"))) / F.first("n_hits")).alias("align_ratio"), rounded(used(F.col("t") * w) / used(w), 2).alias("est_timestamp"), best.alias("window"),
        F.coalesce(0.7 * top(f32(F.col("score"))) + 0.3 * top((F.col("score").cast("float") >= F.lit(STRONG).cast("float")).cast("double")), F.lit(0.0)).alias("base_conf"),
        F.transform(shown, lambda x: F.struct(x["query_t"].alias("query_t"), x["ref_t"].alias("ref_t"), x["score"].alias("score"))).alias("evidence"))
    out = clips.join(shape, "clip_id", "left")
    confidence = F.coalesce(rounded(clipped(0.6 * F.col("base_conf") + 0.4 * F.col("align_ratio")), 4), F.lit(0.0))
    accepted = gate(confidence, F.col("vote_ratio"), min_conf, min_vote_ratio)
    return out.select(
        "clip_id", "n_frames", accepted.alias("accepted"), F.col("key").alias("candidate_key"), confidence.alias("confidence"), "offset_s", rounded(-F.col("window.neg"), 2).alias("window_start"), rounded(F.col("window._end"), 2).alias("window_end"),
        F.when(F.col("key").isNull(), "no_candidates").when(~accepted, "below_threshold").alias("reason"), "base_conf", "align_ratio", "aligned", "vote_ratio", "est_timestamp", "votes", "evidence",
    )
