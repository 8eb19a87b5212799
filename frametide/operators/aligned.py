"""Decision rule v2: voting for one video at one time offset, as DataFrame algebra over many clips at once.

hits(clip_id, q_idx, q_t, rank, key, ref_t, score), clips(clip_id, n_frames). A
clip without hits is rejected with no_candidates. Where no aligned frame has a
positive score, the offset is null and the reason low_score. Sums are rounded to
9 digits before they are compared, so that the order of addition decides no tie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clipped, rounded

MAX_EVIDENCE = 10


def gate(confidence: Column, ratio: Column, min_score, max_ratio) -> Column:
    """Null features fail."""
    return F.coalesce((confidence >= min_score) & (ratio <= max_ratio), F.lit(False))


def offsets(hits: DataFrame) -> DataFrame:
    off = F.col("ref_t").cast("double") - F.col("q_t").cast("double")
    return hits.where("key >= 0").withColumns({"off": off, "s": clipped(F.col("score").cast("double")), "cand": rounded(off, 2)})


def candidates(hits: DataFrame) -> DataFrame:
    """Distinct offsets, to 2 digits, of each clip and video."""
    return offsets(hits).select("clip_id", "key", "cand").distinct()


def per_frame(hits: DataFrame, tolerance: float) -> DataFrame:
    """Best contribution of each frame at each candidate; offsets are compared unrounded.

    A band join: hits fall into bands of the tolerance's width, a candidate meets those of the bands
    that it reaches. As candidates have 2 digits, no hit meets more than some 200 * tolerance
    of them, however many hits a clip has in one video.
    """
    width = max(tolerance, 0.01)
    h = offsets(hits)
    reach = lambda sign: F.floor((F.col("cand") + sign * tolerance) / width + sign * 1e-9)
    near = h.select("clip_id", "key", "cand").distinct().withColumn("band", F.explode(F.sequence(reach(-1), reach(1))))
    met = h.drop("cand").withColumn("band", F.floor(F.col("off") / width)).join(near, ["clip_id", "key", "band"]).where(F.abs(F.col("off") - F.col("cand")) <= tolerance)
    return met.groupBy("clip_id", "key", "cand", "q_idx").agg(F.max("s").alias("s"), F.min(F.struct((-F.col("s")).alias("neg"), "rank", "off", "q_t")).alias("top"))


def support(hits: DataFrame, clips: DataFrame, tolerance: float) -> DataFrame:
    """(clip_id, key, cand, support): over all frames of the clip, with or without hits."""
    return supported(per_frame(hits, tolerance), clips)


def supported(frames: DataFrame, clips: DataFrame) -> DataFrame:
    return frames.groupBy("clip_id", "key", "cand").agg(F.sum("s").alias("total")).join(clips, "clip_id").select("clip_id", "key", "cand", F.round(F.col("total") / F.col("n_frames"), 9).alias("support"))


def best_fits(supports: DataFrame) -> DataFrame:
    """The best candidate of each video; equals go to the smallest offset."""
    order = Window.partitionBy("clip_id", "key").orderBy(F.desc("support"), "cand")
    return supports.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def ranking(fits: DataFrame) -> DataFrame:
    """(clip_id, key, cand, confidence, runner_up, ratio): the best video; equals go to the smallest key."""
    order = Window.partitionBy("clip_id").orderBy(F.desc("support"), "key")
    both = fits.withColumn("n", F.row_number().over(order)).where("n <= 2")
    top = both.groupBy("clip_id").agg(*[F.max(F.when(F.col("n") == 1, F.col(c))).alias(a) for c, a in (("key", "key"), ("cand", "cand"), ("support", "confidence"))], F.coalesce(F.max(F.when(F.col("n") == 2, F.col("support"))), F.lit(0.0)).alias("runner_up"))
    return top.withColumn("ratio", F.when(F.col("confidence") > 0, F.col("runner_up") / F.col("confidence")).otherwise(1.0))


def weighted_median(rows: DataFrame, keys: list[str], value: str, weight: str, name: str) -> DataFrame:
    """First value, ascending, at which the running weight is half of all or more."""
    running = Window.partitionBy(*keys).orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy(*keys)
    summed = rows.groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    at = summed.withColumns({"_run": F.round(F.sum("_w").over(running), 9), "_half": F.round(F.sum("_w").over(every) / 2, 9)})
    return at.where("_run >= _half").groupBy(*keys).agg(F.min(value).alias(name))


def best_aligned(frames: DataFrame, fits: DataFrame, best: DataFrame) -> DataFrame:
    """(clip_id, q_idx, s, off, q_t): the best video's frames of positive score at its best candidate."""
    chosen = frames.join(fits.select("clip_id", "key", "cand"), ["clip_id", "key", "cand"]).where("s > 0")
    return chosen.join(best.select("clip_id", "key"), ["clip_id", "key"]).select("clip_id", "q_idx", "s", F.col("top.off").alias("off"), F.col("top.q_t").cast("double").alias("q_t"))


def _halfway(points: Column) -> Column:
    """weighted_median of off by s, of an array."""
    half = F.round(F.aggregate(points, F.lit(0.0), lambda x, p: x + p["s"]) / 2, 9)
    start = F.struct(F.lit(0.0).alias("run"), F.lit(None).cast("double").alias("found"))
    step = lambda x, p: F.struct((x["run"] + p["s"]).alias("run"), F.coalesce(x["found"], F.when(F.round(x["run"] + p["s"], 9) >= half, p["off"])).alias("found"))
    ordered = F.sort_array(F.transform(points, lambda p: F.struct(p["off"].alias("off"), p["s"].alias("s"))))
    return F.aggregate(ordered, start, step)["found"]


def _middle(values: Column) -> Column:
    ordered, n = F.sort_array(values), F.size(values)
    return 0.5 * F.get(ordered, F.floor((n - 1) / 2).cast("int")) + 0.5 * F.get(ordered, F.floor(n / 2).cast("int"))


def _evidence(points: Column) -> Column:
    """The MAX_EVIDENCE frames of the highest scores, by time; null if there is none."""
    first = F.slice(F.sort_array(F.transform(points, lambda p: F.struct((-p["s"]).alias("neg"), p["q_idx"].alias("q_idx"), p["q_t"].alias("q_t"), p["off"].alias("off")))), 1, MAX_EVIDENCE)
    return F.when(F.size(points) > 0, F.sort_array(F.transform(first, lambda p: F.struct(p["q_t"].alias("query_t"), (p["q_t"] + p["off"]).alias("ref_t"), (-p["neg"]).alias("score")))))


def decide(hits: DataFrame, clips: DataFrame, *, min_score: float = 0.785, max_ratio: float = 0.8, tolerance: float = 0.6) -> DataFrame:
    """One row per clip: accepted, candidate_key, confidence, offset_s, window_start, window_end, reason, runner_up, ratio, coverage, offset_spread_s, n_aligned, votes, evidence.

    Hits are read once. The frames that support a candidate travel with it, as an array of no more
    than the clip's frames, so that nothing is looked up again: one aggregate a
    candidate, one a video, one a clip.
    """
    point = F.struct("q_idx", "s", F.col("top.off").alias("off"), F.col("top.q_t").cast("double").alias("q_t"))
    each = per_frame(hits, tolerance).groupBy("clip_id", "key", "cand").agg(F.sum("s").alias("total"), F.collect_list(F.when(F.col("s") > 0, point)).alias("points"))
    each = each.join(clips.select("clip_id", "n_frames"), "clip_id").withColumn("neg", -F.round(F.col("total") / F.col("n_frames"), 9))
    fits = each.groupBy("clip_id", "key").agg(F.min_by(F.struct("neg", "cand", "points"), F.struct("neg", "cand")).alias("fit"))
    ranked = fits.groupBy("clip_id").agg(F.sort_array(F.collect_list(F.struct("fit.neg", "key", "fit.cand", "fit.points"))).alias("fits"))
    best, second = F.get("fits", F.lit(0)), F.get("fits", F.lit(1))
    votes = F.map_from_entries(F.sort_array(F.transform("fits", lambda f: F.struct(f["key"].alias("key"), F.size(f["points"]).alias("n")))))
    told = ranked.select("clip_id", best["key"].alias("key"), (-best["neg"]).alias("confidence"), F.coalesce(-second["neg"], F.lit(0.0)).alias("runner_up"), best["points"].alias("points"), votes.alias("votes"))
    points = F.col("points")
    told = told.withColumns({"ratio": F.when(F.col("confidence") > 0, F.col("runner_up") / F.col("confidence")).otherwise(1.0), "offset_s": _halfway(points)})
    times = F.transform(points, lambda p: p["q_t"])
    out = clips.join(told, "clip_id", "left")
    accepted = gate(F.col("confidence"), F.col("ratio"), min_score, max_ratio)
    reason = F.when(F.col("key").isNull(), "no_candidates").when(accepted, None).when(F.col("confidence") < min_score, "low_score").otherwise("ambiguous")
    n_aligned = F.when(F.col("key").isNull(), 0).otherwise(F.size(points)).cast("long")
    return out.select(
        "clip_id", "n_frames", accepted.alias("accepted"), F.col("key").alias("candidate_key"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "offset_s",
        rounded(F.col("offset_s") + F.array_min(times), 2).alias("window_start"), rounded(F.col("offset_s") + F.array_max(times), 2).alias("window_end"), reason.alias("reason"),
        "runner_up", "ratio", F.when(F.col("key").isNotNull(), n_aligned / F.col("n_frames")).alias("coverage"), _middle(F.transform(points, lambda p: F.abs(p["off"] - F.col("offset_s")))).alias("offset_spread_s"), n_aligned.alias("n_aligned"), "votes", _evidence(points).alias("evidence"),
    )
