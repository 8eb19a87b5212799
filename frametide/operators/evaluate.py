"""Open-set evaluation: gates, metrics, breakdowns, threshold choice, ROC, intervals.

decided(query_id, candidate, confidence, feature, offset_s) are left-joined to
specs(query_id, base_id, film_id, role, split, ...), so that a query without a
decision, or in failures, counts as rejected. Everything is keyed by query_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..staging import numbered, staged

# Metrics in their order, and how many digits they have.
METRICS = {"n_known": 0, "n_unknown": 0, "answer_precision": 4, "dir": 4, "frr": 4, "misid": 4, "top1": 4, "far": 4, "offset_median_s": 3, "offset_p90_s": 3, "offset_within_half": 4, "offset_within_1s": 4}


def judged(specs: DataFrame, decided: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """specs with known, correct, err and failed; candidate, confidence, feature may be null."""
    out = specs.join(decided.select("query_id", "candidate", "confidence", "feature", "offset_s"), "query_id", "left")
    out = out.join(failures.select("query_id", F.lit(True).alias("failed")).distinct(), "query_id", "left") if failures is not None else out.withColumn("failed", F.lit(False))
    known = F.col("role") == "library"
    return out.withColumns({"failed": F.coalesce("failed", F.lit(False)), "known": known, "correct": known & F.coalesce(F.col("candidate") == F.col("film_id"), F.lit(False)), "err": F.abs(F.col("offset_s") - F.col("true_offset_s"))})


def accepted(primary: Column, secondary: Column, feature_is_most: bool) -> Column:
    """Both thresholds hold, there is a candidate, and the query did not fail; NaN and null fail."""
    feature, confidence = F.nanvl("feature", F.lit(None).cast("double")), F.nanvl("confidence", F.lit(None).cast("double"))
    second = feature <= secondary if feature_is_most else feature >= secondary
    return F.coalesce((confidence >= primary) & second, F.lit(False)) & F.col("candidate").isNotNull() & ~F.col("failed")


def metric_columns(acc: Column) -> list[Column]:
    """Aggregates over judged rows; a metric over nothing is null."""
    known, correct, hit = F.col("known"), F.col("correct"), acc & F.col("correct")
    share = lambda what, of: F.avg(F.when(of, what.cast("double")))
    err = F.when(hit & known, F.col("err"))
    made = {
        "n_known": F.count(F.when(known, 1)), "n_unknown": F.count(F.when(~known, 1)), "answer_precision": share(correct, acc), "dir": share(hit, known), "frr": share(~acc, known), "misid": share(acc & ~correct, known), "top1": share(correct, known), "far": share(acc, ~known),
        "offset_median_s": F.percentile(err, F.lit(0.5)), "offset_p90_s": F.percentile(err, F.lit(0.9)), "offset_within_half": F.avg((err <= 0.5).cast("double")), "offset_within_1s": F.avg((err <= 1.0).cast("double")),
    }
    return [(rounded(c, METRICS[k]) if METRICS[k] else c).alias(k) for k, c in made.items()]


def metrics(rows: DataFrame, acc: Column, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(*metric_columns(acc))


def breakdown(rows: DataFrame, acc: Column, slices: tuple[str, ...] = ("distortion", "length_s", "film_id")) -> DataFrame:
    """(kind, slice, metrics) for each value of each slice column, and group over unknown queries only; rows are read once, told once a slice."""
    tagged = rows.withColumn("_acc", acc)
    pairs = [F.struct(F.lit(s).alias("kind"), F.col(s).cast("string").alias("slice")) for s in slices]
    if "group" in rows.columns:
        pairs.append(F.when(~F.col("known"), F.struct(F.lit("group").alias("kind"), F.col("group").cast("string").alias("slice"))))
    spread = tagged.withColumn("_s", F.explode(F.array_compact(F.array(*pairs)))).withColumns({"kind": F.col("_s.kind"), "slice": F.col("_s.slice")})
    return metrics(spread, F.col("_acc"), "kind", "slice")


def threshold_grid(spark, algorithm: str) -> DataFrame:
    """(primary, secondary): 201 steps of 0.005, and 0.70 to 1.00 (v1) or 0.60 to 0.95 (v2) by 0.05."""
    low, n = (14, 7) if algorithm == "v1" else (12, 8)
    return spark.range(201).select((F.rint(F.col("id") * 5) / 1000).alias("primary")).crossJoin(spark.range(n).select(((F.col("id") + low) * 5 / 100).alias("secondary")))


def _reached(rows: DataFrame, value: Column, limits: list[float], name: str) -> DataFrame:
    """rows with how many of the rising limits are at most value: a binary search a row, in the JVM."""
    from pyspark.ml.feature import Bucketizer

    low, high = [] if limits[0] == float("-inf") else [float("-inf")], [] if limits[-1] == float("inf") else [float("inf")]
    # the search puts -0.0 below 0.0; adding 0.0 makes them one
    put = Bucketizer(splits=[*low, *[x + 0.0 for x in limits], *high], inputCol="_value", outputCol="_place")
    placed = put.transform(rows.withColumn("_value", value + F.lit(0.0))).drop("_value")
    return placed.withColumn(name, F.col("_place").cast("int") + (1 - len(low))).drop("_place")


def sweep(rows: DataFrame, grid: DataFrame, feature_is_most: bool) -> DataFrame:
    """(primary, secondary, dir, far) of each grid point, from one pass over rows, whatever the grid.

    A row passes the points below its confidence and on its side of its feature: a
    corner of the grid. So each row is counted once, in the cell of its corner, and counts are
    cumulated over the cells along both sides. Rows that no point accepts (no
    candidate, failed, null or NaN) lie in cell 0, 0.
    """
    spark, sign = rows.sparkSession, -1.0 if feature_is_most else 1.0
    points = [(r[0], r[1]) for r in grid.select(F.col("primary").cast("double"), F.col("secondary").cast("double")).distinct().collect()]  # the grid's own few
    if not points:
        return grid.select("primary", "secondary", F.lit(0.0).alias("dir"), F.lit(0.0).alias("far"))
    first, second = sorted({p for p, _ in points}), sorted({sign * q for _, q in points})
    usable = ~F.col("failed") & F.col("candidate").isNotNull() & F.nanvl("confidence", F.lit(None).cast("double")).isNotNull() & F.nanvl("feature", F.lit(None).cast("double")).isNotNull()
    told = rows.select("known", (F.col("known") & F.col("correct")).alias("hit"), F.when(usable, F.col("confidence").cast("double")).otherwise(float("-inf")).alias("c"), F.when(usable, sign * F.col("feature").cast("double")).otherwise(float("-inf")).alias("f"), F.coalesce(usable, F.lit(False)).alias("usable"))
    placed = _reached(_reached(told, F.col("c"), first, "a"), F.col("f"), second, "b")
    at = lambda c: F.when(F.col("usable"), F.col(c)).otherwise(0).alias(c)
    count = lambda x: F.count(F.when(x, 1))
    cells = placed.select(at("a"), at("b"), "known", "hit").groupBy("a", "b").agg(count(F.col("hit")).alias("hits"), count(F.col("known")).alias("known"), count(~F.col("known")).alias("unknown"))
    n, m = len(first) + 1, len(second) + 1
    lattice = spark.range(n * m).select(F.floor(F.col("id") / m).cast("int").alias("a"), (F.col("id") % m).cast("int").alias("b"))
    full = lattice.join(F.broadcast(cells), ["a", "b"], "left").fillna(0, ["hits", "known", "unknown"])  # no more cells than the lattice has
    along = Window.partitionBy("b").orderBy(F.desc("a")).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy("a").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, 0)
    for window in (along, across):
        full = full.withColumns({c: F.sum(c).over(window) for c in ("hits", "known", "unknown")})
    every = full.where("a = 0 and b = 0").select(F.col("known").alias("n_known"), F.col("unknown").alias("n_unknown"))
    named = spark.createDataFrame([(first.index(p) + 1, second.index(sign * q) + 1, p, q) for p, q in points], "a int, b int, primary double, secondary double")
    share = lambda x, of: F.when(F.col(of) > 0, F.col(x) / F.col(of)).otherwise(0.0)
    return full.join(F.broadcast(named), ["a", "b"]).crossJoin(F.broadcast(every)).select("primary", "secondary", share("hits", "n_known").alias("dir"), share("unknown", "n_unknown").alias("far"))


def pick(swept: DataFrame, target_far: float, feature_is_most: bool) -> DataFrame:
    """The best point: within the FAR target, then DIR (or least FAR), least FAR, greatest primary, strictest secondary."""
    feasible = F.col("far") <= target_far + 1e-12
    strict = F.col("secondary") * (-1 if feature_is_most else 1)
    order = F.struct(feasible.cast("int").alias("a"), F.when(feasible, F.col("dir")).otherwise(-F.col("far")).alias("b"), (-F.col("far")).alias("c"), F.col("primary").alias("d"), strict.alias("e"))
    return swept.groupBy().agg(F.max(F.struct(order.alias("o"), "primary", "secondary", "dir", "far", feasible.alias("feasible"))).alias("x")).select("x.primary", "x.secondary", "x.dir", "x.far", "x.feasible")


def roc(rows: DataFrame, grid: DataFrame, secondary: float, feature_is_most: bool) -> DataFrame:
    return sweep(rows, grid.where(F.col("secondary") == secondary), feature_is_most).select("primary", rounded(F.col("dir"), 4).alias("dir"), rounded(F.col("far"), 4).alias("far")).orderBy("primary")


def hashed_weights(bases: DataFrame, replicates: int) -> DataFrame:
    """(base_id, rep, weight): a Poisson(1)-like weight from a hash of base and replicate; the same on any engine that has md5."""
    u = F.conv(F.substring(F.md5(F.concat_ws("|", "base_id", F.col("rep").cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    # fixed values: the cumulated Poisson(1) distribution
    steps = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]
    weight = sum((F.when(u >= x, 1).otherwise(0) for x in steps), F.lit(0))
    return bases.select("base_id").distinct().withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("weight", weight).where("weight > 0")


def multinomial_weights(bases: DataFrame, replicates: int, seed: int = 0) -> DataFrame:
    """(base_id, rep, weight): resampling of the bases with replacement, as many draws a replicate as there are bases.

    Draw j of a replicate falls on base floor(u * n) by name, u a hash of seed, replicate and j: counts of such draws are
    multinomial, add up to n in each replicate, and are the same on any engine that has md5. Bases
    are numbered by ranges and each makes its own draws, so nothing passes one task or the driver but n.
    """
    named = staged(numbered(bases.select("base_id").where("base_id is not null").distinct(), "base_id").select("base_id", "_n"), "bases")
    n = named.count()
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("rep").cast("string"), F.col("_n").cast("string"))), 1, 8), 16, 10).cast("long")
    draws = named.select("_n", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep")).select("rep", F.shiftright(u * F.lit(n).cast("long"), 32).alias("_n"))
    counted = draws.groupBy("rep", "_n").agg(F.count("*").cast("int").alias("weight"))
    return counted.join(named, "_n").select("base_id", "rep", "weight")


def per_base(rows: DataFrame, value: Column, of: Column) -> DataFrame:
    """(base_id, v, n): sums of a value over the rows that it is of, by base clip."""
    return rows.groupBy("base_id").agg(F.sum(F.when(of, value.cast("double"))).alias("v"), F.count(F.when(of & value.isNotNull(), 1)).alias("n")).where("n > 0")


def replicate_means(sums: DataFrame, weights: DataFrame) -> DataFrame:
    """(rep, mean): the weighted mean of each replicate; one of no weight drops out."""
    return sums.join(weights, "base_id").groupBy("rep").agg((F.sum(F.col("v") * F.col("weight")) / F.sum(F.col("n") * F.col("weight"))).alias("mean"))


def _interval(means: DataFrame) -> DataFrame:
    return means.agg(rounded(F.percentile("mean", F.lit(0.025)), 4).alias("lo"), rounded(F.percentile("mean", F.lit(0.975)), 4).alias("hi"))


def bootstrap(rows: DataFrame, value: Column, of: Column, weights: DataFrame) -> DataFrame:
    """(lo, hi): 2.5 and 97.5 percentiles of the weighted mean over replicates. Rows are summed per base clip first."""
    return _interval(replicate_means(per_base(rows, value, of), weights))


def paired(one: DataFrame, two: DataFrame, value: Column, of: Column, weights: DataFrame) -> DataFrame:
    """(difference, lo, hi): the mean of run one less that of run two, and its interval over replicates that draw the same bases for both."""
    a, b = per_base(one, value, of), per_base(two, value, of)
    total = lambda sums, name: sums.agg((F.sum("v") / F.sum("n")).alias(name))
    whole = total(a, "_a").crossJoin(total(b, "_b")).select(rounded(F.col("_a") - F.col("_b"), 4).alias("difference"))
    means = replicate_means(a, weights).join(replicate_means(b, weights).withColumnRenamed("mean", "_b"), "rep").select((F.col("mean") - F.col("_b")).alias("mean"))
    return whole.crossJoin(_interval(means))  # a row each


BINS, LEFT = 4096, 100_000


def percentiles(rows: DataFrame, value: Column, shares: tuple[float, ...], by: tuple[str, ...] = (), *, bins: int = BINS, left: int = LEFT) -> DataFrame:
    """(by, share, percentile): exact, interpolated between the two ranks around share * (n - 1); NaN and null aside.

    Distributed selection: values are counted in bins between the least and the
    greatest, then again within the bin that holds the rank, until that has few values or only one
    repeated; these alone are sorted. What is shuffled are counts, so one group
    may have any number of rows. rows are read once a round, some three or four in all.
    """
    groups, x = list(by), F.nanvl(value.cast("double"), F.lit(None).cast("double"))
    held = rows.select(*by, x.alias("_x")).where("_x is not null")
    scaled = lambda c: F.greatest(F.least(c, F.lit(1e308)), F.lit(-1e308)) / 2
    spread = [F.count("*").alias("_count"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")]
    ranks = F.explode(F.array(*[F.struct(F.lit(float(s)).alias("share"), F.lit(k).alias("_upper")) for s in shares for k in (0, 1)]))
    at = F.col("share") * (F.col("_count") - 1)
    wanted = held.groupBy(*by).agg(*spread).where("_count > 0").withColumn("_r", ranks).select(*by, "_r.*", "_count", "_lo", "_hi").withColumn("_rank", F.when(F.col("_upper") == 0, F.floor(at)).otherwise(F.ceil(at)))
    wanted = staged(wanted.withColumns({"_weight": F.when(F.col("_upper") == 1, at - F.floor(at)).otherwise(1 - (at - F.floor(at)))}), "ranks")
    done = []
    for _ in range(64):
        settled = (F.col("_lo") == F.col("_hi")) | (F.col("_count") <= left) | (scaled(F.col("_lo")) == scaled(F.col("_hi")))
        done.append(wanted.where(settled))
        wanted = wanted.where(~settled)
        if wanted.isEmpty():
            break
        place = F.least(F.floor((scaled(F.col("_x")) - scaled(F.col("_wlo"))) / (scaled(F.col("_whi")) - scaled(F.col("_wlo"))) * bins), F.lit(bins - 1))
        ends = wanted.select(*by, F.col("_lo").alias("_wlo"), F.col("_hi").alias("_whi")).distinct()
        counted = _within(held, ends, groups, "_wlo", "_whi").withColumn("_bin", place).groupBy(*by, "_wlo", "_whi", "_bin").agg(*spread)
        before = Window.partitionBy(*by, "_wlo", "_whi").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        bins_of = counted.withColumn("_below", F.coalesce(F.sum("_count").over(before), F.lit(0)))
        same = [F.col("w._lo") == F.col("c._wlo"), F.col("w._hi") == F.col("c._whi"), *[F.col(f"w.{g}").eqNullSafe(F.col(f"c.{g}")) for g in groups]]
        holds = (F.col("w._rank") >= F.col("c._below")) & (F.col("w._rank") < F.col("c._below") + F.col("c._count"))
        met = wanted.alias("w").join(bins_of.alias("c"), [*same, holds])
        wanted = staged(met.select(*[f"w.{g}" for g in groups], "w.share", "w._upper", "c._count", "c._lo", "c._hi", (F.col("w._rank") - F.col("c._below")).alias("_rank"), "w._weight"), "ranks")
    ended = done[0]
    for more in done[1:]:
        ended = ended.unionByName(more)
    ends = ended.where("_lo <> _hi").select(*by, F.col("_lo").alias("_wlo"), F.col("_hi").alias("_whi")).distinct()
    last = _within(held, ends, groups, "_wlo", "_whi").groupBy(*by, "_wlo", "_whi", "_x").agg(F.count("*").alias("_c"))
    upto = Window.partitionBy(*by, "_wlo", "_whi").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    last = last.withColumn("_to", F.sum("_c").over(upto))
    same = [F.col("w._lo") == F.col("c._wlo"), F.col("w._hi") == F.col("c._whi"), *[F.col(f"w.{g}").eqNullSafe(F.col(f"c.{g}")) for g in groups]]
    found = ended.alias("w").join(last.alias("c"), [*same, (F.col("w._rank") < F.col("c._to")) & (F.col("w._rank") >= F.col("c._to") - F.col("c._c"))], "left")
    value_at = F.coalesce("c._x", "w._lo")
    part = F.when(F.col("w._weight") == 0, 0.0).otherwise(value_at * F.col("w._weight"))
    return found.groupBy(*[F.col(f"w.{g}").alias(g) for g in groups], F.col("w.share").alias("share")).agg(F.sum(part).alias("percentile"))


def _within(held: DataFrame, ends: DataFrame, by: list[str], lo: str, hi: str) -> DataFrame:
    """held with the ranges of its group that hold the value; a group has no more ranges than ranks asked for."""
    same = [F.col(f"h.{g}").eqNullSafe(F.col(f"e.{g}")) for g in by]
    inside = (F.col("h._x") >= F.col(f"e.{lo}")) & (F.col("h._x") <= F.col(f"e.{hi}"))
    joined = held.alias("h").join(ends.alias("e") if by else F.broadcast(ends).alias("e"), [*same, inside])
    return joined.select("h.*", f"e.{lo}", f"e.{hi}")


def latency(rows: DataFrame, *columns: str) -> DataFrame:
    """p50 and p95 of each column, by selection; NaN and null aside."""
    out = None
    for c in columns:
        two = percentiles(rows, F.col(c), (0.5, 0.95)).agg(*[F.max(F.when(F.col("share") == p, F.col("percentile"))).alias(f"{c}_{n}") for n, p in (("p50", 0.5), ("p95", 0.95))])
        out = two if out is None else out.crossJoin(two)  # a row each
    return out


def missing(specs: DataFrame, stored: DataFrame, failures: DataFrame) -> DataFrame:
    """Queries neither stored nor failed: what is to do, or what makes an evaluation partial."""
    return specs.join(stored.select("query_id").distinct(), "query_id", "left_anti").join(failures.select("query_id").distinct(), "query_id", "left_anti")


def choose(rows: DataFrame, grid: DataFrame, target_far: float, feature_is_most: bool) -> DataFrame:
    """pick on the val split."""
    return pick(sweep(rows.where("split = 'val'"), grid, feature_is_most), target_far, feature_is_most)


def compare(summaries: DataFrame) -> DataFrame:
    """Runs by DIR, best first; all must share one answer key."""
    if summaries.select("answer_key_digest").distinct().count() > 1:
        raise ValueError("runs of different answer keys can't be compared")
    return summaries.orderBy(F.desc_nulls_last("dir"), "run")


def overlaps(specs: DataFrame) -> DataFrame:
    """Base clips of a film that begin before the one before has ended; empty for a sound answer key. Of equal starts the smaller base_id is before."""
    once = specs.groupBy("film_id", "base_id", "ref_start_s").agg(F.max("ref_duration_s").alias("ref_duration_s"))
    after = Window.partitionBy("film_id").orderBy("ref_start_s", "base_id")
    return once.withColumns({"next_base_id": F.lead("base_id").over(after), "next_start_s": F.lead("ref_start_s").over(after)}).where("ref_start_s + ref_duration_s > next_start_s")
