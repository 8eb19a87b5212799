"""Percentiles by selection and resampling, against plain versions."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from frametide.operators import evaluate


def _plain(values, share):
    held = sorted(v for v in values if v is not None and not math.isnan(v))
    if not held:
        return None
    at = share * (len(held) - 1)
    lo, hi = held[math.floor(at)], held[math.ceil(at)]
    return lo if at == math.floor(at) else lo * (1 - (at - math.floor(at))) + hi * (at - math.floor(at))


@pytest.mark.parametrize(("bins", "left"), [(4096, 100_000), (3, 2), (16, 1)])
def test_percentiles(spark, bins, left):
    rng = random.Random(2)
    shapes = {
        "even": lambda: rng.random(), "long": lambda: rng.expovariate(1) ** 9, "few": lambda: rng.choice([1.5, 1.5, 2.0]), "same": lambda: 7.25, "signed": lambda: rng.gauss(0, 1e-3) - 1000,
        "odd": lambda: rng.choice([None, math.nan, 0.0, -0.0, 1e-300, -1e-300, 5e307, -1e308, rng.random()]), "none": lambda: rng.choice([None, math.nan]), None: lambda: rng.randint(0, 9),
    }
    rows = [(g, None if (v := make()) is None else float(v)) for g, make in shapes.items() for _ in range(150)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    shares = (0.0, 0.1, 0.5, 0.95, 1.0)
    got = {(r["g"], r["share"]): r["percentile"] for r in evaluate.percentiles(df, F.col("v"), shares, ("g",), bins=bins, left=left).collect()}
    want = {(g, s): _plain([v for h, v in rows if h == g], s) for g in shapes for s in shares if g != "none"}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12, abs=1e-305) for k in want)
    assert evaluate.percentiles(df.limit(0), F.col("v"), (0.5,), bins=bins, left=left).count() == 0


def test_percentiles_of_one_large_group(spark):
    """Ten million values of one group: a task sorts no more than some thousands; what is shuffled are bins."""
    n = 10_000_000
    df = spark.range(n).select((F.pmod(F.col("id") * 7_368_787, F.lit(n)) * 0.5).alias("v"))
    got = {r["share"]: r["percentile"] for r in evaluate.percentiles(df, F.col("v"), (0.5, 0.95)).collect()}
    assert got == {0.5: pytest.approx((n - 1) * 0.25), 0.95: pytest.approx((n - 1) * 0.475)}
    row = evaluate.latency(df, "v").first()
    assert row["v_p50"] == pytest.approx((n - 1) * 0.25)
    assert tuple(evaluate.latency(df.limit(0), "v").first()) == (None, None)


def test_multinomial_draws(spark):
    names = [f"b{i:02}" for i in range(23)]
    bases = spark.createDataFrame([(x,) for x in names * 2] + [(None,)], "base_id string")
    weights = evaluate.multinomial_weights(bases, 40, 3)
    got = {(r["base_id"], r["rep"]): r["weight"] for r in weights.collect()}
    want = {}
    for rep in range(40):
        for j in range(23):
            u = int(hashlib.md5(f"3|{rep}|{j}".encode()).hexdigest()[:8], 16)
            key = names[u * 23 >> 32], rep
            want[key] = want.get(key, 0) + 1
    assert got == want
    totals = [sum(w for (_, r), w in got.items() if r == rep) for rep in range(40)]
    assert set(totals) == {23} and "SinglePartition" not in weights._jdf.queryExecution().executedPlan().toString()
    assert evaluate.multinomial_weights(bases.limit(0), 5).count() == 0
    many = evaluate.multinomial_weights(bases, 2000, 1).groupBy("base_id").agg(F.avg("weight").alias("m"), F.count("*").alias("n")).collect()
    assert len(many) == 23 and all(abs(r["m"] * r["n"] / 2000 - 1) < 0.12 for r in many)


def test_paired_difference(spark):
    rng = random.Random(4)
    schema = "base_id string, known boolean, hit boolean"
    one = [(f"b{i % 17}", rng.random() < 0.8, rng.random() < 0.7) for i in range(300)]
    two = [(b, k, h and rng.random() < 0.8) for b, k, h in one]
    a, b = spark.createDataFrame(one, schema), spark.createDataFrame(two, schema)
    weights = evaluate.multinomial_weights(a, 50, 2)
    row = evaluate.paired(a, b, F.col("hit"), F.col("known"), weights).first()
    drawn = {}
    for r in weights.collect():
        drawn.setdefault(r["rep"], {})[r["base_id"]] = r["weight"]
    mean = lambda rows, w: sum(w.get(x, 0) * h for x, k, h in rows if k) / sum(w.get(x, 0) for x, k, h in rows if k)
    every = dict.fromkeys({x for x, _, _ in one}, 1)
    diffs = [mean(one, w) - mean(two, w) for w in drawn.values()]
    assert row["difference"] == round(mean(one, every) - mean(two, every), 4)
    assert (row["lo"], row["hi"]) == (pytest.approx(np.percentile(diffs, 2.5), abs=1e-4), pytest.approx(np.percentile(diffs, 97.5), abs=1e-4))
