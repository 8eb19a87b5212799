"""What a search holds at a time, and how its work is dealt out."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from frametide.operators import search


def test_memory_does_not_grow_with_the_library():
    rng = np.random.default_rng(6)
    q = rng.normal(size=(256, 32)).astype(np.float32)
    for n in (50_000, 500_000):
        vectors, places = rng.normal(size=(n, 32)).astype(np.float32), np.arange(n)
        tracemalloc.start()
        best = search.Best(len(q), 10)
        best.meet(q, vectors, places)
        assert tracemalloc.get_traced_memory()[1] < 24 << 20  # the larger library has 64 MB
        tracemalloc.stop()
    assert len(best.ids) == 2560


def test_rising_scores_and_ties():
    """Every tile is better than those before, and most of it ties."""
    vectors = np.repeat(np.arange(1, 9, dtype=np.float32), 1500)[:, None] * np.ones((1, 4), np.float32)
    best = search.Best(3, 5)
    best.meet(np.ones((3, 4), np.float32), vectors, np.arange(len(vectors))[::-1].copy())
    assert best.ids.reshape(3, 5).tolist() == [[0, 1, 2, 3, 4]] * 3 and set(best.scores) == {32.0}


def test_one_partition_of_queries_is_dealt_out(spark):
    lib = spark.createDataFrame([(i, 1, 0.0, [float(i), 1.0]) for i in range(20)], "vector_id long, key int, t double, vector array<float>")
    asked = spark.createDataFrame([("a", i, 0.0, [1.0, float(i)]) for i in range(200)], "clip_id string, q_idx int, q_t double, vector array<float>").coalesce(1)
    hits = search.topk(asked, lib, 2, 2)
    assert hits.count() == 400
    assert hits.select(F.spark_partition_id()).distinct().count() >= spark.sparkContext.defaultParallelism


def test_small_blocks_are_met_at_once(monkeypatch):
    rng = np.random.default_rng(7)
    vectors, q = rng.normal(size=(4000, 16)).astype(np.float32), rng.normal(size=(64, 16))
    blocks = vectors.reshape(500, 8, 16)
    centres = blocks.mean(axis=1, dtype=np.float64)
    raw = lambda x: [y.tobytes() for y in x.reshape(500, 8, -1)]
    batch = pa.RecordBatch.from_pydict({
        "cell": list(range(500)), "centre": centres.tolist(), "radius": np.sqrt(((blocks - centres[:, None]) ** 2).sum(2)).max(1).tolist(), "width": [4] * 500,
        "ids": raw(np.arange(4000)), "keys": raw(np.zeros(4000, np.int32)), "times": raw(np.zeros(4000)), "vectors": raw(vectors)})
    calls, meet = [], search.Best.meet
    monkeypatch.setattr(search.Best, "meet", lambda self, *a, **b: calls.append(1) or meet(self, *a, **b))
    (stack,) = search._stacks(iter([batch]), 16)
    best, pairs = search._met(q, None, search._reach(q, stack.centres, stack.radii), stack, 10)
    assert len(calls) == 1 and pairs == 64 * 500
    assert best.ids.reshape(64, 10).tolist() == np.argsort(-(q @ vectors.T.astype(float)), axis=1, kind="stable")[:, :10].tolist()


def test_many_small_blocks_in_few_files(spark):
    rows = np.random.default_rng(8).normal(size=(2000, 4)).astype(np.float32).tolist()
    lib = spark.createDataFrame([(i, 1, 0.0, v) for i, v in enumerate(rows)], "vector_id long, key int, t double, vector array<float>")
    made = search.build(lib, 4, block_bytes=5 * 4 * 4, cells=12)
    assert len(made.blocks.inputFiles()) <= len(made.cells) + int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = spark.createDataFrame([("a", i, 0.0, v) for i, v in enumerate(rows[:700])], "clip_id string, q_idx int, q_t double, vector array<float>")
    hits = search.search(asked, made, 3)
    assert hits.exceptAll(search.topk(asked, lib, 3, 4)).count() == 0 and hits.count() == 2100


def test_small_cells_share_folders_and_few_tasks_write_them(spark):
    rows = np.random.default_rng(10).normal(size=(2000, 4)).astype(np.float32).tolist()
    lib = spark.createDataFrame([(i, 1, 0.0, v) for i, v in enumerate(rows)], "vector_id long, key int, t double, vector array<float>")
    made = search.build(lib, 4, block_bytes=20 * 4 * 4)
    assert len(made.cells) == 100
    assert len(made.blocks.inputFiles()) <= spark.sparkContext.defaultParallelism
    of = made.of(np.array([3, 50]))
    assert {r["cell"] for r in of.select("cell").collect()} == {3, 50}


def test_cells_of_several_folders(spark, monkeypatch):
    monkeypatch.setattr(search, "FOLDER_BYTES", 3 * 40 * 4 * 4)
    rows = np.random.default_rng(11).normal(size=(800, 4)).astype(np.float32).tolist()
    lib = spark.createDataFrame([(i, 1, 0.0, v) for i, v in enumerate(rows)], "vector_id long, key int, t double, vector array<float>")
    made = search.build(lib, 4, block_bytes=40 * 4 * 4)
    assert made.a_folder == 3 and len(made.cells) == 20
    some = made.of(np.array([6, 8]))
    assert "folder" in some._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: ")[1].split("DataFilters")[0]
    assert {r["f"].split("/")[-2] for r in some.select(F.input_file_name().alias("f")).collect()} == {"folder=2"}
    assert sorted(x for r in made.blocks.collect() for x in np.frombuffer(r["ids"], "<i8")) == list(range(800))
    asked = spark.createDataFrame([("a", i, 0.0, v) for i, v in enumerate(rows[:300])], "clip_id string, q_idx int, q_t double, vector array<float>")
    hits = search.search(asked, made, 3)
    assert hits.exceptAll(search.topk(asked, lib, 3, 4)).count() == 0 and hits.count() == 900


def test_query_vectors_are_made_once_and_sent_in_few_groups(spark, monkeypatch):
    rows = np.random.default_rng(12).normal(size=(200, 4)).astype(np.float32).tolist()
    table = spark.createDataFrame([("a", i, 0.0, v) for i, v in enumerate(rows)], "clip_id string, q_idx int, q_t double, vector array<float>")
    asked = table.withColumn("vector", F.transform("vector", lambda x: F.expm1(x).cast("float")))
    plan = search._asked(asked, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("expm1") == 1
    groups, floors = [], search._floors
    monkeypatch.setattr(search, "_floors", lambda *a: groups.append(1) or floors(*a))
    lib = table.select(F.col("q_idx").cast("long").alias("vector_id"), F.lit(1).alias("key"), "q_t", "vector").withColumnRenamed("q_t", "t")
    assert search.search(asked, search.build(lib, 4), 2, query_bytes=200 * 4 * 4).count() == 400
    assert len(groups) == 1  # single precision: four bytes a number


def test_odd_query_vectors_are_left_out(spark):
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [1.0], [1.0, None], [None, None], [nan, 1.0], [1.0, -inf], [inf, 0.0], [1.0, 2.0, 3.0]]
    for kind in ("float", "double"):
        asked = spark.createDataFrame([("a", i, None, v) for i, v in enumerate([*odd, [1.0, 0.0]])], f"clip_id string, q_idx int, q_t double, vector array<{kind}>")
        assert [(r["q_idx"], r["q_t"], r["vector"]) for r in search._asked(asked.coalesce(1), 2).collect()] == [(len(odd), None, [1.0, 0.0])]


def test_sql_takes_any_library(spark, monkeypatch):
    monkeypatch.setattr(search, "SQL_VECTORS", 150)
    rows = np.random.default_rng(9).normal(size=(900, 6)).astype(np.float32).tolist()
    rows += rows[:200]  # ties
    lib = spark.createDataFrame([(i, 1, 0.5 * i, v) for i, v in enumerate(rows)] + [(9000, 1, 0.0, None)], "vector_id long, key int, t double, vector array<float>")
    asked = spark.createDataFrame([("a", i, 0.0, v) for i, v in enumerate(rows[:40])], "clip_id string, q_idx int, q_t double, vector array<float>")
    told = lambda df: sorted((r["clip_id"], r["q_idx"], r["rank"], r["vector_id"], r["key"], r["ref_t"], round(r["score"], 9)) for r in df.collect())
    assert told(search.topk_sql(asked, lib, 4)) == told(search.topk(asked, lib, 4, 6))
    assert search.topk_sql(asked, lib.limit(0), 4).count() == 0 and search.topk_sql(asked, lib.where("vector_id < 2"), 4).count() == 80


def test_sql_joins_only_the_nearest(spark, monkeypatch):
    """Pairs are met in products, not one by one in a loop; what is joined is k rows a query and slice."""
    monkeypatch.setattr(search, "SQL_VECTORS", 400)
    rows = np.random.default_rng(3).normal(size=(900, 6)).astype(np.float32).tolist()
    lib = spark.createDataFrame([(i, 1, 0.5 * i, v) for i, v in enumerate(rows)], "vector_id long, key int, t double, vector array<float>")
    asked = spark.createDataFrame([("a", i, 0.0, v) for i, v in enumerate(rows[:40])], "clip_id string, q_idx int, q_t double, vector array<float>")
    hits = search.topk_sql(asked, lib, 4)
    plan = hits._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = [sorted(range(900), key=lambda i, q=q: (-sum(float(x) * float(y) for x, y in zip(q, rows[i], strict=True)), i))[:4] for q in rows[:40]]
    assert sorted((r["q_idx"], r["rank"], r["vector_id"]) for r in hits.collect()) == sorted((q, n, i) for q, of in enumerate(want) for n, i in enumerate(of))
