"""The pruned search against a plain one: ties, clusters, odd rows, groups of queries, bounded products."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from frametide.operators import search

LIB = "vector_id long, key int, t double, vector array<float>"
ASKED = "clip_id string, q_idx int, q_t double, vector array<float>"


def _plain(q, lib, k):
    out = []
    for clip, i, t, v in q:
        if v is None:
            continue
        scored = [(-float(np.dot(np.float64(np.float32(v)), np.float64(np.float32(w)))), n, key, at) for n, key, at, w in lib if w is not None and len(w) == len(v)]
        out += [(clip, i, t, rank, n, key, at, round(-s, 9)) for rank, (s, n, key, at) in enumerate(sorted(scored, key=lambda x: x[:2])[:k])]
    return sorted(out, key=str)


def _told(df):
    return sorted(((r["clip_id"], r["q_idx"], r["q_t"], r["rank"], r["vector_id"], r["key"], r["ref_t"], round(r["score"], 9)) for r in df.collect()), key=str)


def _clustered(n, dim, centres, spread, seed):
    rng = np.random.default_rng(seed)
    middle = np.random.default_rng(99).normal(size=(centres, dim))  # queries and library lie around the same places
    return (middle[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dim))).astype(np.float32).tolist()


@pytest.mark.parametrize(("spread", "k"), [(0.02, 5), (0.02, 60), (3.0, 5)])
def test_pruned_search(spark, spread, k):
    vectors = _clustered(400, 6, 12, spread, 1)
    vectors += vectors[:40] + vectors[:5] * 3  # ties go to the smaller id
    lib = [(i * 7 % 1000, (i % 5) - 1 if i % 9 else None, i / 2 if i % 11 else None, v) for i, v in enumerate(vectors)]
    lib += [(5001, 1, 0.0, None), (5002, 1, 0.0, [1.0]), (5003, 1, 0.0, [float("nan")] * 6)]
    q = [("a" if i % 2 else "b", i, i / 3, v) for i, v in enumerate(_clustered(30, 6, 12, spread, 2))] + [("c", 0, 0.0, None)]
    sound = [x for x in lib if x[3] is not None and len(x[3]) == 6 and x[0] != 5003]
    made = search.build(spark.createDataFrame(lib, LIB).repartition(3), 6, block_bytes=20 * 6 * 4, cells=12)
    sizes = made.blocks.agg(F.sum("n"), F.max("n"), F.count("*")).first()
    assert sizes[0] == len(sound) and sizes[1] <= 60 and sizes[2] >= len(sound) // 20
    want = _plain(q, sound, k)
    asked = spark.createDataFrame(q, ASKED).repartition(2)
    assert _told(search.search(asked, made, k)) == want
    if spread < 1 and k == 5:
        assert made.share_skipped() > 0.6
    assert _told(search.search(asked, made, k, query_bytes=7 * 6 * 8)) == want  # several groups of queries
    assert _told(search.topk(asked, spark.createDataFrame(lib, LIB), k, 6)) == want


def test_pruned_search_of_nothing(spark):
    empty = spark.createDataFrame([], LIB)
    one = spark.createDataFrame([(1, 1, 0.0, [1.0, 0.0])], LIB)
    asked = spark.createDataFrame([("a", 0, 0.0, [0.5, 0.5])], ASKED)
    assert search.search(asked, search.build(empty, 2), 3).count() == 0
    assert search.search(asked.limit(0), search.build(one, 2), 3).count() == 0
    assert _told(search.search(asked, search.build(one, 2), 3)) == [("a", 0, 0.0, 0, 1, 1, 0.0, 0.5)]
    same = spark.createDataFrame([(i, 1, 0.0, [1.0, 0.0]) for i in range(50)], LIB)
    assert [r[4] for r in _told(search.search(asked, search.build(same, 2, block_bytes=40), 3))] == [0, 1, 2]


def test_bounds_hold():
    rng = np.random.default_rng(4)
    for scale in (1e-3, 1.0, 1e6):
        v = rng.normal(size=(50, 9)) * scale + rng.normal(size=9) * 100
        q = rng.normal(size=(20, 9))
        centre = v.mean(0)
        radius = float(np.sqrt(((v - centre) ** 2).sum(1)).max())
        assert (search._reach(q, centre, radius) >= (q @ v.T).max(1)).all()


def test_products_are_bounded():
    rng = np.random.default_rng(5)
    vectors, q = rng.normal(size=(200_000, 16)).astype(np.float32), rng.normal(size=(1024, 16)).astype(np.float32)
    tracemalloc.start()
    best = search.Best(len(q), 10)
    best.meet(q, vectors, np.arange(len(vectors)))
    assert tracemalloc.get_traced_memory()[1] < 200 << 20  # all products at once would be 800 MB
    tracemalloc.stop()
    near = q[:20].astype(float) @ vectors.T.astype(float)
    assert best.ids[:200].reshape(20, 10).tolist() == np.argsort(-near, axis=1, kind="stable")[:, :10].tolist()
