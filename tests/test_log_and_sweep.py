"""The library's log of changes, dense numbers, and the threshold sweep, against plain versions."""

import json
import math
import random
from concurrent.futures import ThreadPoolExecutor

import pytest

from frametide.operators import evaluate
from frametide.sources import library
from frametide.sources.library import Library, LibraryError
from frametide.staging import numbered

VIDEOS = "video_id string, source_path string, sha256 string, duration_s double, sample_fps double, indexed_at string"
FRAMES = "video_id string, t double, vector array<float>"


def _batch(spark, *names, n=3):
    videos = spark.createDataFrame([(v, "p", f"sha-{v}", 1.0, 2.0, "x") for v in names], VIDEOS)
    return videos, spark.createDataFrame([(v, t / 2, [1.0, float(t)]) for v in names for t in range(n)], FRAMES)


def _held(lib):
    names = {r["key"]: r["video_id"] for r in lib.videos.collect()}
    out = {v: 0 for v in names.values()}
    for r in lib.vectors.collect():
        out[names[r["key"]]] += 1
    return out


def _segments(root):
    return {p.name: sorted(x.name for x in p.iterdir()) for p in (root / "segments").iterdir()}


def test_a_change_writes_its_own_rows_only(spark, tmp_path):
    root = str(tmp_path)
    lib = Library.empty(spark, "tiny", 2).add(*_batch(spark, *[f"v{i}" for i in range(20)])).save(root)
    before = _segments(tmp_path)
    one = lib.add(*_batch(spark, "new", n=5)).save(root)
    (name,) = set(_segments(tmp_path)) - set(before)
    assert spark.read.parquet(f"{root}/segments/{name}/lib_vectors").count() == 5 and spark.read.parquet(f"{root}/segments/{name}/videos").count() == 1
    assert len(_held(one)) == 21 and (one.next_id, one.next_key) == (65, 21)
    gone = one.remove(["v3", "new"]).save(root)
    (dead,) = set(_segments(tmp_path)) - set(before) - {name}
    assert _segments(tmp_path)[dead] == ["tombstones"]
    assert set(_held(gone)) == {f"v{i}" for i in range(20)} - {"v3"} and gone.totals().first()["n_vectors"] == 57
    again = gone.add(*_batch(spark, "v3", n=2)).save(root)  # a removed key doesn't come back
    assert _held(again)["v3"] == 2 and again.get("v3").first()["key"] == 21 and Library.load(spark, root).next_id == 67
    swapped = again.add(*_batch(spark, "v3", n=4), replace=True).save(root)
    assert _held(swapped)["v3"] == 4 and len(_held(swapped)) == 20
    mixed = swapped.add(*_batch(spark, "x", "y")).remove(["x", "v0"]).add(*_batch(spark, "z")).save(root)
    assert {"y", "z"} <= set(_held(mixed)) and not {"x", "v0"} & set(_held(mixed))
    # another root gets the whole
    copied = mixed.save(str(tmp_path / "copy"))
    assert _held(copied) == _held(mixed) and len(_segments(tmp_path / "copy")) == 1


def test_compaction_and_vacuum(spark, tmp_path):
    root = str(tmp_path)
    lib = Library.empty(spark, "tiny", 2).add(*_batch(spark, "a", "b")).save(root)
    lib = lib.add(*_batch(spark, "c")).save(root).remove(["a"]).save(root)
    with pytest.raises(LibraryError):
        lib.remove(["b"]).compact(root)
    packed = lib.compact(root)
    manifest = json.loads((tmp_path / "manifest" / "v4.json").read_text())
    assert len(manifest["segments"]) == 1 and not manifest["tombstones"] and _held(packed) == {"b": 3, "c": 3}
    assert (packed.next_id, packed.next_key) == (9, 3) and {r["key"] for r in packed.videos.collect()} == {1, 2}
    assert len(_segments(tmp_path)) == 4 and len(Library.vacuum(spark, root)) == 3 and list(_segments(tmp_path)) == manifest["segments"]
    assert _held(Library.load(spark, root).add(*_batch(spark, "d")).save(root)) == {"b": 3, "c": 3, "d": 3}
    with pytest.raises(LibraryError):
        packed.add(*_batch(spark, "e")).save(root)  # v5 came in between


def test_two_writers_and_crashes(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    lib = Library.empty(spark, "tiny", 2).add(*_batch(spark, "a")).save(root)
    one, two = lib.add(*_batch(spark, "b")), lib.add(*_batch(spark, "c"))
    with ThreadPoolExecutor(2) as pool:
        results = [r.exception() for r in [pool.submit(one.save, root), pool.submit(two.save, root)]]
    assert sorted(type(r) for r in results if r is not None) == [LibraryError] and results.count(None) == 1
    assert set(_held(Library.load(spark, root))) in ({"a", "b"}, {"a", "c"})
    # the writer dies after its rows, before its manifest
    held = Library.load(spark, root)
    monkeypatch.setattr(library, "_create", lambda *_: (_ for _ in ()).throw(RuntimeError("died")))
    with pytest.raises(RuntimeError):
        held.add(*_batch(spark, "lost")).save(root)
    monkeypatch.undo()
    assert "lost" not in _held(Library.load(spark, root))
    # the writer dies over its manifest: it is passed over, its number isn't used again
    (tmp_path / "manifest" / "v3.json").write_text('{"schema_version": 2, "emb')
    after = Library.load(spark, root).add(*_batch(spark, "d")).save(root)
    assert "d" in _held(after) and (tmp_path / "manifest" / "v4.json").exists()
    assert not library._create(spark, f"{root}/manifest/v4.json", "x")
    (tmp_path / "manifest" / "v5.json").write_text(json.dumps(json.loads((tmp_path / "manifest" / "v4.json").read_text()) | {"schema_version": 1}))
    with pytest.raises(LibraryError, match="schema version"):
        Library.load(spark, root)


def test_dense_numbers(spark):
    rng = random.Random(1)
    rows = [(f"{rng.random():.9f}", rng.randint(0, 5), i) for i in range(500)] + [(None, 2, -1)]
    df = spark.createDataFrame(rows, "name string, size int, other int").repartition(5)
    made = numbered(df, "name", "size")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    want, before = [], 0
    for i, (name, size, other) in enumerate(sorted(rows, key=lambda r: r[0] or "")):
        want.append((name, size, other, i, before))
        before += size
    assert [tuple(r) for r in made.orderBy("_n").collect()] == want
    assert numbered(df.limit(0), "name").count() == 0
    lib = Library.empty(spark, "tiny", 2).add(*_batch(spark, "b", "a", "c"))
    assert "SinglePartition" not in lib.vectors._jdf.queryExecution().executedPlan().toString()
    assert {r["video_id"]: r["key"] for r in lib.videos.collect()} == {"a": 0, "b": 1, "c": 2}


@pytest.mark.parametrize("most", [True, False])
def test_sweep_counts_each_row_once(spark, most):
    """NaN, null, infinite and edge values, points that aren't a full product; no join of rows with points."""
    rng = random.Random(5)
    odd = [None, math.nan, math.inf, -math.inf, 0.0, -0.0, 0.1, 0.3, 0.30000000000000004, 0.5, 0.7, 1.0]
    value = lambda: rng.choice(odd) if rng.random() < 0.5 else rng.random()
    rows = [(rng.random() < 0.6, rng.random() < 0.5, rng.choice(["x", "x", None]), rng.random() < 0.1, value(), value()) for _ in range(600)]
    df = spark.createDataFrame(rows, "known boolean, correct boolean, candidate string, failed boolean, confidence double, feature double")
    points = [(p, q) for p in (0.0, 0.1, 0.3, 0.5, 0.995) for q in (0.0, 0.3, 0.7, 1.0)][:-3]
    grid = spark.createDataFrame(points, "primary double, secondary double")
    swept = evaluate.sweep(df, grid, most)
    known = [r for r in rows if r[0]]
    unknown = [r for r in rows if not r[0]]

    def passes(r, p, q):
        _, _, candidate, failed, c, f = r
        return candidate is not None and not failed and c is not None and f is not None and not math.isnan(c) and not math.isnan(f) and c >= p and (f <= q if most else f >= q)

    want = {(p, q): (sum(passes(r, p, q) and r[1] for r in known) / len(known), sum(passes(r, p, q) for r in unknown) / len(unknown)) for p, q in points}
    got = {(r["primary"], r["secondary"]): (r["dir"], r["far"]) for r in swept.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert "NestedLoop" not in evaluate.sweep(df, grid, most).drop("far", "dir")._jdf.queryExecution().optimizedPlan().toString()
    none = evaluate.sweep(df.where("known and not known"), grid, most).collect()
    assert len(none) == len(points) and all((r["dir"], r["far"]) == (0.0, 0.0) for r in none)
