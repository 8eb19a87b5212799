"""The frame source and clip sink, and rendering by one sweep over a film."""

import io
import json
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from frametide import schemas
from frametide.operators import answer_key, embedders, index
from frametide.sources import frames, videos
from frametide.sources.library import Library


def _npz(pictures, compressed=False, **more):
    out = io.BytesIO()
    (np.savez_compressed if compressed else np.savez)(out, frames=np.stack(pictures), **more)
    return out.getvalue()


def _pictures(n, seed=0, h=12, w=16):
    return list(np.random.default_rng(seed).integers(0, 256, (n, h, w, 3), np.uint8))


def _source(path, **options):
    return frames.FrameReader({"path": str(path)} | {k: str(v) for k, v in options.items()})


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("films")
    (root / "sub").mkdir()
    (root / "long.npz").write_bytes(_npz(_pictures(200), fps=10.0))
    pts = np.arange(50) / 5.0
    pts[7], pts[20] = np.nan, 0.1
    (root / "sub" / "odd.npz").write_bytes(_npz(_pictures(50, 1), True, fps=5.0, pts=pts))
    (root / "broken.npz").write_bytes(b"no archive")
    (root / "notes.txt").write_bytes(b"x")
    (root / "_hidden.npz").write_bytes(b"x")
    return root


def _read(spark, path, **options):
    spark.dataSource.register(frames.FrameSource)
    reader = spark.read.format("frames")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(str(path))


def _told(rows):
    return sorted((r["path"].rsplit("/", 1)[1], r["frame_idx"], r["t"], r["h"], r["w"], bytes(r["rgb"])) for r in rows if r["error"] is None)


def test_ranges_give_the_whole(spark, folder):
    """However a file is cut: the frames are those of a decoder that goes through it from the start."""
    for options in ({"fps": 2}, {"fps": 3, "max_frames": 9}, {}):
        want = []
        for name, made in (("long.npz", folder / "long.npz"), ("odd.npz", folder / "sub" / "odd.npz")):
            source = io.BytesIO(made.read_bytes())
            reader = videos.Arrays()
            step = 1 / reader.probe(source).fps
            numbered = ((t, (i, p)) for i, (t, p) in enumerate(reader.frames(source)))
            want += [(name, i, float(t), 12, 16, p.tobytes()) for t, (i, p) in videos.sampled(numbered, options.get("fps"), options.get("max_frames"), step)]
        for size in (1 << 20, 9000, 2000):
            df = _read(spark, folder, partition_bytes=size, **options)
            rows = df.collect()
            assert _told(rows) == sorted(want)
            errors = [r for r in rows if r["error"] is not None]
            assert len(errors) == 1 and errors[0]["path"].endswith("broken.npz")
    assert len(_source(folder / "long.npz", partition_bytes=9000).partitions()) == -(-(folder / "long.npz").stat().st_size // 9000) == _read(spark, folder / "long.npz", partition_bytes=9000).rdd.getNumPartitions()
    with pytest.raises(Exception, match="load a file"):
        frames.FrameReader({})


def test_bad_range_is_an_error_row(spark, tmp_path):
    """Pictures whose bytes are damaged: their run tells, the others give their frames."""
    raw = bytearray(_npz(_pictures(40, h=20, w=20), True, fps=10.0))
    raw[len(raw) // 2 : len(raw) // 2 + 400] = b"\xff" * 400
    (tmp_path / "a.npz").write_bytes(raw)
    rows = _read(spark, tmp_path, partition_bytes=len(raw) // 7).collect()
    good, bad = [r for r in rows if r["error"] is None], [r for r in rows if r["error"] is not None]
    assert 10 <= len(good) < 40 and 1 <= len(bad) <= 8
    head = _npz(_pictures(3), fps=10.0, pts=np.zeros(5))
    (tmp_path / "a.npz").write_bytes(head)
    assert [r["error"] for r in _read(spark, tmp_path, partition_bytes=500).collect()] == ["not as many times as pictures"]


def test_memory_of_a_reader(tmp_path):
    """A file of 120 MB is read a few pictures at a time, and a run of it touches its own bytes."""
    pictures = np.zeros((500, 240, 336, 3), np.uint8)
    np.savez(tmp_path / "big.npz", frames=pictures, fps=25.0)
    del pictures
    reader = _source(tmp_path / "big.npz", fps=5, partition_bytes=16 << 20)
    runs = reader.partitions()
    tracemalloc.start()
    n = sum(batch.num_rows for run in runs for batch in reader.read(run))
    assert n == 100 and len(runs) == 8 and tracemalloc.get_traced_memory()[1] < 24 << 20
    tracemalloc.stop()


def test_stream_of_files(spark, tmp_path):
    spark.dataSource.register(frames.FrameSource)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.npz").write_bytes(_npz(_pictures(20), fps=10.0))

    def run():
        stream = spark.readStream.format("frames").option("fps", 5).load(str(tmp_path / "in"))
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).start(str(tmp_path / "out"))
        query.processAllAvailable()
        query.stop()
        return {r["path"].rsplit("/", 1)[1]: r["count"] for r in spark.read.parquet(str(tmp_path / "out")).groupBy("path").count().collect()}

    assert run() == {"a.npz": 10}
    (tmp_path / "in" / "b.npz").write_bytes(_npz(_pictures(10), fps=10.0))
    assert run() == {"a.npz": 10, "b.npz": 5}  # from the checkpoint: nothing is read twice


CLIP = "query_id string, t double, h int, w int, rgb binary, error string"


def test_sink_commits_whole(spark, tmp_path):
    rows = [(f"q/{c}", i / 2, 2, 2, bytes([c * 10 + i] * 12), None) for c in range(5) for i in range(4)] + [("lost", None, None, None, None, "no film")]
    df = spark.createDataFrame(rows, CLIP).repartition(3)
    frames.save_clips(df, str(tmp_path / "out"), 2.0)
    told = json.loads((tmp_path / "out" / "_SUCCESS").read_text())
    assert told == {"clips": [f"q%2F{c}.npz" for c in range(5)], "errors": {"lost": "no film"}}
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["_SUCCESS", *told["clips"]]
    got = _read(spark, tmp_path / "out").collect()
    assert sorted((r["path"][-5], r["frame_idx"], r["t"], r["rgb"][0]) for r in got) == [(str(c), i, i / 2, c * 10 + i) for c in range(5) for i in range(4)]
    bad = df.union(spark.createDataFrame([("q/9", 0.0, 9, 9, b"short", None)], CLIP))
    with pytest.raises(Exception, match="reshape"):
        frames.save_clips(bad, str(tmp_path / "out"), 2.0)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["_SUCCESS", *told["clips"]]  # nothing is left of it
    frames.save_clips(df.where("query_id = 'q/1'"), str(tmp_path / "out"), 2.0, overwrite=True)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["_SUCCESS", "q%2F1.npz"]


def _plain_clip(content, start, length, kind, seed, fps):
    """The clip by itself: decoded from the start."""
    reader, source = videos.Arrays(), io.BytesIO(content)
    step, speed = 1 / reader.probe(source).fps, answer_key.DISTORTIONS[kind]
    cut = (((t - start) / speed, p) for t, p in videos.repaired(reader.frames(source), step) if start - 1e-6 <= t < start + length - 1e-6)
    return [(t, embedders.distort(embedders.capped_height(p), kind, np.random.default_rng(seed)).tobytes()) for t, p in videos.sampled(cut, fps)]


def test_render_sweeps_each_film_once(spark, monkeypatch):
    """Overlapping, nested, empty and equal clips of two films: equal frames, a decode a film."""
    pts = np.arange(150) / 10.0
    pts[33] = np.nan
    content = {"f1": _npz(_pictures(150, 1), fps=10.0, pts=pts), "f2": _npz(_pictures(90, 2), True, fps=10.0), "f3": b"broken"}
    rng, kinds, rows = np.random.default_rng(3), list(answer_key.DISTORTIONS), []
    for i in range(40):
        kind = kinds[i % len(kinds)]
        start, length = float(rng.uniform(0, 12)), float(rng.choice([0.0, 0.05, 2.0, 5.0, 30.0]))
        rows.append((f"q{i}", f"b{i}", f"f{1 + i % 3}", "library", "g", "val", start, length, 4.0, kind, i, start))
    specs = spark.createDataFrame(rows, schemas.QUERY_SPECS)
    sources = spark.createDataFrame([(k, f"/x/{k}.npz", bytearray(v)) for k, v in content.items()], "film_id string, path string, content binary")
    got = {}
    for r in videos.render(specs, sources, 3.0).collect():
        got.setdefault(r["query_id"], []).append((r["t"], bytes(r["rgb"]) if r["rgb"] else r["error"]))
    for q, _, film, _, _, _, start, length, _, kind, seed, _ in rows:
        if film == "f3":
            assert len(got[q]) == 1 and "zip" in got[q][0][1]
        else:
            want = _plain_clip(content[film], start, length, kind, seed, 3.0)
            assert [t for t, _ in got.get(q, [])] == pytest.approx([t for t, _ in want]) and [p for _, p in got.get(q, [])] == [p for _, p in want], q
    opened = []
    monkeypatch.setattr(videos.Arrays, "pictures", lambda self, source, places, of=videos.Arrays.pictures: opened.append(len(places)) or of(self, source, places))
    clips = [videos._Clip("a", 1.0, 9.0, "original", 0, 1.0, videos.Grid(3.0)), videos._Clip("b", 2.0, 6.0, "original", 0, 1.0, videos.Grid(3.0))]
    taken = list(videos._swept(videos.Arrays(), io.BytesIO(content["f1"]), 0.1, clips))
    assert opened == [len(taken)] and sum(len(x) for _, x in taken) == 24 + 12


def test_index_decodes_once(spark, tmp_path):
    (tmp_path / "a.npz").write_bytes(_npz(_pictures(20), fps=10.0))
    (tmp_path / "b.npz").write_bytes(b"no archive")
    rows = videos.files(spark, [str(tmp_path)])
    sampled = videos.sample(rows, 2.0)
    plan = embedders.embed_or_tell(sampled.withColumnRenamed("path", "video_id"), ["tiny16"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("binaryFile") == 1 and plan.count("MapInArrow") == 2
    made, failed = index.query_frames(rows, "tiny16")
    assert made.count() == 6 and [r["clip_id"][-5:] for r in failed.collect()] == ["b.npz"]
    assert "MapInArrow" not in made._jdf.queryExecution().executedPlan().toString()
    checked = index.checked(rows, Library.empty(spark, "tiny16", 256))
    assert checked._jdf.queryExecution().executedPlan().toString().count("binaryFile") == 1
    small = videos.limited(rows, 0.00005)
    assert "length" in small._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["path"][-5:], r["content"] is None) for r in small.collect()) == [("a.npz", True), ("b.npz", False)]
    assert videos.probe(small.where(F.col("path").endswith("a.npz"))).first()["error"] == "the file can't be read"


def test_block_compression_and_tilt():
    """Against plain sums and loops."""
    rng = np.random.default_rng(6)
    image = rng.integers(0, 256, (10, 13, 3), np.uint8)
    padded = np.pad(image.astype(float), ((0, 6), (0, 3), (0, 0)), mode="edge")
    planes = np.stack([sum(row[c] * padded[..., c] for c in range(3)) for row in embedders.TO_PLANES], -1)
    basis = np.array([[np.sqrt((1 if k == 0 else 2) / 8) * np.cos(np.pi * (2 * i + 1) * k / 16) for i in range(8)] for k in range(8)])
    for by in range(2):
        for bx in range(2):
            for c in range(3):
                block = planes[by * 8 : by * 8 + 8, bx * 8 : bx * 8 + 8, c]
                steps = np.array([[max(1.0, 20.0 * (1 + u + v) / 4) * (1 if c == 0 else 2) for v in range(8)] for u in range(8)])
                block[:] = basis.T @ (np.rint(basis @ block @ basis.T / steps) * steps) @ basis
    want = np.clip(np.rint(planes @ np.linalg.inv(embedders.TO_PLANES).T), 0, 255)[:10, :13]
    assert np.abs(embedders.compress_blocks(image, 20.0).astype(int) - want).max() <= 1
    flat = np.full((16, 16, 3), 100, np.uint8)
    assert np.abs(embedders.compress_blocks(flat, 4.0).astype(int) - 100).max() <= 1
    harsh = [np.abs(embedders.compress_blocks(image, s).astype(int) - image).mean() for s in (0.0, 8.0, 60.0)]
    assert harsh[0] < 1 < harsh[1] < harsh[2]

    assert (embedders.tilt(image, 0.0) == image).all()
    turned, angle = embedders.tilt(image, 0.3), 0.3
    for y in range(10):
        for x in range(13):
            sx, sy = np.cos(angle) * (x - 6) + np.sin(angle) * (y - 4.5) + 6, -np.sin(angle) * (x - 6) + np.cos(angle) * (y - 4.5) + 4.5
            total = np.zeros(3)
            for py in (int(np.floor(sy)), int(np.floor(sy)) + 1):
                for px in (int(np.floor(sx)), int(np.floor(sx)) + 1):
                    if 0 <= py < 10 and 0 <= px < 13:
                        total += (1 - abs(sx - px)) * (1 - abs(sy - py)) * image[py, px]
            assert np.abs(turned[y, x] - total).max() <= 0.51
    made = embedders.distort(image, "screen_recording", np.random.default_rng(1))
    assert made.shape == (8, 11, 3) and (made == embedders.distort(image, "screen_recording", np.random.default_rng(1))).all()
