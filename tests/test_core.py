import numpy as np
import pytest
from pyspark.sql import functions as F

from frametide.functions import columns as C
from frametide.operators import aligned, answer_key, embedders, evaluate, sampling, search, voting
from frametide.sources.library import Library, LibraryError

HITS = "clip_id string, q_idx int, q_t double, rank int, key int, ref_t double, score double"


def _hits(spark, rows):
    """rows: per frame, a list of (key, ref_t, score); frames are 1/3 s apart."""
    return spark.createDataFrame([("c", i, i / 3, r, k, float(t), float(s)) for i, hits in enumerate(rows) for r, (k, t, s) in enumerate(hits)], HITS)


def _clips(spark, n):
    return spark.createDataFrame([("c", n)], "clip_id string, n_frames long")


def test_consistent_offset_is_accepted(spark):
    got = aligned.decide(_hits(spark, [[(1, 7.3 + i / 3, 0.9), (2, 50 - 3 * i, 0.6)] for i in range(12)]), _clips(spark, 12)).first()
    assert got["accepted"] and got["candidate_key"] == 1 and abs(got["offset_s"] - 7.3) < 0.01 and got["coverage"] == 1 and len(got["evidence"]) == 10


def test_unaligned_is_low_score_and_equals_are_ambiguous(spark):
    got = aligned.decide(_hits(spark, [[(1, 13.0 * (i * 7 % 12), 0.9)] for i in range(12)]), _clips(spark, 12)).first()
    assert not got["accepted"] and got["reason"] == "low_score" and got["confidence"] < 0.3
    got = aligned.decide(_hits(spark, [[(1, 5 + i / 3, 0.9), (2, 9 + i / 3, 0.9)] for i in range(12)]), _clips(spark, 12)).first()
    assert got["reason"] == "ambiguous" and got["candidate_key"] == 1 and got["ratio"] == 1


def test_static_shot_counts_once_a_frame(spark):
    got = aligned.decide(_hits(spark, [[(1, 5.0, 0.9), (1, 5.1, 0.9), (1, 5.2, 0.9)]]), _clips(spark, 4)).first()
    assert abs(got["confidence"] - 0.225) < 1e-9


def test_no_hits_and_scores_of_zero(spark):
    none = _hits(spark, [[(1, 0, 0.5)]]).where("false")
    for rule in (aligned, voting):
        assert rule.decide(none, _clips(spark, 3)).first()["reason"] == "no_candidates"
    got = aligned.decide(_hits(spark, [[(1, 0, -0.5)]]), _clips(spark, 1)).first()
    assert got["reason"] == "low_score" and got["offset_s"] is None and got["ratio"] == 1


def test_v1_falls_back_to_all_hits(spark):
    got = voting.decide(_hits(spark, [[(1, 13.0 * (i * 7 % 12), 0.95)] for i in range(12)]), _clips(spark, 12)).first()
    assert not got["aligned"] and got["align_ratio"] == 1 and got["accepted"]


def test_v1_against_plain_loops(spark):
    rng = np.random.default_rng(3)
    rows, n_clips = [], 25
    for c in range(n_clips):
        for q in range(int(rng.integers(1, 15))):
            for r, s in enumerate(sorted(rng.uniform(0.3, 1, 4), reverse=True)):
                rows.append((f"c{c}", q, q / 2, r, int(rng.integers(0, 3)), float(rng.integers(0, 20)) / 2, float(np.float32(s))))
    clips = spark.createDataFrame([(f"c{c}", 20) for c in range(n_clips)], "clip_id string, n_frames long")
    got = {r["clip_id"]: r for r in voting.decide(spark.createDataFrame(rows, HITS), clips).collect()}
    for c in range(n_clips):
        own = [r for r in rows if r[0] == f"c{c}"]
        keys = {}
        for r in own:
            n, s = keys.get(r[4], (0, 0.0))
            keys[r[4]] = (n + 1, s + r[6])
        best = max(keys, key=lambda k: keys[k])
        hits = sorted((r for r in own if r[4] == best), key=lambda r: -r[6])
        bins = [int(np.floor(np.float32(r[5] - r[2]) / 0.5)) for r in hits]
        top = max(dict.fromkeys(bins), key=bins.count)
        offset = (top + 0.5) * 0.5
        near = [r for r in hits if abs(r[5] - r[2] - offset) <= 0.75]
        fits = len(near) >= max(5, int(0.3 * len(hits)))
        x = got[f"c{c}"]
        assert (x["candidate_key"], x["offset_s"], x["aligned"]) == (best, offset, fits)
        assert x["vote_ratio"] == pytest.approx(keys[best][0] / len(own)) and x["align_ratio"] == pytest.approx(len(near) / len(hits) if fits else 1)


def test_search_forms_agree(spark):
    rng = np.random.default_rng(1)
    unit = lambda n: embedders.unit_rows(rng.normal(size=(n, 8))).tolist()
    lib = spark.createDataFrame([(i, i % 3, i / 2, v) for i, v in enumerate(unit(50))] + [(99, 1, 0.0, None)], "vector_id long, key int, t double, vector array<float>")
    q = spark.createDataFrame([("c", i, float(i), v) for i, v in enumerate(unit(7))], "clip_id string, q_idx int, q_t double, vector array<float>")
    told = lambda df: sorted((r["q_idx"], r["rank"], r["vector_id"]) for r in df.collect())
    one = told(search.topk(q, lib, 5, 8))
    assert len(one) == 35 and one == told(search.topk(q, lib, 5, 8, broadcast_bytes=0, block_bytes=9 * 8 * 4)) == told(search.topk_sql(q, lib.where("vector is not null"), 5))
    assert search.topk(q, lib.where("false"), 5, 8).count() == 0


def test_library(spark, tmp_path):
    videos = spark.createDataFrame([("a", "p", "s1", 1.0, 2.0, "x"), ("b", "p", "s2", 1.0, 2.0, "x")], "video_id string, source_path string, sha256 string, duration_s double, sample_fps double, indexed_at string")
    frames = spark.createDataFrame([(v, t / 2, [1.0, 0.0]) for v in "ab" for t in range(3)], "video_id string, t double, vector array<float>")
    root = str(tmp_path / "lib")
    lib = Library.open_or_create(spark, root, "tiny", 2).add(videos, frames).save(root)
    assert (lib.next_id, lib.next_key) == (6, 2) and sorted(r["vector_id"] for r in lib.vectors.collect()) == list(range(6))
    with pytest.raises(LibraryError):
        Library.open_or_create(spark, str(tmp_path / "lib"), "tiny", 3)
    again = lib.remove(["a"]).save(root)
    assert again.vectors.count() == 3 and again.next_id == 6
    new = again.add(videos.where("video_id = 'a'"), frames.where("video_id = 'a'")).save(root)
    assert {r["key"] for r in new.videos.collect()} == {1, 2} and min(r["vector_id"] for r in new.vectors.where("key = 2").collect()) == 6
    with pytest.raises(LibraryError):
        Library.open_or_create(spark, root, "other", 2)
    for bad in (videos, videos.withColumn("video_id", F.lit("../x")).limit(1), videos.limit(1).withColumn("video_id", F.lit("c"))):
        with pytest.raises(LibraryError):
            new.add(bad, frames)
    with pytest.raises(LibraryError):
        new.remove(["none"])


def test_sampling_and_repair(spark):
    frames = spark.createDataFrame([("v", i, i / 15, i != 8) for i in range(45)], "video_id string, frame_idx long, t double, decodable boolean")
    got = [r["t"] for r in sampling.grid_sample(frames, 2.0).orderBy("t").collect()]
    assert len(got) == 6 and all(0 <= t - k / 2 < 0.15 for k, t in enumerate(got))
    assert sampling.grid_sample(frames, 2.0, 4).count() == 4
    fixed = sampling.repair_times(spark.createDataFrame([("v", 0, 0.0), ("v", 1, 0.0), ("v", 2, None), ("v", 3, 5.0)], "video_id string, frame_idx long, pts double"), 10.0)
    assert [round(r["t"], 6) for r in fixed.orderBy("frame_idx").collect()] == [0.0, 0.1, 0.2, 5.0]


def test_embedders():
    rng = np.random.default_rng(0)
    frames = [rng.integers(0, 256, (96, 160, 3), np.uint8) for _ in range(4)]
    for name in ("tiny16", "phash64"):
        e = embedders.create(name)
        v = e.embed(frames)
        assert v.shape == (4, e.dim) and np.allclose(np.linalg.norm(v, axis=1), 1, atol=1e-5)
        assert np.allclose(v[[2, 0]], e.embed([frames[2], frames[0]]))
    bits = embedders.create("phash64").embed(frames) > 0
    assert embedders.create("phash64").embed(frames)[0] @ embedders.create("phash64").embed(frames)[1] == pytest.approx(1 - 2 * (bits[0] != bits[1]).sum() / 64)
    with pytest.raises(ValueError):
        embedders.create("none")
    assert all(embedders.distort(frames[0], k, rng).ndim == 3 for k in answer_key.DISTORTIONS)


def test_answer_key(spark):
    films = spark.createDataFrame([("f1", "library", "g", 600.0, 0.0), ("f2", "heldout", "g", 900.0, 0.5)], "film_id string, role string, `group` string, duration_s double, pts_shift_s double")
    specs = answer_key.build(films, seed=4)
    rows = specs.collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, answer_key.build(films, seed=4).collect())) and len({r["query_id"] for r in rows}) == len(rows)
    assert evaluate.overlaps(specs).isEmpty() and specs.select("base_id", "split").distinct().count() == specs.select("base_id").distinct().count()
    assert sorted(map(tuple, answer_key.build(films.limit(1), seed=4).collect())) == sorted(tuple(r) for r in rows if r["film_id"] == "f1")


def test_missing_features_fail_the_gate(spark):
    rows = spark.createDataFrame([("a", "f", float("nan"), 0.5, False), ("b", "f", 0.9, None, False), ("c", None, 0.9, 0.5, False), ("d", "f", 0.9, 0.5, True), ("e", "f", 0.9, 0.5, False)], "q string, candidate string, confidence double, feature double, failed boolean")
    assert [r["q"] for r in rows.where(evaluate.accepted(F.lit(0.8), F.lit(0.8), True)).collect()] == ["e"]


def test_ids(spark):
    rows = spark.createDataFrame([("/x/My clip (1).mp4",), ("/x/...",), ("/x/a.b.mkv",)], "path string")
    assert [r[0] for r in rows.select(C.video_id_of(F.col("path"))).collect()] == ["My-clip-1", "video", "a.b"]


def test_valid_id_takes_the_whole_url(spark, tmp_path):
    from frametide.plans import catalog

    rows = [(1, "a" * 60 + "/b"), (2, "a" * 60), (3, "a" * 129), (4, "http://a")]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    assert {r["page_id"]: r["ok"] for r in catalog.QUERIES["valid_id"](spark, str(tmp_path)).collect()} == {1: False, 2: True, 3: False, 4: False}


def _npz(frames, **more):
    import io

    out = io.BytesIO()
    np.savez(out, frames=np.stack(frames), **more)
    return out.getvalue()


def _picture(seed, t):
    """A scene for every 3 s with a bar that moves."""
    rng = np.random.default_rng([seed, int(t // 3)])
    out = np.full((48, 64, 3), rng.integers(0, 256, 3), np.uint8)
    for _ in range(6):
        y, x = rng.integers(0, 40), rng.integers(0, 50)
        out[y : y + 14, x : x + 20] = rng.integers(0, 256, 3)
    out[:, int(t * 7) % 64] = 255
    return out


@pytest.fixture(scope="module")
def media(tmp_path_factory):
    """Two videos, a copy of one, a clip of the first from 6 s on, a clip of none, and two bad files."""
    root = tmp_path_factory.mktemp("media")
    for d in ("ref", "clips"):
        (root / d).mkdir()
    video = lambda seed, lo, hi: _npz([_picture(seed, t) for t in np.arange(lo, hi, 0.2)], fps=5.0)
    for name, seed in (("ref a", 1), ("ref_b", 2), ("ref_c", 1)):
        (root / "ref" / f"{name}.npz").write_bytes(video(seed, 0, 15))
    (root / "ref" / "broken.npz").write_bytes(b"no archive")
    (root / "ref" / "empty.npz").write_bytes(_npz([np.zeros((4, 4, 3), np.uint8)], fps=0.0))
    (root / "clips" / "known.npz").write_bytes(video(1, 6, 11))
    (root / "clips" / "unknown.npz").write_bytes(video(9, 0, 5))
    return root


def test_index_and_match(spark, media, tmp_path):
    from frametide.config import Settings
    from frametide.operators import index, matcher
    from frametide.sources import videos

    lib = Library.empty(spark, "tiny16", 256)
    lib, report = index.index(lib, videos.files(spark, [str(media / "ref")]))
    told = {r["path"].rsplit("/", 1)[1]: (r["video_id"], r["n_vectors"], r["error"]) for r in report.collect()}
    assert told["ref a.npz"] == ("ref-a", 30, None)
    assert told["ref_b.npz"] == ("ref_b", 30, None) and told["ref_c.npz"][2] == "the content comes twice" and told["empty.npz"][2] == "no frames, rate or size" and told["broken.npz"][2]
    lib = lib.save(str(tmp_path / "lib"))
    totals = lib.totals().first()
    assert (totals["n_videos"], totals["n_vectors"], totals["index_bytes"]) == (2, 60, 60 * 256 * 4) and totals["hours"] == pytest.approx(30 / 3600)
    names = [r["video_id"] for r in lib.listing().collect()]
    assert names == sorted(names) and "source_path" not in lib.listing().columns
    one = lib.get("ref_b").first()
    assert lib.by_key(one["key"]).first()["video_id"] == "ref_b" == lib.find_by_sha256(one["sha256"]).first()["video_id"] and lib.get("none").isEmpty()
    _, again = index.index(lib, videos.files(spark, [str(media / "ref")]))
    assert {r["error"] for r in again.where("video_id = 'ref_b'").collect()} == {"exists"}
    clips, failures = index.query_frames(videos.limited(videos.files(spark, [str(media / "clips"), str(media / "ref" / "broken.npz")]), 10), "tiny16")
    assert failures.count() == 1
    got = {r["clip_id"].rsplit("/", 1)[1]: r for r in matcher.match(clips, lib, Settings(), "tiny16").collect()}
    assert got["known.npz"]["status"] == "match" and got["known.npz"]["video_id"] != "ref_b" and abs(got["known.npz"]["offset_s"] - 6) < 0.3 and got["unknown.npz"]["status"] == "unknown"
    with pytest.raises(ValueError):
        matcher.match(clips, lib, Settings(), "phash64")
    assert {r["error"] for r in videos.probe(videos.limited(videos.files(spark, [str(media / "clips")]), 0.0001)).collect()} == {"the file can't be read"}


def test_render_and_store(spark, media, tmp_path):
    from frametide.operators import index, report
    from frametide.sources import store, videos
    from frametide.streaming import frames as streams

    films = spark.createDataFrame([("f1", "library", "g", 300.0, 0.0)], "film_id string, role string, `group` string, duration_s double, pts_shift_s double")
    base = [(f"q{i}-{k}", f"q{i}", "f1", "library", "g", "val", 2.0, 4.0 * answer_key.DISTORTIONS[k], 4.0, k, 5, 2.0) for i, k in enumerate(answer_key.DISTORTIONS)]
    from frametide import schemas

    specs = spark.createDataFrame(base, schemas.QUERY_SPECS)
    source = videos.files(spark, [str(media / "ref" / "ref_b.npz")]).withColumn("film_id", F.lit("f1")).drop("length")
    made = videos.render(specs, source, 2.0)
    times = {}
    for r in made.collect():
        assert r["error"] is None and len(r["rgb"]) == r["h"] * r["w"] * 3
        times.setdefault(r["query_id"].split("-")[1], []).append(r["t"])
    assert set(times) == set(answer_key.DISTORTIONS) and all(len(t) == 8 and max(t) < 4 for t in times.values())
    vectors = embedders.embed_frames(made.where("query_id like 'q%'").withColumnRenamed("query_id", "video_id"), ["tiny16"]).selectExpr("video_id query_id", "cast(row_number() over (partition by video_id order by t) - 1 as int) q_idx", "cast(t as float) q_t", "vector")
    held = store.QueryStore(spark, str(tmp_path / "store"), "tiny16", 256, "digest")
    failed = spark.createDataFrame([("q3-crop", "lost")], store.FAILURES)
    assert held.todo(specs).count() == 10 and [r["query_id"] for r in held.todo(specs, 2).collect()] == sorted(x[0] for x in base)[:2]
    assert held.append(vectors.where("query_id < 'q5'").where("query_id <> 'q3-crop'"), "a", failed) and not held.append(vectors, "a")
    assert tuple(held.status(specs).first()) == ("tiny16", 10, 4, 1, 5)
    with pytest.raises(LibraryError):
        held.present(specs)
    assert held.present(specs, allow_partial=True).count() == 4
    assert held.embed(specs, lambda todo: (vectors.join(todo, "query_id", "left_semi"), failed.limit(0)), "b") and held.todo(specs).isEmpty() and held.load().select("query_id").distinct().count() == 9
    with pytest.raises(LibraryError):
        store.QueryStore(spark, str(tmp_path / "store"), "phash64", 64, "digest")
    # clips that come into a folder become shards; what is done is not done again
    clips = store.QueryStore(spark, str(tmp_path / "clips"), "tiny16", 256)

    def embed(batch):
        rows, bad = index.query_frames(batch, "tiny16")
        return rows.withColumnRenamed("clip_id", "query_id"), bad.withColumnRenamed("clip_id", "query_id")

    for _ in range(2):
        streams.embed_arriving(streams.arriving(spark, str(media / "clips"), 1), clips, embed, str(tmp_path / "check")).awaitTermination(120)
        assert clips.load().select("query_id").distinct().count() == 2
    assert report.counts(answer_key.build(films)).first()["n_distortions"] == 10


def test_stream_repairs_times(spark, tmp_path):
    from frametide.streaming import frames as streams

    rng = np.random.default_rng(2)
    rows = [(v, i, None if rng.random() < 0.2 else float(rng.integers(0, 12)), i // 7) for v in "ab" for i in range(20)]
    whole = spark.createDataFrame(rows, "video_id string, frame_idx long, pts double, part long")
    for part in range(3):
        whole.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("video_id string, frame_idx long, pts double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = streams.repair_times(stream, 10.0).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).option("path", str(tmp_path / "out")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    plain = []
    for v in "ab":
        before = -1.0
        for _, i, pts, _ in (r for r in rows if r[0] == v):
            before = pts if pts is not None and pts > before else before + 0.1
            plain.append((v, i, round(before, 6)))
    told = lambda df: sorted((r["video_id"], r["frame_idx"], round(r["t"], 6)) for r in df.collect())
    assert told(spark.read.parquet(str(tmp_path / "out"))) == sorted(plain) == told(sampling.repair_times(whole, 10.0))


def test_sampler_is_the_closed_form():
    from frametide.sources import videos

    rng = np.random.default_rng(4)
    for _ in range(50):
        fps, step = float(rng.choice([0.5, 2, 3, 7])), 1 / 30
        pts = [None if rng.random() < 0.1 else float(x) for x in np.cumsum(rng.choice([0, 0.04, 0.3, 1.1], 60))]
        seen = [(p, None if rng.random() < 0.2 else np.zeros((2, 2, 3), np.uint8)) for p in pts]
        got = [t for t, _ in videos.sampled(iter(seen), fps, None, step)]
        want, before, used = [], -1.0, set()
        for p, picture in seen:
            before = p if p is not None and p > before else before + step
            bucket = int(np.floor((before + 1e-6) * fps))
            if picture is not None and bucket >= 0 and bucket not in used:
                used.add(bucket)
                want.append(before)
        assert got == want


def test_films(spark, tmp_path):
    from frametide.sources import films, files
    import json

    listed = [{"id": f"f{i}", "title": "t", "role": "library" if i < 2 else "heldout", "group": f"g{i % 2}", "md5": f"{i:032x}", "archive": "zip" if i else ""} for i in range(4)]
    path = str(tmp_path / "m.json")
    (tmp_path / "m.json").write_text(json.dumps({"films": listed}))
    rows = files.manifest(spark, path)
    assert films.by_role(rows, "library").count() == 2 == films.only(rows, ["f1", "f3"]).count() and films.film(rows, "f2").count() == 1 and films.uncovered(rows).isEmpty() and len(files.manifest_digest(spark, path)) == 64
    for record in ({"film_id": "f0", "path": "p", "duration_s": 3.0}, {"film_id": "f1", "path": "p", "duration_s": 3.0, "pts_shift_s": 0.5}):
        films.save_record(spark, str(tmp_path / "records"), record)
    held = films.records(spark, str(tmp_path / "records" / "*"))
    assert [r["pts_shift_s"] for r in held.orderBy("film_id").collect()] == [0.0, 0.5]
    with pytest.raises(LibraryError, match="f2, f3"):
        films.with_files(rows, held)
    with pytest.raises(LibraryError, match="f9"):
        films.only(rows, ["f9", "f1"])
    assert films.with_files(films.by_role(rows, "library"), held).count() == 2
    listed[0]["archive"] = "rar"
    (tmp_path / "m.json").write_text(json.dumps({"films": listed}))
    with pytest.raises(ValueError):
        files.manifest(spark, path)


def test_answer_key_files_and_members(spark, tmp_path):
    import zipfile

    from frametide.sources import files

    films = spark.createDataFrame([("f1", "library", "g", 600.0, 0.0)], "film_id string, role string, `group` string, duration_s double, pts_shift_s double")
    specs = answer_key.build(films, seed=1, distortions=["original", "speed"])
    files.save_answer_key(specs, str(tmp_path / "key"), {"seed": 1})
    back, meta = files.load_answer_key(spark, str(tmp_path / "key"))
    assert meta == {"seed": 1} and sorted(map(tuple, back.collect())) == sorted(map(tuple, specs.collect()))
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for name, n in (("x.txt", 999), ("small.mp4", 5), ("large.mkv", 50)):
            z.writestr(name, b"0" * n)
    (tmp_path / "b.zip").write_bytes(b"none")
    got = {r["path"][-5:]: r for r in files.largest_member(spark.read.format("binaryFile").load(str(tmp_path / "*.zip"))).collect()}
    assert got["a.zip"]["member"] == "large.mkv" and got["b.zip"]["error"]
    with pytest.raises(Exception, match="too short"):
        answer_key.build(films.withColumn("duration_s", F.lit(12.0))).collect()
    with pytest.raises(ValueError):
        answer_key.build(films, distortions=["none"])


def test_report(spark, tmp_path):
    from frametide.operators import report

    rows = []
    for i in range(40):
        known = i % 4 != 3
        right = i % 5 != 0
        rows.append((f"q{i:02}", f"b{i // 2}", f"f{i % 4}", "library" if known else "heldout", f"g{i % 2}", "test" if i % 2 else "val", ["speed", "original", "crop"][i % 3], [3.0, 10.0, 5.0][i % 3], 1.0, f"f{i % 4}" if right and known else None, 0.9 if right else 0.2, 0.1, 1.0 + 0.1 * (i % 7)))
    both = spark.createDataFrame(rows, "query_id string, base_id string, film_id string, role string, `group` string, split string, distortion string, length_s double, true_offset_s double, candidate string, confidence double, feature double, offset_s double")
    specs = both.drop("candidate", "confidence", "feature", "offset_s")
    judged = evaluate.judged(specs, both)
    acc = evaluate.accepted(F.lit(0.5), F.lit(0.5), True)
    per = report.per_query(specs, {"v2": (judged, acc), "v1": (judged, F.lit(False))})
    first = per.first()
    assert per.count() == 40 and first["query_id"] == "q00" and first["v2_accepted"] is False and per.where("role = 'heldout' and v2_correct is not null").isEmpty()
    weights = evaluate.hashed_weights(judged, 50)
    one = report.summary("v2", judged, acc, answer_key_digest="d", thresholds={"primary": 0.5}, weights=weights)
    assert [x["slice"] for x in one["breakdown"] if x["kind"] == "distortion"] == ["original", "crop", "speed"] and [x["slice"] for x in one["breakdown"] if x["kind"] == "length_s"] == ["3.0", "5.0", "10.0"]
    assert {x["kind"] for x in one["breakdown"]} == {"distortion", "length_s", "film_id", "group"} and one["metrics"]["n_known"] + one["metrics"]["n_unknown"] == 20
    two = one | {"run": "v1", "metrics": one["metrics"] | {"dir": 0.99}}
    grid = evaluate.threshold_grid(spark, "v2")
    best = evaluate.choose(judged, grid, 0.01, True).first()
    assert best["feasible"] and best["dir"] == pytest.approx(judged.where("split = 'val' and known").agg(F.avg(F.col("correct").cast("double"))).first()[0])
    report.write(spark, str(tmp_path / "one"), [one, two], per, evaluate.roc(judged, grid, 0.8, True), latency={"search_p50": 1.0, "search_p95": None}, index_bytes=138_000_000)
    text = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "one" / "report"), lineSep="\x00").collect())
    assert "| dir |" in text and "138 MB" in text and "## DIR by distortion" in text and "| search | 1.00 | - |" in text
    assert spark.read.option("header", True).csv(str(tmp_path / "one" / "per_query")).count() == 40
    assert [r["run"] for r in report.compare(spark, [str(tmp_path / "one")], str(tmp_path / "cmp")).collect()] == ["v1", "v2"]
    report.write(spark, str(tmp_path / "two"), [one | {"answer_key_digest": "other"}], per)
    with pytest.raises(ValueError):
        report.compare(spark, [str(tmp_path / "one"), str(tmp_path / "two")], str(tmp_path / "cmp"))
    assert report.environment(spark)["spark"] == spark.version and report.latency_sample(specs, 3).count() == 3 and report.base_index(specs).agg(F.max("base_index")).first()[0] == 19
    assert (report.percent(None), report.percent(0.5), report.interval(0.5, [0.25, 0.75])) == ("-", "50.0%", "50.0% [25.0, 75.0]")


def test_monitoring(spark):
    import json
    import logging

    from frametide import monitoring

    answers, seen = monitoring.observed(spark.createDataFrame([("match", 0.9, 20.0), ("unknown", 0.3, 700.0)], "status string, confidence double, total_ms double"), "test")
    answers.write.format("noop").mode("overwrite").save()
    assert seen.get["n"] == 2 and seen.get["n_match"] == 1 and seen.get["total_ms_le_1000"] == 2 and seen.get["total_ms_le_25"] == 1 and "frametide_n_match 1" in monitoring.exposition(seen.get)
    rows = spark.createDataFrame([(413, "a-1"), (422, "bad id!"), (None, "x")], "status int, request string").select(monitoring.error_column(F.col("status"), F.lit("m"), F.col("request")).alias("e")).collect()
    assert rows[0]["e"]["error"]["code"] == "too_large" and rows[0]["e"]["request_id"] == "a-1" and rows[1]["e"]["request_id"] != "bad id!" and rows[2]["e"] is None
    assert spark.range(1).select(monitoring.total_ms(F.create_map(F.lit("a"), F.lit(1.5), F.lit("b"), F.lit(2.0)))).first()[0] == 3.5
    line = json.loads(monitoring.JsonLines().format(logging.makeLogRecord({"name": "x", "levelname": "INFO", "msg": "hi %s", "args": ("you",), "clip": 3})))
    assert line["message"] == "hi you" and line["clip"] == 3 and line["level"] == "info"
    monitoring.configure_logging()
    assert len(logging.getLogger("frametide").handlers) == 1


def test_networks_and_batches(tmp_path, monkeypatch):
    rng = np.random.default_rng(0)
    frames = [rng.integers(0, 256, s, np.uint8) for s in ((4, 6, 3), (6, 4, 3), (4, 6, 3), (4, 6, 3))]
    seen = []

    def run(images):
        seen.append(images.shape)
        return images.reshape(len(images), -1).sum(1, keepdims=True)

    assert embedders.by_shape(frames, 2, run, 1).ravel().tolist() == [float(f.sum()) for f in frames] and sorted(seen) == [(1, 4, 6, 3), (1, 6, 4, 3), (2, 4, 6, 3)]
    assert embedders.standardized(np.full((1, 2, 2, 3), 255, np.uint8)).shape == (1, 3, 2, 2)
    for name in ("clip-vit-b32", "clip-vit-l14", "sscd-disc-mixup", "dinov2-base"):
        with pytest.raises(ValueError, match="needs a model"):
            embedders.create(name)
    (tmp_path / "m.onnx").write_bytes(b"x")
    monkeypatch.setenv("FRAMETIDE_MODEL_CLIP_VIT_B32", str(tmp_path / "m.onnx"))
    monkeypatch.setenv("FRAMETIDE_MODEL_CLIP_VIT_B32_SHA256", "0" * 64)
    with pytest.raises(ValueError, match="sha256"):
        embedders.create("clip-vit-b32")
    tall = rng.integers(0, 256, (900, 400, 3), np.uint8)
    assert embedders.capped_height(tall).shape == (720, 320, 3) and embedders.distort(tall[:90], "letterbox", rng).shape == (400, 400, 3)
    grey = np.full((8, 8, 3), 120, np.uint8)
    assert np.abs(embedders.shift_colors(grey, 0.0, 1.0, 1.5, 0.5).astype(int) - 120).max() <= 1


def test_settings(monkeypatch):
    from frametide.config import Settings

    monkeypatch.setenv("FRAMETIDE_TOP_K", "7")
    assert Settings.from_env().top_k == 7 and Settings.from_env(top_k=3).top_k == 3
    for bad in ({"top_k": 0}, {"index_fps": 0.0}, {"algorithm": "v3"}, {"v2_tolerance_s": 6.0}):
        with pytest.raises(ValueError):
            Settings(**bad)


def test_clock_and_rate(spark):
    import re

    row = spark.range(1).select(C.now_utc(), C.realtime_factor(F.lit(6.0), F.lit(2.0)), C.realtime_factor(F.lit(6.0), F.lit(0.0))).first()
    assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\+00:00", row[0]) and row[1] == 3 and row[2] == pytest.approx(6e9)


def test_rejections(spark):
    rows = spark.createDataFrame([("a.MP4", 10, 5.0), ("a.txt", 10, 5.0), ("a.mp4", 10**9, 5.0), ("a.mp4", 10, None), ("a.mp4", 10, 90.0)], "name string, size long, d double")
    assert [r[0] for r in rows.select(C.rejection(F.col("name"), F.col("size"), F.col("d"), [".mp4"], 50, 60)).collect()] == [None, 415, 413, 422, 422]
