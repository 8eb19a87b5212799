"""Streams with typed state: late frames, timers, a restart from the checkpoint, the size of the state."""

import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from frametide.streaming import frames as streams

ROWS = "video_id string, frame_idx long, pts double, ts timestamp"
T0 = datetime(2024, 1, 1)


def _write(spark, path, rows):
    made = [(v, i, p, T0 + timedelta(seconds=s)) for v, i, p, s in rows]
    spark.createDataFrame(made, ROWS).coalesce(1).write.mode("append").parquet(path)


def _run(stream, root, name="out"):
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{root}/check-{name}").option("path", f"{root}/{name}").outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(180) is not False
    sizes = [op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]]
    return sizes


def _told(spark, root, name="out"):
    return sorted((r["video_id"], r["frame_idx"], r["t"], r["late"]) for r in spark.read.parquet(f"{root}/{name}").collect())


def test_frames_are_placed_with_state(spark, tmp_path):
    root, source = str(tmp_path), str(tmp_path / "in")
    _write(spark, source, [("a", 0, 0.0, 0), ("a", 1, None, 1), ("b", 0, 5.0, 0)])
    read = lambda: spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(source)
    made = lambda: streams.place_frames(read(), 10.0, "60 seconds")
    assert max(_run(made(), root)) >= 2
    want = [("a", 0, 0.0, False), ("a", 1, 0.1, False), ("b", 0, 5.0, False)]
    assert _told(spark, root) == want
    # goes on from the checkpoint: the state of a is there; frame 1 comes again, late
    _write(spark, source, [("a", 3, 0.05, 2), ("a", 1, 0.07, 1), ("a", 2, 0.06, 2)])
    _run(made(), root)
    want += [("a", 1, 0.07, True), ("a", 2, 0.1 + 0.1, False), ("a", 3, 0.1 + 0.1 + 0.1, False)]
    got = _told(spark, root)
    assert [(v, i, round(t, 9), late) for v, i, t, late in got] == sorted((v, i, round(t, 9), late) for v, i, t, late in want)
    # the watermark passes: the timers of a and b end their state
    _write(spark, source, [("c", 0, 0.0, 500)])
    _run(made(), root)
    _write(spark, source, [("c", 1, 0.2, 501)])
    sizes = _run(made(), root)
    state = spark.read.format("statestore").option("stateVarName", "last").load(f"{root}/check-out")
    assert {r["key"]["video_id"] for r in state.select("key").collect()} == {"c"} and sizes
    _write(spark, source, [("a", 9, 0.4, 502), ("a", 10, None, 503)])  # a begins anew
    _run(made(), root)
    assert [x[2] for x in _told(spark, root) if x[0] == "a" and x[1] >= 9] == [0.4, 0.5]


def test_state_with_a_time_to_live(spark, tmp_path):
    root, source = str(tmp_path), str(tmp_path / "in")
    _write(spark, source, [("a", 0, None, 0), ("a", 1, 1.0, 1)])
    stream = spark.readStream.schema(ROWS).parquet(source)
    query = streams.place_frames(stream, 10.0, "1 hour", lateness=None).writeStream.format("parquet").option("checkpointLocation", f"{root}/check").option("path", f"{root}/out").outputMode("append").start()
    for _ in range(120):
        time.sleep(1)
        if any(p["numInputRows"] for p in query.recentProgress):
            break
    query.stop()
    assert [(v, i, round(t, 6), late) for v, i, t, late in _told(spark, root)] == [("a", 0, -0.9, False), ("a", 1, 1.0, False)]


def test_first_frame_of_a_window(spark, tmp_path):
    root, source = str(tmp_path), str(tmp_path / "in")
    _write(spark, source, [("a", 3, 0.3, 0.2), ("a", 2, 0.2, 0.2), ("a", 4, 0.4, 0.9), ("a", 5, 0.5, 2.0), ("b", 1, 0.1, 1.5)])
    _write(spark, source, [("z", 0, 0.0, 900)])
    _write(spark, source, [("z", 1, 0.0, 901)])
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(source)
    _run(streams.first_per_bucket(stream, 1.0), root, "first")
    got = sorted((r["video_id"], r["frame_idx"]) for r in spark.read.parquet(f"{root}/first").where(F.col("video_id") != "z").collect())
    assert got == [("a", 2), ("a", 5), ("b", 1)]


def test_answers_arrive(spark, tmp_path):
    source = str(tmp_path / "in")
    _write(spark, source, [("a", 0, 0.0, 0)])
    stream = spark.readStream.schema(ROWS).parquet(source)
    for _ in range(2):
        streams.answer_arriving(stream, lambda batch: batch.select("video_id", F.lit("match").alias("status")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("video_id", "status", "batch").collect()] == [("a", "match", 0)]
