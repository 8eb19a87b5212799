"""Streaming forms: sampling, time repair with state, resumable embedding, clips answered as they come."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def first_per_bucket(frames: DataFrame, seconds: float, lateness: str = "10 seconds") -> DataFrame:
    """The first frame of each tumbling window of a stream of frames(video_id, ts, ...), once it is complete; of equal times that of the least frame_idx, then by a hash of the row."""
    rest = [c for c in frames.columns if c != "video_id"]
    ties = [*(["frame_idx"] if "frame_idx" in rest else []), F.xxhash64(*rest)]
    first = F.min_by(F.struct(*rest), F.struct("ts", *ties))
    windows = frames.withWatermark("ts", lateness).groupBy("video_id", F.window("ts", f"{int(seconds * 1000)} milliseconds"))
    return windows.agg(first.alias("f")).select("video_id", "f.*")


REPAIRED = "video_id string, frame_idx long, pts double, t double"


def repair_times(frames: DataFrame, fps: float = 30.0, idle: str | None = None) -> DataFrame:
    """Rows of REPAIRED of a stream of frames(video_id, frame_idx, pts): the batch form's rule, with each video's last time as state.

    Frames of a micro-batch are taken in order; one that comes late is given the
    time after the last, not dropped. State of a video that was idle for so
    many milliseconds is dropped where idle is given.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        (before,) = state.get if state.exists else (-1.0,)
        rows = pd.concat(list(parts)).sort_values("frame_idx", kind="stable")
        times = []
        for pts in rows["pts"]:
            before = float(pts) if not pd.isna(pts) and pts > before else before + 1.0 / fps
            times.append(before)
        state.update((before,))
        if idle is not None:
            state.setTimeoutDuration(int(idle))
        yield rows.assign(video_id=key[0], t=times)[["video_id", "frame_idx", "pts", "t"]]

    timeout = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout
    rows = frames.select("video_id", F.col("frame_idx").cast("long").alias("frame_idx"), F.col("pts").cast("double").alias("pts"))
    return rows.groupBy("video_id").applyInPandasWithState(run, REPAIRED, "before double", "append", timeout)


PLACED = "video_id string, frame_idx long, pts double, t double, late boolean"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Placer(StatefulProcessor):
    """Each video's last time and frame as typed state; it ends by an event-time timer, or by its time to live."""

    def __init__(self, fps: float, idle_ms: int, by_event: bool):
        self.fps, self.idle_ms, self.by_event = fps, idle_ms, by_event

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "t double, frame_idx long, timer long", ttlDurationMs=None if self.by_event else self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before, seen, timer = self.last.get() if self.last.exists() else (-1.0, -1, -1)
        whole = pd.concat(list(rows)).sort_values("frame_idx", kind="stable")
        times, late = [], []
        for frame, pts in zip(whole["frame_idx"], whole["pts"], strict=True):
            late.append(frame <= seen)
            if late[-1]:  # what came before it is told already: its own time, where it has one
                times.append(float(pts))
                continue
            before, seen = (float(pts) if not pd.isna(pts) and pts > before else before + 1.0 / self.fps), frame
            times.append(before)
        if self.by_event:
            ends = int(whole["ts"].max().timestamp() * 1000) + self.idle_ms
            if ends > timer:
                if timer >= 0:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(ends)
                timer = ends
        self.last.update((before, int(seen), timer))
        yield pd.DataFrame({"video_id": pd.Series([key[0]] * len(whole), dtype=object), "frame_idx": whole["frame_idx"].to_numpy(), "pts": whole["pts"].to_numpy(), "t": np.array(times, float), "late": np.array(late, bool)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def place_frames(frames: DataFrame, fps: float = 30.0, idle: str = "60 seconds", *, lateness: str | None = "10 seconds") -> DataFrame:
    """Rows of PLACED of a stream of frames(video_id, frame_idx, pts, ts): repair_times with state that ends, and late frames told.

    A frame that comes after one of a higher number is a row with late = true; it
    keeps its own time (null where it has none) and moves no other. With lateness, a video's state ends when the watermark is
    idle past its newest ts (event-time timers), and frames behind the watermark are dropped by
    Spark; without, it ends idle after its last change by the clock (time to live); such a stream runs on
    and isn't for a trigger of what is available. Needs the
    RocksDB state store, which is set for the session where none is named.
    """
    spark = frames.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") in ("", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = frames.select("video_id", F.col("frame_idx").cast("long").alias("frame_idx"), F.col("pts").cast("double").alias("pts"), "ts")
    rows = rows.withWatermark("ts", lateness) if lateness else rows
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    return rows.groupBy("video_id").transformWithStateInPandas(_Placer(fps, idle_ms, lateness is not None), PLACED, "append", "EventTime" if lateness else "ProcessingTime")


def arriving(spark: SparkSession, path: str, files_at_once: int = 16) -> DataFrame:
    """path, length, content of files as they come into a folder, at most so many in a micro-batch: what waits, waits on disk."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true")
    return stream.option("maxFilesPerTrigger", files_at_once).load(path).select("path", "length", "content")


def run_available(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Takes what is there and isn't done, batch by batch, and ends; a later call goes on from the checkpoint."""
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def embed_arriving(stream: DataFrame, store, embed: Callable[[DataFrame], tuple[DataFrame, DataFrame]], checkpoint: str) -> StreamingQuery:
    """Each micro-batch of clips becomes a shard of a query store, by the batch's number: one that is done again writes nothing twice."""

    def step(batch: DataFrame, number: int) -> None:
        vectors, failures = embed(batch)
        store.append(vectors, f"{number:08d}", failures)

    return run_available(stream, step, checkpoint)


def answer_arriving(stream: DataFrame, answer: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Answers of each micro-batch of clips are written as Parquet in a folder of the batch's number."""

    def step(batch: DataFrame, number: int) -> None:
        answer(batch).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")

    return run_available(stream, step, checkpoint)
