"""A Python data source of frames: reads video files by ranges, batch or stream, and writes clips with a commit.

    spark.dataSource.register(FrameSource)
    spark.read.format("frames").option("fps", 2).load(folder)            # rows of FRAMES
    spark.readStream.format("frames").option("fps", 2).load(folder)
    clips.write.format("frames").option("fps", 2).mode("append").save(folder)

A file is cut into runs of frames by its size, so that many tasks share a long
one; each opens the file itself, through pyarrow's file systems, and reads the pictures of its
run alone. What can't be read is a row with an error, told once a file where its head is
bad and once a run where pictures are.

Options for reading: fps (absent: every frame), short_side, max_frames a file, partition_bytes.
"""

from __future__ import annotations

import io
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

from ..operators.embedders import shrink
from . import videos

FRAMES = "path string, frame_idx long, t double, h int, w int, rgb binary, error string"
PARTITION_BYTES = 64 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/*(?=/)", "file://", path))


@dataclass
class Run(InputPartition):
    """One of parts equal runs of a file's frames."""

    path: str
    part: int
    parts: int


class _Frames:
    def __init__(self, options):
        if not options.get("path"):
            raise ValueError("load a file or a folder")
        self.path = options["path"]
        self.fps = float(options["fps"]) if options.get("fps") else None
        self.short_side = int(options.get("short_side", 288))
        self.max_frames = int(options["max_frames"]) if options.get("max_frames") else None
        self.partition_bytes = int(options.get("partition_bytes", PARTITION_BYTES))

    def _files(self) -> list[fs.FileInfo]:
        """Video files at or below the path, by name; names with an underscore or a dot first are passed over, as Spark does."""
        store, at = opened(self.path)
        found = store.get_file_info(at)
        found = store.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True)) if found.type == fs.FileType.Directory else [found]
        root = at.rstrip("/") + "/"
        shown = [f for f in found if f.type == fs.FileType.File and not re.search(r"(^|/)[._]", f.path.removeprefix(root))]
        return sorted((f for f in shown if videos.has_decoder(f.path)), key=lambda f: f.path)

    def _runs(self, files: list[fs.FileInfo]) -> list[Run]:
        out = []
        for f in files:
            parts = max(1, -(-f.size // self.partition_bytes)) if videos.reads_ranges(f.path) else 1
            out += [Run(f.path, i, parts) for i in range(parts)]
        return out

    def read(self, run: Run) -> Iterator[pa.RecordBatch]:
        held, begun = [], False
        try:
            store, _ = opened(self.path)
            with store.open_input_file(run.path) as source:
                reader = videos.decoder_of(run.path)
                step = 1 / reader.probe(source).fps
                if hasattr(reader, "times"):
                    reader.times(source)
                begun = True
                for i, t, picture in videos.on_grid(reader, source, self.fps, self.max_frames, step, run.part, run.parts):
                    small = np.ascontiguousarray(shrink(picture, self.short_side))
                    held.append((run.path, i, t, small.shape[0], small.shape[1], small.tobytes(), None))
                    if len(held) == videos.ROWS:
                        yield videos.batch_of(held, FRAMES)
                        held = []
        except videos.BAD as e:
            if begun or run.part == 0:
                held.append((run.path, None, None, None, None, None, str(e)))
        if held:
            yield videos.batch_of(held, FRAMES)


class FrameReader(_Frames, DataSourceReader):
    def partitions(self) -> list[Run]:
        return self._runs(self._files())


class FrameStream(_Frames, DataSourceStreamReader):
    """Files in the order of their modification; one that comes with an older time than what was read isn't seen."""

    def _at(self, f: fs.FileInfo) -> list:
        return [f.mtime_ns or 0, f.path]

    def initialOffset(self) -> dict:
        return {"at": [-1, ""]}

    def latestOffset(self) -> dict:
        return {"at": max(map(self._at, self._files()), default=[-1, ""])}

    def partitions(self, start: dict, end: dict) -> list[Run]:
        return self._runs([f for f in self._files() if list(start["at"]) < self._at(f) <= list(end["at"])])

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    """What a task has written in the job's own folder: clips, and clips that couldn't be made with their errors."""

    clips: list[str]
    errors: list[tuple[str, str]]


class ClipWriter(DataSourceArrowWriter):
    """Writes each clip of rows (query_id, t, h, w, rgb, error) as a file. A clip's rows must follow each other, by time: see save_clips.

    Tasks write in a folder of the job's own; commit moves the files to their places and then writes
    _SUCCESS with the clips' names; abort removes the folder. So a task that runs twice, or a job that
    fails, leaves nothing that a reader sees.
    """

    def __init__(self, options, overwrite: bool):
        self.path, self.fps, self.overwrite = options["path"], float(options.get("fps", videos.DEFAULT_FPS)), overwrite
        self.own = f"_job-{uuid.uuid4().hex}"
        store, at = opened(self.path)
        store.create_dir(f"{at}/{self.own}", recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, at = opened(self.path)
        attempt, done, errors, query, held = uuid.uuid4().hex, [], [], None, []
        seen: set[str] = set()

        def finish() -> None:
            if not held:
                return
            if query in seen:
                raise ValueError(f"the rows of clip {query} don't follow each other")
            seen.add(query)
            if bad := next((r["error"] for r in held if r["error"] is not None), None):
                errors.append((query, bad))
                return
            out = io.BytesIO()
            pictures = np.stack([np.frombuffer(r["rgb"], np.uint8).reshape(r["h"], r["w"], 3) for r in held])
            np.savez(out, frames=pictures, pts=np.array([r["t"] for r in held], float), fps=self.fps)
            name = f"{quote(query, safe='')}.npz"
            with store.open_output_stream(f"{at}/{self.own}/{attempt}-{name}") as file:
                file.write(out.getbuffer())
            done.append(f"{attempt}-{name}")

        for batch in iterator:
            for row in batch.to_pylist():
                if row["query_id"] != query:
                    finish()
                    query, held = row["query_id"], []
                held.append(row)
        finish()
        return Written(done, errors)

    def commit(self, messages: list[Written | None]) -> None:
        store, at = opened(self.path)
        names, errors = [x for m in messages if m for x in m.clips], dict(e for m in messages if m for e in m.errors)
        if self.overwrite:
            old = store.get_file_info(fs.FileSelector(at))
            for f in old:
                if f.type == fs.FileType.File:
                    store.delete_file(f.path)
        for name in names:
            store.move(f"{at}/{self.own}/{name}", f"{at}/{name.split('-', 1)[1]}")
        with store.open_output_stream(f"{at}/_SUCCESS") as file:
            file.write(json.dumps({"clips": sorted(n.split("-", 1)[1] for n in names), "errors": errors}).encode())
        store.delete_dir(f"{at}/{self.own}")

    def abort(self, messages: list[Written | None]) -> None:
        store, at = opened(self.path)
        store.delete_dir(f"{at}/{self.own}")


class FrameSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema) -> FrameReader:
        return FrameReader(self.options)

    def streamReader(self, schema) -> FrameStream:
        return FrameStream(self.options)

    def writer(self, schema, overwrite: bool) -> ClipWriter:
        return ClipWriter(self.options, overwrite)


def save_clips(frames: DataFrame, path: str, fps: float, *, overwrite: bool = False) -> None:
    """Writes rows of RENDERED, a file a clip; one task holds one clip at a time."""
    frames.sparkSession.dataSource.register(FrameSource)
    dealt = frames.select("query_id", "t", "h", "w", "rgb", "error").repartition("query_id").sortWithinPartitions("query_id", "t")
    dealt.write.format("frames").option("fps", fps).mode("overwrite" if overwrite else "append").save(path)
