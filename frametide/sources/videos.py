"""Videos: probe, decode, sample. Files come from Spark's binaryFile source; a bad one is a row with an error.

A decoder is a class with probe(source) -> Video and frames(source) -> iterator of
(pts or None, picture or None) of a seekable binary file; it is registered by suffix. One that also
has times(source) -> array (NaN: unknown) and pictures(source, places) -> iterator
of the pictures at rising places is only asked for the pictures that are
needed. Video codecs need packages that may be absent; the one built in reads .npz files
with arrays frames (n, h, w, 3), and optionally pts (NaN: unknown) and fps.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.columns import suffix
from ..operators.embedders import capped_height, shrink

PROBED = "path string, fps double, n_frames long, width int, height int, duration_s double, error string"
SAMPLED = "path string, t double, h int, w int, rgb binary, error string"
DEFAULT_FPS, EPSILON = 30.0, 1e-6
ROWS = 16
_DECODERS: dict[str, Callable[[], object]] = {}


class VideoError(ValueError):
    pass


@dataclass(frozen=True)
class Video:
    fps: float
    n_frames: int
    width: int
    height: int

    def __post_init__(self):
        if not (self.fps > 0 and self.n_frames > 0 and self.width > 0 and self.height > 0):
            raise VideoError("no frames, rate or size")

    @property
    def duration_s(self) -> float:
        return self.n_frames / self.fps


def decoder(*suffixes: str):
    def put(make):
        _DECODERS.update(dict.fromkeys(suffixes, make))
        return make

    return put


@decoder(".npz")
class Arrays:
    """Pictures as they are in a .npz file. Headers are read first, then the pictures asked for, one at a time."""

    def _small(self, held: zipfile.ZipFile, name: str, most: int) -> np.ndarray | None:
        """A member of at most so many entries; None if there is none of the name."""
        if f"{name}.npy" not in held.namelist():
            return None
        with held.open(f"{name}.npy") as file:
            shape, _, kind = _header(file)
            if kind.hasobject or int(np.prod(shape)) > most:
                raise VideoError(f"{name} is not what it should be")
            file.seek(0)
            return np.lib.format.read_array(file, allow_pickle=False)

    def _open(self, source: BinaryIO) -> tuple[zipfile.ZipFile, tuple[int, ...], float]:
        held = zipfile.ZipFile(source)
        with held.open("frames.npy") as file:
            shape, by_column, kind = _header(file)
        fps = self._small(held, "fps", 1)
        if len(shape) != 4 or shape[3] != 3 or kind != np.uint8 or by_column:
            raise VideoError("not pictures of three channels")
        return held, shape, DEFAULT_FPS if fps is None else float(fps)

    def probe(self, source: BinaryIO) -> Video:
        held, shape, fps = self._open(source)
        pts = None if "pts.npy" not in held.namelist() else _header(held.open("pts.npy"))[0]
        if pts is not None and pts != shape[:1]:
            raise VideoError("not as many times as pictures")
        return Video(fps, shape[0], shape[2], shape[1])

    def times(self, source: BinaryIO) -> np.ndarray:
        held, shape, fps = self._open(source)
        pts = self._small(held, "pts", shape[0])
        if pts is not None and pts.shape != shape[:1]:
            raise VideoError("not as many times as pictures")
        return np.arange(shape[0]) / max(fps, 1e-9) if pts is None else pts.astype(float)

    def pictures(self, source: BinaryIO, places: Iterable[int]) -> Iterator[np.ndarray]:
        held, shape, _ = self._open(source)
        size = int(np.prod(shape[1:]))
        with held.open("frames.npy") as file:
            _header(file)
            start = file.tell()
            for place in places:
                file.seek(start + place * size)
                raw = file.read(size)
                if len(raw) < size:
                    raise VideoError(f"picture {place} is cut off")
                yield np.frombuffer(raw, np.uint8).reshape(shape[1:])

    def frames(self, source: BinaryIO) -> Iterator[tuple[float | None, np.ndarray | None]]:
        times = self.times(source)
        for t, picture in zip(times, self.pictures(source, range(len(times))), strict=True):
            yield (None if np.isnan(t) else float(t)), picture


def _header(file: BinaryIO) -> tuple[tuple[int, ...], bool, np.dtype]:
    """(shape, by column, kind) of an array's header; the file stands at its data then."""
    version = np.lib.format.read_magic(file)
    return (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(file)


def _suffix(path: str) -> str:
    return "." + path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""


def has_decoder(path: str) -> bool:
    return _suffix(path) in _DECODERS


def reads_ranges(path: str) -> bool:
    return hasattr(_DECODERS[_suffix(path)], "pictures")


def decoder_of(path: str):
    if not has_decoder(path):
        raise VideoError(f"no decoder for {_suffix(path) or 'files without a suffix'}")
    return _DECODERS[_suffix(path)]()


def _decoder_of(path: str, content: bytes | None):
    made = decoder_of(path)
    if content is None:
        raise VideoError("the file can't be read")
    return made


BAD = (ValueError, KeyError, OSError, EOFError, NotImplementedError, zipfile.BadZipFile, zlib.error)


def files(spark: SparkSession, paths: list[str], suffixes: tuple[str, ...] | None = None) -> DataFrame:
    """path, length, content of files and of what is below folders, with an allowed suffix; read where they are used."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return found.where(suffix(F.col("path")).isin(*(suffixes or tuple(_DECODERS)))).select("path", "length", "content")


def limited(rows: DataFrame, max_mb: float) -> DataFrame:
    """rows(path, length, content) with content null where the file is longer: it isn't read, and is an error row later."""
    most = int(max_mb * 1024 * 1024)
    return rows.where(F.col("length") <= most).unionByName(rows.where(F.col("length") > most).select("path", "length", F.lit(None).cast("binary").alias("content")))


def probe(rows: DataFrame, *others: str) -> DataFrame:
    """One row of PROBED for each of rows(path, content), and others of its columns: what the container says, or why it can't be used."""
    kept = rows.select("path", "content", *others)
    schema = StructType([*StructType.fromDDL(PROBED), *kept.schema.fields[2:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                try:
                    v = _decoder_of(path, content).probe(io.BytesIO(content))
                    row = (path, v.fps, v.n_frames, v.width, v.height, v.duration_s, None)
                except BAD as e:
                    row = (path, None, None, None, None, None, str(e))
                made = batch_of([row], PROBED)
                yield pa.RecordBatch.from_arrays([*made.columns, *(c.slice(i, 1) for c in batch.columns[2:])], names=[*made.schema.names, *batch.schema.names[2:]])

    return kept.mapInArrow(run, schema)


class Grid:
    """Which of rising times are the first at or after a grid point 0, 1/fps, ...; at most so many."""

    def __init__(self, fps: float | None, most: int | None = None):
        self.fps, self.left, self.point = fps, most if most is not None else -1, 0.0

    def takes(self, t: float) -> bool:
        if self.left == 0 or self.fps is not None and t + EPSILON < self.point:
            return False
        self.left -= 1
        if self.fps is None:  # every frame
            return True
        self.point = (np.floor((t + EPSILON) * self.fps) + 1) / self.fps
        return True


def repaired(frames: Iterable[tuple[float | None, object]], step: float) -> Iterator[tuple[float, object]]:
    """Times that don't go on are the one before plus step."""
    before = -1.0
    for pts, what in frames:
        before = pts if pts is not None and pts > before else before + step
        yield before, what


def sampled(frames: Iterable[tuple[float | None, np.ndarray | None]], fps: float | None, max_frames: int | None = None, step: float = 1 / DEFAULT_FPS) -> Iterator[tuple[float, np.ndarray]]:
    """The first picture at or after each grid point, with its repaired time.

    A picture that can't be decoded uses up no grid point.
    """
    grid = Grid(fps, max_frames)
    for t, picture in repaired(frames, step):
        if picture is not None and grid.takes(t):
            yield t, picture
        if grid.left == 0:
            return


def on_grid(reader, source: BinaryIO, fps: float | None, max_frames: int | None, step: float, part: int = 0, parts: int = 1) -> Iterator[tuple[int, float, np.ndarray]]:
    """(frame, time, picture) of the sampled frames, without fps all, or of one of parts equal runs of them."""
    if hasattr(reader, "pictures"):
        known = ((None if np.isnan(t) else float(t), i) for i, t in enumerate(reader.times(source)))
        picks = list(sampled(known, fps, max_frames, step))
        picks = picks[len(picks) * part // parts : len(picks) * (part + 1) // parts]
        for (t, i), picture in zip(picks, reader.pictures(source, [i for _, i in picks]), strict=True):
            yield i, t, picture
    elif part == 0:
        numbered = ((pts, None if picture is None else (i, picture)) for i, (pts, picture) in enumerate(reader.frames(source)))
        for t, (i, picture) in sampled(numbered, fps, max_frames, step):
            yield i, t, picture


def sample(rows: DataFrame, fps: float, *, short_side: int = 288, max_frames: int | None = None, adaptive: bool = False) -> DataFrame:
    """Rows of SAMPLED for rows(path, content): frames on a time grid, shrunk; or one row with an error.

    Frames are decoded one after the other, those off the grid not where the decoder can leave
    them out; a few are held. With
    adaptive, a video that would give more than max_frames is sampled at a lower rate.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                held = []
                try:
                    reader, source = _decoder_of(path, content), io.BytesIO(content)
                    video = reader.probe(source)
                    rate = min(fps, max_frames / video.duration_s) if adaptive and max_frames else fps
                    for _, t, picture in on_grid(reader, source, rate, max_frames, 1 / video.fps):
                        small = np.ascontiguousarray(shrink(picture, short_side))
                        held.append((path, t, small.shape[0], small.shape[1], small.tobytes(), None))
                        if len(held) == ROWS:
                            yield batch_of(held, SAMPLED)
                            held = []
                except BAD as e:
                    held.append((path, None, None, None, None, str(e)))
                if held:
                    yield batch_of(held, SAMPLED)

    return rows.select("path", "content").mapInArrow(run, SAMPLED)


_KINDS = {"string": pa.string(), "double": pa.float64(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "array<float>": pa.list_(pa.float32())}


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))


RENDERED = "query_id string, t double, h int, w int, rgb binary, error string"


@dataclass
class _Clip:
    """A clip of a film: where it is, how fast it runs, and the grid of its own times."""

    query: str
    start: float
    end: float
    kind: str
    seed: int
    speed: float
    grid: Grid


def sweep(frames: Iterable[tuple[float, object]], clips: list[_Clip]) -> Iterator[tuple[object, list[tuple[_Clip, float]]]]:
    """What each frame gives to the clips that are open at its time, for frames that give something.

    Frames come by rising time, clips are opened in order of their starts; the
    sweep ends with the last clip.
    """
    waiting = sorted(clips, key=lambda c: -c.start)
    opened: list[_Clip] = []
    for t, what in frames:
        while waiting and waiting[-1].start - EPSILON <= t:
            opened.append(waiting.pop())
        opened = [c for c in opened if t < c.end - EPSILON]
        if what is not None:
            takers = [(c, (t - c.start) / c.speed) for c in opened]
            takers = [(c, own) for c, own in takers if c.grid.takes(own)]
            if takers:
                yield what, takers
        if not waiting and not opened:
            return


def _swept(reader, source: BinaryIO, step: float, clips: list[_Clip]) -> Iterator[tuple[np.ndarray, list[tuple[_Clip, float]]]]:
    """(picture, takers): a film is decoded once for all of its clips, where the decoder can, only the pictures that clips take."""
    if not hasattr(reader, "pictures"):
        yield from sweep(repaired(reader.frames(source), step), clips)
        return
    known = ((None if np.isnan(t) else float(t), i) for i, t in enumerate(reader.times(source)))
    found = list(sweep(repaired(known, step), clips))
    for picture, (_, takers) in zip(reader.pictures(source, [i for i, _ in found]), found, strict=True):
        yield picture, takers


def render(specs: DataFrame, sources: DataFrame, fps: float, *, most_height: int = 720) -> DataFrame:
    """Rows of RENDERED: the frames of each query clip, distorted; a film that can't be read gives an error row for each of its clips.

    specs(query_id, film_id, ref_start_s, ref_duration_s, distortion, seed) meet
    sources(film_id, path, content). A film's clips travel together, so its bytes are
    shuffled once and decoded once, whatever the number of clips. Heights are capped first. speed
    shortens times; the result is what a decoder of the rendered clip would give.
    """
    from ..operators.answer_key import DISTORTIONS
    from ..operators.embedders import distort

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, asked, content = (batch.column(j)[i].as_py() for j in range(3))
                held = []
                try:
                    clips = [_Clip(a["query_id"], a["ref_start_s"], a["ref_start_s"] + a["ref_duration_s"], a["distortion"], a["seed"], DISTORTIONS[a["distortion"]], Grid(fps)) for a in asked]
                    reader, source = _decoder_of(path, content), io.BytesIO(content)
                    for picture, takers in _swept(reader, source, 1 / reader.probe(source).fps, clips):
                        capped = capped_height(picture, most_height)
                        for clip, t in takers:
                            made = np.ascontiguousarray(distort(capped, clip.kind, np.random.default_rng(clip.seed)))
                            held.append((clip.query, t, made.shape[0], made.shape[1], made.tobytes(), None))
                            if len(held) == ROWS:
                                yield batch_of(held, RENDERED)
                                held = []
                except BAD as e:
                    held += [(a["query_id"], None, None, None, None, str(e)) for a in asked]
                for lo in range(0, len(held), ROWS):
                    yield batch_of(held[lo : lo + ROWS], RENDERED)

    clip = F.struct("query_id", F.col("ref_start_s").cast("double").alias("ref_start_s"), F.col("ref_duration_s").cast("double").alias("ref_duration_s"), "distortion", F.col("seed").cast("long").alias("seed"))
    each = specs.groupBy("film_id").agg(F.collect_list(clip).alias("clips")).join(sources, "film_id").select("path", "clips", "content")
    return each.mapInArrow(run, RENDERED)
