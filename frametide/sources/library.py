"""A versioned vector library, kept as a log of changes.

Layout: root/segments/<name>/ holds what one change added (lib_vectors, videos) and the keys
that it removed (tombstones); root/manifest/v<N>.json names the segments of a version.
A change writes its own rows and a manifest, whatever the size of the library; readers take the
highest manifest, read its segments as one table and leave out removed keys, which are never used again.
compact() makes one segment of them. A version is committed by creating its manifest,
which only one writer can; until then nothing of a change is seen, and what a writer that died has left is
in no manifest. vacuum() removes that.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from dataclasses import replace as changed

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.columns import is_valid_vector, is_video_id
from ..staging import numbered

SCHEMA_VERSION = 2


class LibraryError(ValueError):
    pass


def _files(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a new file; False where there is one. One step, so that of several writers one succeeds."""
    fs, target = _files(spark, path)
    fs.mkdirs(target.getParent())
    if fs.getScheme() == "file":  # Hadoop's local files are looked for first and made then
        try:
            with open(target.toUri().getPath(), "x") as file:
                file.write(text)
        except FileExistsError:
            return False
        return True
    try:
        stream = fs.create(target, False)
    except Exception as e:
        if fs.exists(target):
            return False
        raise e
    stream.write(bytearray(text.encode()))
    stream.close()
    return True


def _manifests(spark: SparkSession, root: str) -> list[int]:
    fs, folder = _files(spark, f"{root}/manifest")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), reverse=True)


def _manifest(spark: SparkSession, root: str) -> dict | None:
    """The highest whole manifest, with its version and the highest number that is taken; one whose writer died over it is passed over."""
    versions = _manifests(spark, root)
    for version in versions:
        try:
            found = json.loads("".join(r["value"] for r in spark.read.text(f"{root}/manifest/v{version}.json").collect()))
        except json.JSONDecodeError:
            continue
        return found | {"version": version, "taken": versions[0]}
    return None


@dataclass(frozen=True)
class _Change:
    """What is not yet saved: since which version of which root, rows added, keys removed."""

    root: str | None = None
    version: int = 0
    segments: tuple[str, ...] = ()
    vectors: DataFrame | None = None
    videos: DataFrame | None = None
    removed: DataFrame | None = None


def _plus(a: DataFrame | None, b: DataFrame) -> DataFrame:
    return b if a is None else a.unionByName(b)


@dataclass(frozen=True)
class Library:
    vectors: DataFrame
    videos: DataFrame
    embedder: str
    dim: int
    next_id: int = 0
    next_key: int = 0
    change: _Change | None = None

    @classmethod
    def empty(cls, spark: SparkSession, embedder: str, dim: int) -> Library:
        return cls(spark.createDataFrame([], schemas.LIB_VECTORS), spark.createDataFrame([], schemas.VIDEOS), embedder, dim, change=_Change())

    @classmethod
    def load(cls, spark: SparkSession, root: str) -> Library:
        m = _manifest(spark, root)
        if m is None:
            raise LibraryError(f"no library in {root}")
        if m["schema_version"] != SCHEMA_VERSION:
            raise LibraryError(f"schema version {m['schema_version']}")
        segments = tuple(m["segments"])
        if segments:
            vectors = spark.read.schema(schemas.LIB_VECTORS).parquet(*[f"{root}/segments/{s}/lib_vectors" for s in segments])
            videos = spark.read.schema(schemas.VIDEOS).parquet(*[f"{root}/segments/{s}/videos" for s in segments])
        else:
            vectors, videos = spark.createDataFrame([], schemas.LIB_VECTORS), spark.createDataFrame([], schemas.VIDEOS)
        if m["tombstones"]:
            gone = spark.read.schema("key int").parquet(*[f"{root}/segments/{s}/tombstones" for s in m["tombstones"]])
            vectors, videos = vectors.join(gone, "key", "left_anti").select(*vectors.columns), videos.join(gone, "key", "left_anti").select(*videos.columns)
        out = cls(vectors, videos, m["embedder"], m["dim"], m["next_id"], m["next_key"], _Change(root, m["version"], segments))
        out.check(m["n_videos"], m["n_vectors"])
        return out

    @classmethod
    def open_or_create(cls, spark: SparkSession, root: str, embedder: str, dim: int) -> Library:
        if not _manifests(spark, root):
            return cls.empty(spark, embedder, dim)
        out = cls.load(spark, root)
        if (out.embedder, out.dim) != (embedder, dim):
            raise LibraryError(f"library of {out.embedder} with {out.dim} dimensions, not {embedder} with {dim}")
        return out

    def save(self, root: str) -> Library:
        """The next version. Where this is a change of root's newest version, its own rows and removed keys are written; elsewhere the whole.

        If someone else has saved a version since this one was loaded, it is an error and nothing is changed.
        """
        return self._save(root, self.change if self.change is not None and self.change.root == root else None)

    def compact(self, root: str) -> Library:
        """The next version of a saved library, with the same rows in one segment."""
        if self.change is None or self.change.root != root or self.change.vectors is not None or self.change.removed is not None:
            raise LibraryError("only a saved version can be compacted")
        return self._save(root, self.change, whole=True)

    def _save(self, root: str, change: _Change | None, whole: bool = False) -> Library:
        spark = self.videos.sparkSession
        now = _manifest(spark, root)
        if (now["version"] if now else 0) != (change.version if change else 0):
            raise LibraryError("another version was saved meanwhile")
        whole = whole or now is None
        segments, dead = ([], []) if whole else (list(change.segments), list(now["tombstones"]))
        name = uuid.uuid4().hex
        at = f"{root}/segments/{name}"
        vectors, videos = (self.vectors, self.videos) if whole else (change.vectors, change.videos)
        n_videos, n_vectors = (0, 0) if whole else (now["n_videos"], now["n_vectors"])
        if vectors is not None:
            vectors.sortWithinPartitions("key", "vector_id").write.parquet(f"{at}/lib_vectors")
            videos.write.parquet(f"{at}/videos")
            segments.append(name)
            row = spark.read.schema(schemas.VIDEOS).parquet(f"{at}/videos").agg(F.count("*"), F.coalesce(F.sum("n_vectors"), F.lit(0))).first()
            n_videos, n_vectors = n_videos + row[0], n_vectors + row[1]
        if not whole and change.removed is not None:
            change.removed.select("key").distinct().write.parquet(f"{at}/tombstones")
            old = spark.read.schema(schemas.VIDEOS).parquet(*[f"{root}/segments/{s}/videos" for s in change.segments]) if change.segments else spark.createDataFrame([], schemas.VIDEOS)
            if dead:
                old = old.join(spark.read.schema("key int").parquet(*[f"{root}/segments/{s}/tombstones" for s in dead]), "key", "left_anti")
            row = old.join(spark.read.schema("key int").parquet(f"{at}/tombstones"), "key", "left_semi").agg(F.count("*"), F.coalesce(F.sum("n_vectors"), F.lit(0))).first()
            n_videos, n_vectors = n_videos - row[0], n_vectors - row[1]
            dead.append(name)
        manifest = {"schema_version": SCHEMA_VERSION, "embedder": self.embedder, "dim": self.dim, "metric": "inner_product", "next_id": self.next_id, "next_key": self.next_key, "n_videos": n_videos, "n_vectors": n_vectors, "segments": segments, "tombstones": dead}
        version = (now["taken"] if now else max(_manifests(spark, root), default=0)) + 1
        if not _create(spark, f"{root}/manifest/v{version}.json", json.dumps(manifest)):
            raise LibraryError(f"version {version} was written by someone else")
        return Library.load(spark, root)

    @staticmethod
    def vacuum(spark: SparkSession, root: str, keep: int = 1) -> list[str]:
        """Removes segments that none of the last keep versions names, and older manifests; for when nobody writes or reads those. Gives the segments' names."""
        fs, folder = _files(spark, f"{root}/segments")
        versions = _manifests(spark, root)
        named: set[str] = set()
        for version in versions[:keep]:
            m = json.loads("".join(r["value"] for r in spark.read.text(f"{root}/manifest/v{version}.json").collect()))
            named |= {*m["segments"], *m["tombstones"]}
        for version in versions[keep:]:
            fs.delete(_files(spark, f"{root}/manifest/v{version}.json")[1], False)
        gone = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName() not in named]
        for path in gone:
            fs.delete(path, True)
        return [p.getName() for p in gone]

    def check(self, n_videos: int | None = None, n_vectors: int | None = None) -> None:
        """Counts agree, every vector has a video and every video its vectors; else an error."""
        per = self.vectors.groupBy("key").agg(F.count("*").alias("n"))
        bad = self.videos.join(per, "key", "full_outer").where("video_id is null or coalesce(n, 0) <> n_vectors")
        row = self.videos.agg(F.count("*"), F.coalesce(F.sum("n_vectors"), F.lit(0))).first()
        if not bad.isEmpty() or n_videos is not None and n_videos != row[0] or n_vectors is not None and n_vectors != row[1]:
            raise LibraryError("the library's tables don't agree")

    def add(self, videos: DataFrame, frames: DataFrame, replace: bool = False) -> Library:
        """Adds videos(video_id, source_path, sha256, duration_s, sample_fps, indexed_at) with frames(video_id, t, vector).

        All or nothing: a bad id, an id or a content that is there already (ids
        may be with replace), a bad vector or a video without frames is an error.
        New ids and keys go on from the counters and are never used again.
        """
        new = videos.select("video_id", "source_path", "sha256", "duration_s", "sample_fps", "indexed_at")
        if not new.where(~is_video_id(F.col("video_id"))).isEmpty():
            raise LibraryError("bad video id")
        if not new.groupBy("video_id").count().where("count > 1").isEmpty():
            raise LibraryError("a video id comes twice")
        if not replace and not new.join(self.videos, "video_id", "left_semi").isEmpty():
            raise LibraryError("video id exists")
        if not new.alias("n").join(self.videos.alias("o"), F.col("n.sha256") == F.col("o.sha256")).where("n.video_id <> o.video_id").isEmpty():
            raise LibraryError("the same content is there under another id")
        if not frames.where(~is_valid_vector(F.col("vector"), self.dim)).isEmpty():
            raise LibraryError("bad vector")
        counts = frames.groupBy("video_id").agg(F.count("*").cast("int").alias("n_vectors"))
        if not new.join(counts, "video_id", "left_anti").isEmpty():
            raise LibraryError("no frames")
        base = self._without(new.select("video_id")) if replace else self
        # keys are numbered over the batch of videos, ids within a video after the videos before it
        keyed = numbered(new.join(counts, "video_id"), "video_id", "n_vectors").withColumns({"key": (F.col("_n") + self.next_key).cast("int"), "_first": F.col("_before") + self.next_id})
        placed = frames.join(keyed.select("video_id", "key", "_first"), "video_id").withColumn("vector_id", F.col("_first") + F.row_number().over(Window.partitionBy("video_id").orderBy("t", F.xxhash64("vector"))) - 1)
        total = keyed.agg(F.count("*"), F.coalesce(F.sum("n_vectors"), F.lit(0))).first()
        vectors, rows = placed.selectExpr("cast(vector_id as long) vector_id", "key", "cast(t as float) t", "vector"), keyed.select(*base.videos.columns)
        change = base.change and changed(base.change, vectors=_plus(base.change.vectors, vectors), videos=_plus(base.change.videos, rows))
        return Library(base.vectors.unionByName(vectors), base.videos.unionByName(rows), self.embedder, self.dim, self.next_id + total[1], self.next_key + total[0], change)

    def remove(self, video_ids: list[str]) -> Library:
        """Without these videos; an id that isn't there is an error."""
        asked = self.videos.sparkSession.createDataFrame([(v,) for v in dict.fromkeys(video_ids)], "video_id string")
        if not asked.join(self.videos, "video_id", "left_anti").isEmpty():
            raise LibraryError("no such video")
        return self._without(asked)

    def _without(self, video_ids: DataFrame) -> Library:
        gone = self.videos.join(video_ids, "video_id", "left_semi").select("key")
        rest = lambda rows: rows.join(gone, "key", "left_anti").select(*rows.columns)
        change = self.change
        if change is not None:
            change = changed(change, vectors=None if change.vectors is None else rest(change.vectors), videos=None if change.videos is None else rest(change.videos), removed=_plus(change.removed, gone))
        return changed(self, vectors=rest(self.vectors), videos=rest(self.videos), change=change)

    def orphans(self) -> DataFrame:
        return self.vectors.join(self.videos, "key", "left_anti")

    def get(self, video_id: str) -> DataFrame:
        return self.videos.where(F.col("video_id") == video_id).limit(1)

    def by_key(self, key: int) -> DataFrame:
        return self.videos.where(F.col("key") == key).limit(1)

    def find_by_sha256(self, digest: str) -> DataFrame:
        return self.videos.where(F.col("sha256") == digest).limit(1)

    def decode(self, hits: DataFrame) -> DataFrame:
        """hits(vector_id, ...) with key, ref_t and video_id; ids that aren't in the library go."""
        placed = hits.join(self.vectors.select("vector_id", "key", F.col("t").cast("double").alias("ref_t")), "vector_id")
        return placed.join(self.videos.select("key", "video_id"), "key")

    def listing(self) -> DataFrame:
        """What may be told of the videos, by id; not where they came from."""
        return self.videos.select("video_id", "duration_s", "sample_fps", "n_vectors", "indexed_at").orderBy("video_id")

    def totals(self) -> DataFrame:
        """(n_videos, n_vectors, hours, index_bytes): four bytes a number."""
        n = F.coalesce(F.sum("n_vectors"), F.lit(0)).cast("long")
        return self.videos.agg(F.count("*").alias("n_videos"), n.alias("n_vectors"), (F.coalesce(F.sum("duration_s"), F.lit(0.0)) / 3600).alias("hours"), (n * self.dim * 4).alias("index_bytes"))
