"""Readers of manifests and media files; readers and writers of answer keys."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.columns import is_video_id, suffix


def media(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".mp4", ".mkv", ".mov", ".avi", ".webm", ".m4v", ".ogv", ".mpg")) -> DataFrame:
    """path, length, sha256 of a folder's media files, by path; contents are hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(suffix(F.col("path")).isin(*suffixes)).select("path", "length", F.sha2("content", 256).alias("sha256")).orderBy("path")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Films of a manifest; ids must be unique and well formed, roles and archive kinds known, and one film at least indexed."""
    films = spark.read.schema(f"films array<struct<{schemas.FILMS.replace(' string', ':string').replace(' int', ':int').replace(' long', ':bigint')}>>").option("multiLine", True).json(path).select(F.explode("films").alias("f")).select("f.*")
    found = manifest_problems(films).first()
    if any(found[c] for c in ("bad_ids", "bad_roles", "bad_archives", "repeated_ids")) or not found["n_library"]:
        raise ValueError(f"bad manifest: {found.asDict()}")
    return films


def manifest_problems(films: DataFrame) -> DataFrame:
    """One row: n_films, bad_ids, bad_roles, bad_archives, repeated_ids (ids that come twice or more), n_library."""
    bad = lambda c: F.count(F.when(c, 1))
    per = films.groupBy("id").agg(
        F.count("*").alias("n"), bad(~is_video_id(F.col("id"))).alias("bad_ids"), bad(~F.coalesce(F.col("role").isin("library", "heldout"), F.lit(False))).alias("bad_roles"),
        bad(~F.coalesce(F.col("archive").isin("", "zip"), F.lit(True))).alias("bad_archives"), bad(F.col("role") == "library").alias("n_library"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_films"), total("bad_ids"), total("bad_roles"), total("bad_archives"), bad(F.col("n") > 1).alias("repeated_ids"), total("n_library"))


def manifest_digest(spark: SparkSession, path: str) -> str:
    """The manifest file's sha256: what results are bound to."""
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]


def save_answer_key(specs: DataFrame, path: str, meta: dict) -> None:
    """JSON lines; the first file is one line with the meta data."""
    spark = specs.sparkSession
    spark.createDataFrame([(json.dumps({"meta": meta}),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    specs.select(F.to_json(F.struct(*specs.columns)).alias("value")).write.mode("append").text(path)


def load_answer_key(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    lines = spark.read.text(path)
    head = F.get_json_object("value", "$.meta")
    meta = lines.where(head.isNotNull()).select(head.alias("m")).first()
    return lines.where(head.isNull()).select(F.from_json("value", schemas.QUERY_SPECS).alias("s")).select("s.*"), json.loads(meta["m"]) if meta else {}


def largest_member(files: DataFrame, suffixes: tuple[str, ...] = (".mp4", ".mkv", ".mov", ".avi", ".webm")) -> DataFrame:
    """(path, member, length, error) of zip files read as binaryFile: the largest media member; a bad archive is a row with an error."""
    out = "path string, member string, length long, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    members = [m for m in zipfile.ZipFile(io.BytesIO(raw)).infolist() if m.filename.lower().endswith(suffixes)]
                    best = max(members, key=lambda m: (m.file_size, m.filename))
                    rows.append((path, best.filename, best.file_size, None))
                except (zipfile.BadZipFile, ValueError) as e:
                    rows.append((path, None, None, str(e)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], names=[x.split()[0] for x in out.split(", ")])

    return files.select("path", "content").mapInArrow(run, out)
