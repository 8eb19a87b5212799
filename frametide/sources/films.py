"""Film records: what was fetched of each film of a manifest, and joins of the two that miss nothing silently."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .library import LibraryError

FILM_FILES = "film_id string, path string, sha256 string, md5_verified boolean, duration_s double, width int, height int, pts_shift_s double"


def records(spark: SparkSession, path: str) -> DataFrame:
    """Records of films, one JSON object a file in a folder; a stream that starts at 0 where the record doesn't say."""
    return spark.read.schema(FILM_FILES).option("multiLine", True).json(path).withColumn("pts_shift_s", F.coalesce("pts_shift_s", F.lit(0.0)))


def save_record(spark: SparkSession, root: str, record: dict) -> None:
    """One film's record, replaced as a whole."""
    spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root.rstrip('/')}/{record['film_id']}")


def records_of(films: DataFrame, probed: DataFrame, hashed: DataFrame) -> DataFrame:
    """FILM_FILES of films(id, md5) from probe's rows and digests (path, md5, sha256) of files named by their film's id."""
    stem = F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1)
    files = probed.where("error is null").join(hashed.select("path", "sha256", F.col("md5").alias("_md5")), "path").withColumn("id", stem)
    met = films.select("id", "md5").join(files, "id")
    return met.select(F.col("id").alias("film_id"), "path", "sha256", F.coalesce(F.lower("md5") == F.col("_md5"), F.lit(False)).alias("md5_verified"), "duration_s", "width", "height", F.lit(0.0).alias("pts_shift_s"))


def by_role(films: DataFrame, role: str) -> DataFrame:
    """The films of a role: library or heldout."""
    return films.where(F.col("role") == role)


def film(films: DataFrame, film_id: str) -> DataFrame:
    return films.where(F.col("id") == film_id).limit(1)


def only(films: DataFrame, film_ids: list[str]) -> DataFrame:
    """The films of a list of ids, of any length that a command line has; an id that isn't there is an error."""
    asked = films.sparkSession.createDataFrame([(x,) for x in dict.fromkeys(film_ids)], "id string")
    _refuse(asked.join(films, "id", "left_anti"), "id", "no such films")
    return films.join(asked, "id", "left_semi")


def with_files(films: DataFrame, files: DataFrame) -> DataFrame:
    """films joined with their records; missing ones are an error that names them all."""
    _refuse(films.join(files, films["id"] == files["film_id"], "left_anti"), "id", "films without a file")
    return films.join(files, films["id"] == files["film_id"]).drop("id")


def uncovered(films: DataFrame) -> DataFrame:
    """Held-out films whose group has no film in the library: nothing there looks like them."""
    return by_role(films, "heldout").join(by_role(films, "library").select("group").distinct(), "group", "left_anti")


def _refuse(rows: DataFrame, column: str, what: str) -> None:
    """An error with all values of column, which a manifest bounds."""
    found = rows.select(F.sort_array(F.collect_list(column)).alias("x")).first()["x"]
    if found:
        raise LibraryError(f"{what}: {', '.join(found)}")


def expected_id(role: Column, film_id: Column) -> Column:
    """The answer that a query should get: its film where that is indexed, none where it isn't."""
    return F.when(role == "library", film_id)
