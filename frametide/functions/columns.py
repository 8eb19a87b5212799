"""Column functions: vectors, times, ids, formats. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of ids.
VIDEO_ID = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"
REQUEST_ID = r"^[A-Za-z0-9._-]{1,64}$"
_INF = float("inf")


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(inner_product(v, v))


def l2_normalize(v: Column) -> Column:
    """Unit length in single precision; the divisor is at least 1e-12. v and its norm are evaluated once."""
    held = F.transform(F.array(v), lambda u: F.struct(u.alias("u"), F.greatest(norm(u), F.lit(1e-12)).alias("n")))
    return F.get(F.transform(held, lambda s: F.transform(s["u"], lambda x: (x.cast("double") / s["n"]).cast("float"))), F.lit(0))


def is_valid_vector(v: Column, dim: int) -> Column:
    """Right length, all elements finite and not null."""
    return F.coalesce((F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(_INF))), F.lit(False))


def rounded(x: Column, digits: int) -> Column:
    """Half-even on the scaled double, as array libraries round."""
    scale = float(10**digits)
    return F.rint(x * scale) / scale


def clipped(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def query_rate(duration: Column, fps: float, max_frames: int) -> Column:
    """Frames a second of a clip: no more than max_frames in all."""
    return F.when(duration > 0, F.least(F.lit(float(fps)), F.lit(float(max_frames)) / duration)).otherwise(F.lit(float(fps)))


def video_id_of(path: Column) -> Column:
    """A file's stem with other characters than [A-Za-z0-9._-] as one dash, no dashes or dots at the ends, 128 characters; else video."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    clean = F.substring(F.regexp_replace(F.regexp_replace(stem, r"[^A-Za-z0-9._-]+", "-"), r"^[-.]+|[-.]+$", ""), 1, 128)
    return F.when(clean == "", "video").otherwise(clean)


def is_video_id(x: Column) -> Column:
    return F.coalesce(x.rlike(VIDEO_ID), F.lit(False))


def request_id(x: Column) -> Column:
    return F.when(x.rlike(REQUEST_ID), x).otherwise(F.uuid())


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def rejection(name: Column, size: Column, duration: Column, suffixes: list[str], max_mb: float, max_seconds: float) -> Column:
    """Why an input isn't taken: 415 suffix, 413 size, 422 unreadable or too long; null if it is."""
    return F.when(~suffix(name).isin(suffixes), 415).when(size > max_mb * 1024 * 1024, 413).when(duration.isNull() | (duration > max_seconds), 422)


def percent(x: Column) -> Column:
    return F.when(x.isNull(), "-").otherwise(F.format_string("%.1f%%", x * 100))


def bucket(x: Column, lo: float, hi: float, n: int) -> Column:
    """Place of x in n equal buckets, 0 below and n + 1 above."""
    return F.width_bucket(x, F.lit(lo), F.lit(hi), F.lit(n))


def realtime_factor(duration: Column, seconds: Column) -> Column:
    """Seconds of video for each second of work."""
    return duration / F.greatest(seconds, F.lit(1e-9))


def now_utc() -> Column:
    """When the query began, as ISO 8601 in UTC."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
