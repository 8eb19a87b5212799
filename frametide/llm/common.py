"""Shared pieces of the training-data operators: tables, shared folder, word arrays.

Words are split on ASCII white space (``[\\x20\\x09-\\x0D]``).  ``blocks`` reads
the UTF-8 buffer of an Arrow column directly, so that tokenising and hashing are
a handful of numpy passes over about 1 MB at a time, whatever the batch size is.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import new_path, remove

BLOCK_BYTES = 1 << 20
MAP_BITS = 27


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it: lineage ends there.

    Shuffle files of what was written go when the driver's references to it do;
    asking for a collection now keeps the phases' files from adding up on disk.
    """
    spark, schema = df.sparkSession, df.schema
    path = new_path(spark, name)
    df.write.parquet(path)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what materialize wrote for tables; nothing may read them any more."""
    for df in tables:
        remove(df.sparkSession, df._written)


_CACHES: dict[str, Callable[[], None]] = {}


def kept_between_tasks(name: str, clear: Callable[[], None]) -> None:
    """Names what a Python worker keeps for its next task of the same kind, and how to let it go."""
    _CACHES[name] = clear


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, keep: str | None = None) -> DataFrame:
    """mapInArrow in workers that give back memory.

    Workers are used again for other stages, and idle ones stay. A task
    begins without what others keep, and what it freed goes to the system when it ends.
    """

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _let_go(keep)
        yield from run(batches)
        _give_back()

    return df.mapInArrow(tidy, schema)


def _let_go(keep: str | None) -> None:
    for name, clear in _CACHES.items():
        if name != keep:
            clear()


def _give_back() -> None:
    _powers[:] = [np.ones(1, _U), np.ones(1, _U)]
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n; kept up to 2 M entries."""
    if len(_powers[0]) < n:
        made = []
        for base in (_P, _P_INV):
            x = np.full(max(n, 1 << 16), base, _U)
            x[0] = 1
            made.append(np.cumprod(x, dtype=_U))
        if n > 1 << 21:
            return made[0], made[1]
        _powers[:] = made
    return _powers[0], _powers[1]


@dataclass
class Block:
    """Some rows of a batch. Words of row r are wptr[r] to wptr[r + 1]."""

    lo: int
    hi: int
    data: np.ndarray
    rows: np.ndarray  # where each row's bytes begin in data, and the end
    starts: np.ndarray
    ends: np.ndarray
    wptr: np.ndarray

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.wptr)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self.starts):
            return np.zeros(0, _U)
        up, down = powers(len(self.data) + 1)
        h = np.zeros(len(self.data) + 1, _U)
        np.cumsum(_BYTE[self.data] * up[: len(self.data)], out=h[1:])
        return mix((h[self.ends] - h[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(_U))

    def room(self, k: int) -> np.ndarray:
        """For each word, whether k words of its row start there."""
        last = np.repeat(self.wptr[1:], self.n_words)
        return np.arange(len(self.starts)) + k <= last


def blocks(column: pa.Array, lower: bool = False, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Rows lo to hi at a time; a null text has no words."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, at, raw = column.buffers()
    offs = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        data = whole[offs[lo] : offs[hi]]
        data = _LOWER[data] if lower else data
        rows = offs[lo : hi + 1] - offs[lo]
        word = np.zeros(len(data) + 2, bool)
        np.logical_not(_SPACE[data], out=word[1:-1])
        edge = np.zeros(len(data) + 1, bool)
        edge[rows] = True
        starts = np.flatnonzero(word[1:] & (~word[:-1] | edge))
        ends = np.flatnonzero(word[:-1] & (~word[1:] | edge))
        starts = starts[starts < len(data)]
        yield Block(lo, hi, data, rows, starts, ends, np.searchsorted(starts, rows))
        lo = hi


def bitmap_of(keys: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of 2**bits places of the first bits of keys' only column, evenly spread hashes; made in parts of 2**15 places on the executors."""
    low = min(bits, 15)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            at = (np.asarray(batch.column(0)).view(_U) >> _U(64 - bits)).astype(np.int64)
            part = at >> low
            for p in np.unique(part).tolist():
                mine = parts.setdefault(p, np.zeros(1 << low >> 3, np.uint8))
                x = at[part == p] & ((1 << low) - 1)
                np.bitwise_or.at(mine, x >> 3, (1 << (x & 7)).astype(np.uint8))
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), pa.array([x.tobytes() for x in parts.values()], pa.binary())], names=["part", "bits"])

    out = np.zeros((1 << bits - low, 1 << low >> 3), np.uint8)
    spread = F.shiftrightunsigned(keys.columns[0], 64 - bits + low) if bits > low else F.lit(0)
    n = max(1, min(1 << bits - low, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    for r in keys.repartition(n, spread).transform(mapped, run, "part long, bits binary").collect():
        out[r["part"]] |= np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def map_bits_for(n: int, most: int) -> int:
    """12 places or more a key, up to 2**most places in all; beyond, more of the others pass, but none of the keys is missed."""
    return max(3, min(most, max(16, (12 * n).bit_length())))


def in_bitmap(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of x have their place set in bits; where one of the keys is, it is."""
    at = (x >> _U(64 - (len(bits) * 8).bit_length() + 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def among(ids: DataFrame, *columns: Column | str, map_bits: int = MAP_BITS) -> Column:
    """Whether columns may be one of the rows of ids, by its columns in turn; true for all of them.

    What is sent to the executors is a bitmap of at most 2**map_bits places (16 MB),
    so that only the rows in question need be shuffled to a join with ids.
    """
    spark = ids.sparkSession
    keys = ids.select(F.xxhash64(*ids.columns).alias("key"))
    sent = spark.sparkContext.broadcast(bitmap_of(keys, map_bits_for(ids.count(), map_bits)))

    @F.arrow_udf("boolean")
    def may(key: pa.Array) -> pa.Array:
        return pa.array(in_bitmap(sent.value, np.asarray(key).view(_U)))

    return may(F.xxhash64(*columns))


#: Keys with at least one in so many rows are looked up by broadcast: there can't be more of them than this.
HOT_KEYS = 4096


def look_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows with the columns of table, which has a row a key; null where it has none.

    Rows of frequent keys meet a broadcast of these keys' few rows; only the others are
    shuffled by key, so that no key makes a task much larger than the rest.
    """
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_rows"))
    hot = materialize(counts.where(F.col("_rows") * HOT_KEYS > F.lit(rows.count())).select(key), "hot-keys")
    near = rows.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(table.join(F.broadcast(hot), key, "left_semi")), key, "left")
    return near.unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(table, key, "left"))


_MULT = mix(np.arange(1001, 1001 + 64, dtype=_U)) | _U(1)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place; the last k - 1 places are not meant."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.full(n, k, _U)
    for j in range(k):
        out += h[j : j + n] * _MULT[j]
    return mix(out)


def unused(columns: list[str], *names: str) -> list[str]:
    """names, each with as many underscores more as it takes to be none of columns, whatever the case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def row_key(*columns: str) -> dict[str, Column]:
    """128 bits of a row's own values, as _k1 and _k2: the same wherever and however often the row is read.

    Rows that are equal in these columns share a key; a row number would depend on
    how the plan deals out the rows.
    """
    return {"_k1": F.xxhash64(*columns), "_k2": F.xxhash64(F.lit("key"), *reversed(columns))}
