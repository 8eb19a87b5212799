"""Exact inner-product top-k.

``topk`` keeps a library below ``broadcast_bytes`` as one broadcast matrix, which
each task multiplies its own queries by. Above, the library becomes an ``Index``:
its vectors are dealt to cells around centres learned from a bounded sample, and
written once, in blocks of about ``block_bytes`` with a centre and a radius each,
in a folder a cell, small cells in folders of some ``FOLDER_BYTES``. No vector of a
block has a higher product with a query than q.c + |q| r, so a block is skipped by
the queries whose k-th score so far is above that, and a folder whose cells all of
them skip isn't read.

A search takes the queries in groups of bounded bytes. Each group is broadcast and
meets the index twice: in the cells that promise most, for a first k-th score of
each query, and in all that are left. There, tasks take a slice of the index and a
part of the group, and meet small blocks in stacks of some ``BLOCK_BYTES``, a batch
of queries near the same cells at a time. The library is never copied or shuffled
by a search.

Ties go to the smaller vector_id. Rows whose vector is null or of the wrong length
give no hits; an empty library gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.columns import is_valid_vector
from ..staging import new_path, staged

BROADCAST_BYTES = 256 << 20
BLOCK_BYTES = 32 << 20
QUERY_BYTES = 64 << 20
FOLDER_BYTES = 8 << 20
SQL_VECTORS = 50_000
#: Rows and columns of the products that are held at a time, 4 MB in single precision, and bytes of what is scored again at a time.
BATCH, TILE, EXACT_BYTES = 512, 2048, 4 << 20
#: Tasks a core of a search; bytes of an index in a task, and parts at most that a group of queries is cut into beside that.
TASKS_A_CORE, SLICE_BYTES, MOST_PARTS = 4, 64 << 20, 64
#: Share of the pairs of queries and blocks above which blocks are multiplied at once.
DENSE = 0.75
#: Bounds of what the centres are learned from, and of their number; rounds of learning.
SAMPLE_BYTES, MAX_CELLS, CELL_ROUNDS = 64 << 20, 4096, 6
_NO_KEY = -(1 << 31)
_QUERY = "clip_id string, q_idx int, q_t double"
_HIT = "vector_id long, key int, ref_t double, score double"
_HITS = ["clip_id", "q_idx", "q_t", "rank", "vector_id", "key", "ref_t", "score"]


def _places(met: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the few that are true; looked for eight at a time."""
    if met.shape[1] % 8:
        return np.nonzero(met)
    eights = np.flatnonzero(met.reshape(-1).view(np.uint64))
    which, within = np.nonzero(met.reshape(-1, 8)[eights])
    return np.divmod(eights[which] * 8 + within, met.shape[1])


class Best:
    """The k best of each of n queries among the vectors met so far: rows (queries), ids, scores and what else comes with a vector.

    What a query may need is held back and sorted in when there is as much of it as of the best themselves.
    """

    def __init__(self, n: int, k: int, least: np.ndarray | None = None):
        self.k, self.n = k, n
        self.floor = np.full(n, -np.inf) if least is None else least.astype(float)
        self._held: tuple = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self._new: list[tuple] = []
        self._waiting = 0

    rows = property(lambda self: self._settled()[0])
    ids = property(lambda self: self._settled()[1])
    scores = property(lambda self: self._settled()[2])
    more = property(lambda self: self._settled()[3:])

    def meet(self, q: np.ndarray, vectors: np.ndarray, ids: np.ndarray, *more: np.ndarray, mine: np.ndarray | None = None) -> None:
        """Takes vectors in, for the queries at mine (all by default), whose rows q are.

        Products are taken in the vectors' own precision, a tile at a time; all that may
        reach a query's k-th score so far by its rounding error are scored again in double precision.
        Rows whose best product of a tile is below that are done with it.
        """
        mine = np.arange(self.n) if mine is None else mine
        longest = float(np.sqrt(np.einsum("ij,ij->i", vectors, vectors).max(initial=0)))
        error = 2 * np.finfo(vectors.dtype).eps * q.shape[1] * np.linalg.norm(q, axis=1) * longest
        q_own = q.astype(vectors.dtype)
        step = max(1, EXACT_BYTES // (8 * q.shape[1]))
        room = np.empty((len(q_own), min(TILE, len(vectors))), q_own.dtype)
        for lo in range(0, len(vectors), TILE):
            tile = vectors[lo : lo + TILE]
            near = room if len(tile) == room.shape[1] else np.empty((len(q_own), len(tile)), q_own.dtype)
            np.matmul(q_own, tile.T, out=near)
            floor = self.floor[mine] - error
            open_ = np.flatnonzero(near.max(axis=1, initial=-np.inf) >= floor)
            if not len(open_):
                continue
            if 2 * len(open_) < len(near):
                near, floor, at = near[open_], floor[open_], open_
            else:
                at = np.arange(len(near))
            met = near >= floor.astype(near.dtype)[:, None]
            if near.shape[1] > self.k and np.count_nonzero(met) > 2 * self.k * len(near):
                floor = np.maximum(floor, np.partition(near, near.shape[1] - self.k, axis=1)[:, -self.k] - error[at])
                met = near >= floor.astype(near.dtype)[:, None]
            rows, places = _places(met)
            rows = at[rows]
            for i in range(0, len(rows), step):
                r, c = rows[i : i + step], places[i : i + step]
                exact = np.einsum("ij,ij->i", q[r].astype(np.float64), tile[c].astype(np.float64))
                self._keep(mine[r], ids[c + lo], exact, *[m[c + lo] for m in more])

    def _keep(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, *more: np.ndarray) -> None:
        enough = scores >= self.floor[rows]
        self._new.append(tuple(x[enough] for x in (rows, ids, scores, *more)))
        self._waiting += int(enough.sum())
        if self._waiting > self.n * self.k:
            self._settled()

    def _settled(self) -> tuple:
        if self._new:
            old = (*self._held, *[m[:0] for m in self._new[0][len(self._held) :]])
            columns = [np.concatenate(x) for x in zip(old, *self._new, strict=True)]
            order = np.lexsort((columns[1], -columns[2], columns[0]))
            columns = [c[order] for c in columns]
            nth = np.arange(len(order)) - np.searchsorted(columns[0], columns[0])
            last = nth == self.k - 1
            self.floor[columns[0][last]] = np.maximum(self.floor[columns[0][last]], columns[2][last])
            self._held, self._new, self._waiting = tuple(c[nth < self.k] for c in columns), [], 0
        return self._held


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """(rows, dim) of a list column without nulls, in its own precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("clip_id", "q_idx").orderBy(F.desc("score"), "vector_id")
    return hits.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)


def _sound(library: DataFrame, dim: int) -> DataFrame:
    return library.where(is_valid_vector(F.col("vector"), dim)).select(F.col("vector_id").cast("long").alias("vector_id"), F.col("key").cast("int").alias("key"), F.col("t").cast("double").alias("t"), "vector")


def _asked(queries: DataFrame, dim: int) -> DataFrame:
    """The rows with a sound vector; told in Arrow, since a filter would be pushed below what makes the vectors, and make them anew for each of its terms."""
    rows = queries.select(F.col("clip_id").cast("string").alias("clip_id"), F.col("q_idx").cast("int").alias("q_idx"), F.col("q_t").cast("double").alias("q_t"), "vector")

    def sound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.equal(pc.list_value_length(batch.column(3)), dim))  # noqa: PLW2901
            if batch.num_rows:
                yield batch.filter(pa.array(np.isfinite(_matrix(batch.column(3), dim)).all(axis=1)))

    return rows.mapInArrow(sound, rows.schema)


def _width(vectors: DataFrame) -> int:
    return 4 if "float" in vectors.schema["vector"].dataType.simpleString() else 8


def centres_of(sample: np.ndarray, n: int, rounds: int = CELL_ROUNDS) -> np.ndarray:
    """n or fewer centres of the sample's rows: begun with evenly spread rows, moved to the means of the rows nearest to each."""
    if not len(sample):
        return np.zeros((0, sample.shape[1]))
    centres = sample[np.linspace(0, len(sample) - 1, min(n, len(sample))).astype(int)].astype(np.float32)
    for _ in range(rounds):
        cell = _nearest(sample, centres)
        order = np.argsort(cell, kind="stable")
        used, first = np.unique(cell[order], return_index=True)
        centres[used] = np.add.reduceat(sample[order].astype(np.float64), first, axis=0) / np.diff(np.append(first, len(sample)))[:, None]
    return np.unique(centres, axis=0).astype(np.float64)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres.astype(np.float64) ** 2).sum(1) / 2
    return np.concatenate([(x[lo : lo + BATCH] @ centres.T.astype(x.dtype) - half).argmax(1) for lo in range(0, len(x), BATCH)] or [np.zeros(0, np.int64)])


@dataclass
class Index:
    """A library in blocks by cell: path has folder=.../ folders, each of so many cells, of (chunk, n, centre, radius, width, ids, keys, times, vectors, cell)."""

    spark: SparkSession
    path: str
    dim: int
    cells: np.ndarray  # centre of each cell, of at most MAX_CELLS
    a_folder: int = 1
    met: Accumulator | None = None
    skipped: Accumulator | None = None

    @cached_property
    def blocks(self) -> DataFrame:
        return self.spark.read.schema("chunk int, n int, centre array<double>, radius double, width int, ids binary, keys binary, times binary, vectors binary, cell int, folder int").parquet(self.path)

    def of(self, cells: np.ndarray) -> DataFrame:
        """The blocks of some cells; only their folders are read."""
        return self.blocks.where(F.col("folder").isin(np.unique(cells // self.a_folder).tolist()) & F.col("cell").isin(cells.tolist())).drop("folder")

    def share_skipped(self) -> float:
        """Of the pairs of queries and blocks of all searches so far, the share that was skipped."""
        return self.skipped.value / max(1, self.met.value + self.skipped.value)


def build(library: DataFrame, dim: int, *, block_bytes: int = BLOCK_BYTES, cells: int | None = None, path: str | None = None) -> Index:
    """Indexes every row of library(vector_id, key, t, vector) with a sound vector; written once, to path or the shared folder.

    Centres come from a sample of SAMPLE_BYTES at most, chosen by a hash of the
    ids; there are as many as the library has blocks, up to MAX_CELLS. A cell of several blocks
    is cut by a hash of the ids, so that no task holds more than about a block, whatever
    the data; a block's centre and radius are its own.
    """
    spark, lib = library.sparkSession, _sound(library, dim)
    width = _width(lib)
    n = lib.count()
    wanted = min(MAX_CELLS, cells or max(1, -(-n * dim * width // block_bytes)))
    few = lib.orderBy(F.xxhash64("vector_id"), "vector_id").select("vector").limit(max(1, SAMPLE_BYTES // (dim * 8))).toArrow()
    centres = centres_of(_matrix(few["vector"], dim), wanted)
    shared = spark.sparkContext.broadcast(centres)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_nearest(_matrix(batch.column(3), dim), shared.value).astype(np.int32))], names=[*batch.schema.names, "cell"])

    celled = staged(lib.mapInArrow(dealt, StructType([*lib.schema, StructField("cell", IntegerType())])), "celled") if n else lib.withColumn("cell", F.lit(0))
    shared.unpersist()
    sizes = celled.groupBy("cell").agg(F.ceil(F.count("*") * dim * width / block_bytes).cast("int").alias("chunks"))  # a row a cell
    placed = celled.join(F.broadcast(sizes), "cell").withColumn("chunk", F.pmod(F.xxhash64("vector_id", F.lit(1)), F.col("chunks")).cast("int")).drop("chunks")

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by("vector_id")
        v = _matrix(group["vector"], dim)
        centre = v.mean(axis=0, dtype=np.float64)
        radius = max((float(np.sqrt(((v[lo : lo + TILE] - centre) ** 2).sum(1)).max()) for lo in range(0, len(v), TILE)), default=0.0)
        raw = [group["vector_id"].to_numpy().astype("<i8"), group["key"].fill_null(_NO_KEY).to_numpy().astype("<i4"), group["t"].fill_null(float("nan")).to_numpy().astype("<f8"), v.astype(f"<f{width}")]
        head = [pa.array([group["chunk"][0].as_py()], pa.int32()), pa.array([len(v)], pa.int32()), pa.array([centre.tolist()], pa.list_(pa.float64())), pa.array([radius]), pa.array([width], pa.int32())]
        return pa.table([*head, *[pa.array([x.tobytes()], pa.binary()) for x in raw], pa.array([group["cell"][0].as_py()], pa.int32())], names=["chunk", "n", "centre", "radius", "width", "ids", "keys", "times", "vectors", "cell"])

    tasks = max(spark.sparkContext.defaultParallelism, -(-n * dim * width // SLICE_BYTES))
    placed = placed.repartitionByRange(max(1, min(tasks, int(spark.conf.get("spark.sql.shuffle.partitions")))), "cell", "chunk")  # a cell's blocks lie in few files
    packed = placed.groupBy("cell", "chunk").applyInArrow(pack, "chunk int, n int, centre array<double>, radius double, width int, ids binary, keys binary, times binary, vectors binary, cell int")
    path = path or new_path(spark, "index")
    a_folder = max(1, FOLDER_BYTES * len(centres) // max(1, n * dim * width))
    packed.withColumn("folder", F.floor(F.col("cell") / a_folder).cast("int")).write.partitionBy("folder").parquet(path)
    return Index(spark, path, dim, centres, a_folder, spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0))


def _reach(q: np.ndarray, centre: np.ndarray, radius) -> np.ndarray:
    """What no product of a query with a vector of a block is above, rounding included; a column a block for several centres and radii."""
    norms = np.linalg.norm(q, axis=1).reshape(-1, *[1] * np.ndim(radius))
    slack = 8 * np.finfo(np.float64).eps * q.shape[1] * norms * (np.linalg.norm(centre, axis=-1) + radius)
    return q @ centre.T + norms * radius + slack


def _met(q: np.ndarray, least: np.ndarray | None, bound: np.ndarray, stack: Stack, k: int) -> tuple[Best, int]:
    """The k best of queries among a stack's blocks whose bound (a row a query, a column a block; nan: not wanted) reaches
    their k-th score, and the pairs of queries and blocks met.

    Where most queries need most of the blocks that any of them needs, these are multiplied at once, else block by block.
    """
    best = Best(len(q), k, least)
    need = bound >= best.floor[:, None]
    rows, blocks = np.flatnonzero(need.any(axis=1)), np.flatnonzero(need.any(axis=0))
    if not len(rows):
        return best, 0
    if need.sum() >= DENSE * len(rows) * len(blocks):
        columns = (stack.vectors, stack.ids, stack.keys, stack.times)
        if len(blocks) < len(stack.cells):
            chosen = np.zeros(len(stack.cells), bool)
            chosen[blocks] = True
            taken = np.flatnonzero(np.repeat(chosen, np.diff(stack.starts)))
            columns = tuple(x[taken] for x in columns)
        best.meet(q[rows], *columns, mine=rows)
        return best, len(rows) * len(blocks)
    pairs = 0
    for b in blocks:
        mine = np.flatnonzero(bound[:, b] >= best.floor)
        if len(mine):
            at = slice(stack.starts[b], stack.starts[b + 1])
            best.meet(q[mine], stack.vectors[at], stack.ids[at], stack.keys[at], stack.times[at], mine=mine)
            pairs += len(mine)
    return best, pairs


def _floors(index: Index, group, k: int) -> np.ndarray:
    """A k-th score of each query, from the blocks of its own cell alone."""
    dim = index.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, cell_of = group.value
        for stack in _stacks(batches, dim):
            for lo in range(0, len(vectors), BATCH):
                own = cell_of[lo : lo + BATCH, None] == stack.cells
                if own.any():
                    best, _ = _met(vectors[lo : lo + BATCH].astype(np.float64), None, np.where(own, np.inf, np.nan), stack, k)
                    yield pa.RecordBatch.from_arrays([pa.array(best.rows + lo), pa.array(best.scores)], names=["q", "score"])

    cell_of = group.value[1]
    order = Window.partitionBy("q").orderBy(F.desc("score"))
    found = index.of(np.unique(cell_of)).mapInArrow(run, "q long, score double").withColumn("nth", F.row_number().over(order)).where(F.col("nth") == k).select("q", "score").toArrow()
    out = np.full(len(cell_of), -np.inf)  # a number a query of the group
    out[found["q"].to_numpy()] = found["score"].to_numpy()
    return out


@dataclass
class Stack:
    """Blocks one after another: a row a block in cells, centres, radii; block b has the vectors from starts[b] to starts[b + 1]."""

    cells: np.ndarray
    centres: np.ndarray
    radii: np.ndarray
    starts: np.ndarray
    ids: np.ndarray
    keys: np.ndarray
    times: np.ndarray
    vectors: np.ndarray


def _stacks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[Stack]:
    """Blocks in stacks of BLOCK_BYTES, or a block where one has more."""
    held: list[tuple] = []

    def stacked() -> Stack:
        cells, centres, radii, *raw = zip(*held, strict=True)
        ids, keys, times, vectors = (x[0] if len(x) == 1 else np.concatenate(x) for x in raw)
        return Stack(np.array(cells), np.array(centres), np.array(radii), np.cumsum([0, *map(len, raw[0])]), ids, keys, times, vectors)

    size = 0
    for block in _read(batches, dim):
        if held and size + block[-1].nbytes > BLOCK_BYTES:
            yield stacked()
            held, size = [], 0
        held.append(block)
        size += block[-1].nbytes
    if held:
        yield stacked()


def _read(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple]:
    """(cell, centre, radius, ids, keys, times, vectors) of each block in turn."""
    for batch in batches:
        names = batch.schema.names
        for i in range(batch.num_rows):
            row = {n: batch.column(j)[i] for j, n in enumerate(names)}
            raw = lambda n, kind: np.frombuffer(row[n].as_buffer(), kind)  # noqa: B023, E731
            yield row["cell"].as_py(), np.array(row["centre"].as_py()), row["radius"].as_py(), raw("ids", "<i8"), raw("keys", "<i4"), raw("times", "<f8"), raw("vectors", f"<f{row['width'].as_py()}").reshape(-1, dim)


def search(queries: DataFrame, index: Index, k: int, *, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """hits(clip_id, q_idx, q_t, rank, vector_id, key, ref_t, score) of queries(clip_id, q_idx, q_t, vector), a row for each of its sound rows' k best."""
    spark, dim = index.spark, index.dim
    asked = staged(_asked(queries, dim), "queries")
    n = asked.count()
    groups = max(1, -(-n * dim * _width(asked) // query_bytes))
    met, skipped = index.met, index.skipped
    parts = []
    for g in range(groups):
        table = asked.where(F.pmod(F.xxhash64("clip_id", "q_idx"), F.lit(groups)) == g).toArrow()
        q = _matrix(table["vector"], dim)
        if not len(q) or not len(index.cells):
            continue
        cell_of = np.concatenate([(q[lo : lo + BATCH].astype(np.float64) @ index.cells.T).argmax(1) for lo in range(0, len(q), BATCH)])
        order = np.argsort(cell_of, kind="stable")  # queries of a batch need much the same blocks
        q, cell_of = q[order], cell_of[order]
        group = spark.sparkContext.broadcast((q, cell_of))
        floors = _floors(index, group, k)
        wanted, bytes_left = _cells_left(index, group, floors)
        asking = spark.sparkContext.broadcast((table.select(["clip_id", "q_idx", "q_t"]).take(pa.array(order)).combine_chunks(), floors))  # floors in a function would be sent once a part

        def run(batches: Iterator[pa.RecordBatch], part: int, of: int, group=group, asking=asking) -> Iterator[pa.RecordBatch]:
            vectors, names, floors = group.value[0], asking.value[0], asking.value[1].copy()
            for stack in _stacks(batches, dim):
                for lo in range(part * BATCH, len(vectors), of * BATCH):
                    at = slice(lo, lo + BATCH)
                    q = vectors[at].astype(np.float64)
                    best, pairs = _met(q, floors[at], _reach(q, stack.centres, stack.radii), stack, k)
                    met.add(pairs)
                    skipped.add(len(q) * len(stack.cells) - pairs)
                    if len(best.rows):
                        floors[at] = best.floor
                        keys, times = best.more
                        mine = names.take(pa.array(best.rows + lo)).combine_chunks().to_batches()[0]
                        yield pa.RecordBatch.from_arrays([*mine.columns, pa.array(best.ids), pa.array(keys, mask=keys == _NO_KEY), pa.array(times, mask=np.isnan(times)), pa.array(best.scores)], names=[x.split()[0] for x in f"{_QUERY}, {_HIT}".split(", ")])

        # few slices of the index, so that few tasks give k hits for one query, and parts of the group for the other cores;
        # never one slice: a union of single partitions is a single partition, one task
        tasks = -(-TASKS_A_CORE * spark.sparkContext.defaultParallelism // groups)
        slices = max(2, -(-bytes_left // SLICE_BYTES), -(-tasks // MOST_PARTS))
        of = max(1, min(-(-tasks // slices), -(-len(q) // BATCH)))
        left = index.of(wanted).coalesce(slices)
        parts += [left.mapInArrow(partial(run, part=part, of=of), f"{_QUERY}, {_HIT}") for part in range(of)]
    if not parts:
        return spark.createDataFrame([], f"{_QUERY}, rank int, {_HIT}").select(*_HITS)
    hits = parts[0]
    for more in parts[1:]:
        hits = hits.union(more)
    return _ranked(hits, k).select(*_HITS)


def _cells_left(index: Index, group, floors: np.ndarray) -> tuple[np.ndarray, int]:
    """The cells with a block that any query of the group may need, and the bytes of their vectors; only centres and radii are read."""
    skipped, dim = index.skipped, index.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = group.value[0]
        for batch in batches:
            cells, centres, radii = batch.column(0).to_numpy(), _matrix(batch.column(1), dim), batch.column(2).to_numpy()
            size = batch.column(3).to_numpy().astype(np.int64) * batch.column(4).to_numpy() * dim
            open_ = np.arange(len(cells))  # blocks that no query needs so far
            for lo in range(0, len(vectors), BATCH):
                if not len(open_):
                    break
                reached = np.zeros(len(open_), bool)
                q = vectors[lo : lo + BATCH].astype(np.float64)
                for i in range(0, len(open_), TILE):
                    some = open_[i : i + TILE]
                    reached[i : i + TILE] = (_reach(q, centres[some], radii[some]) >= floors[lo : lo + BATCH, None]).any(axis=0)
                open_ = open_[~reached]
            needed = np.ones(len(cells), np.int64)
            needed[open_] = 0
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(needed), pa.array(1 - needed), pa.array(size)], names=["cell", "needed", "spared", "size"])

    rows = index.blocks.select("cell", "centre", "radius", "n", "width").mapInArrow(run, "cell int, needed long, spared long, size long").groupBy("cell").agg(F.sum("needed").alias("needed"), F.sum("spared").alias("spared"), F.sum("size").alias("size")).collect()  # a row a cell
    skipped.add(sum(r["spared"] for r in rows if not r["needed"]) * len(floors))
    return np.array(sorted(r["cell"] for r in rows if r["needed"]), np.int64), sum(r["size"] for r in rows if r["needed"])


def topk(queries: DataFrame, library: DataFrame, k: int, dim: int, *, broadcast_bytes: int = BROADCAST_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """hits(clip_id, q_idx, q_t, rank, vector_id, key, ref_t, score) of queries(clip_id, q_idx, q_t, vector) in library(vector_id, key, t, vector)."""
    lib = _sound(library, dim)
    if lib.count() * dim * _width(lib) > broadcast_bytes:
        return search(queries, build(library, dim, block_bytes=block_bytes), k)
    q = _asked(queries, dim).repartition(TASKS_A_CORE * queries.sparkSession.sparkContext.defaultParallelism, "clip_id", "q_idx")  # the products' work, not the queries' bytes, is what is dealt out
    held = lib.orderBy("vector_id").toArrow()
    shared = queries.sparkSession.sparkContext.broadcast((held["vector_id"].to_numpy().astype(np.int64), held["key"].combine_chunks(), held["t"].combine_chunks(), _matrix(held["vector"], dim)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, keys, times, vectors = shared.value
        all_places = np.arange(len(ids))
        for whole in batches:
            for lo in range(0, whole.num_rows, BATCH):
                batch = whole.slice(lo, BATCH)
                if not len(ids) or not batch.num_rows:
                    continue
                best = Best(batch.num_rows, k)
                best.meet(_matrix(batch.column(3), dim), vectors, ids, all_places)
                take, places = pa.array(best.rows), pa.array(best.more[0])
                nth = np.arange(len(best.rows)) - np.searchsorted(best.rows, best.rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take), pa.array(nth.astype(np.int32)), pa.array(best.ids), keys.take(places), times.take(places), pa.array(best.scores)], names=_HITS)

    return q.mapInArrow(run, f"{_QUERY}, rank int, {_HIT}")


def topk_sql(queries: DataFrame, library: DataFrame, k: int) -> DataFrame:
    """The same as a relational plan: the library is met in slices of SQL_VECTORS rows, a broadcast each.

    Block products tell the k vectors of a slice that each query is nearest to, of those that reach
    its k-th score among the slices before; these are joined by id, scored by an expression, and ranked
    with the hits so far. Every pair is multiplied, so time grows with the product of queries and
    library; memory doesn't, and only k pairs a query and slice are joined.
    """
    dim = library.select(F.max(F.size("vector"))).first()[0] or 0
    lib = _sound(library, dim)
    n = lib.count()
    if not n:
        return queries.sparkSession.createDataFrame([], f"{_QUERY}, rank int, {_HIT}").select(*_HITS)
    asked = staged(_asked(queries, dim), "asked")
    held = staged(lib.withColumnsRenamed({"t": "ref_t", "vector": "held"}).withColumn("_h", F.pmod(F.xxhash64("vector_id"), F.lit(n))), "library")
    score = F.aggregate(F.zip_with("vector", "held", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda a, x: a + x)
    kept = None
    for lo in range(0, n, SQL_VECTORS):
        some = held.where(F.col("_h").between(lo, lo + SQL_VECTORS - 1)).drop("_h")
        if kept is None:
            left = asked.withColumn("floor", F.lit(float("-inf")))
        else:
            floors = kept.groupBy("clip_id", "q_idx").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(float("-inf"))).alias("floor"))
            left = asked.join(floors, ["clip_id", "q_idx"], "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        near = _near(left, some, k, dim).withColumn("vector_id", F.explode("near"))
        found = near.join(F.broadcast(some), "vector_id").select("clip_id", "q_idx", "q_t", "vector_id", "key", "ref_t", score.alias("score"))
        ranked = _ranked(found if kept is None else found.unionByName(kept.drop("rank")), k).select(*_HITS)
        if lo + SQL_VECTORS >= n:
            return ranked
        kept = staged(ranked, "hits")


def _near(queries: DataFrame, some: DataFrame, k: int, dim: int) -> DataFrame:
    """queries(clip_id, q_idx, q_t, vector, floor) with near, the ids of the k rows of some(vector_id, held) with the highest products of at least floor."""
    spark = queries.sparkSession
    table = some.select("vector_id", "held").orderBy("vector_id").toArrow()
    sent = spark.sparkContext.broadcast((table["vector_id"].to_numpy(), _matrix(table["held"], dim)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = sent.value
        for whole in batches:
            for lo in range(0, whole.num_rows, BATCH):
                batch = whole.slice(lo, BATCH)
                floor = batch.column(4).to_numpy()
                best = Best(batch.num_rows, k, floor - 1e-9 * np.abs(floor))  # its sums may differ from the expression's in the last places
                best.meet(_matrix(batch.column(3), dim), vectors, ids)
                at = np.searchsorted(best.rows, np.arange(batch.num_rows + 1))
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(best.ids))], names=["clip_id", "q_idx", "q_t", "vector", "near"])

    kind = queries.schema["vector"].dataType.simpleString()
    dealt = queries.select("clip_id", "q_idx", "q_t", "vector", "floor").repartition(TASKS_A_CORE * spark.sparkContext.defaultParallelism, "clip_id", "q_idx")
    return dealt.mapInArrow(run, f"{_QUERY}, vector {kind}, near array<long>")
