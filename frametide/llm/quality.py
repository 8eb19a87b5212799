"""Quality classifier: a byte-level convolutional network in numpy.

Every byte has a learned vector; learned filters of WIDTH bytes slide over the
whole document STRIDE bytes at a time; each overlapping chunk of CHUNK bytes (the
next begins half a chunk later) keeps the maximum of each filter; the mean and
the maximum over chunks go through one logistic unit. Training is Adam on a
bounded, hashed sample of labelled rows; scoring reads every byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped

#: Bounds of the training sample: rows, and bytes of a document that may be in it.
TRAIN_ROWS, TRAIN_DOC_BYTES = 3_000, 8_192
EMBED, WIDTH, STRIDE, FILTERS = 6, 8, 4, 24
CHUNK = 512
HALF = CHUNK // 2
EPOCHS, BATCH, RATE, SEED = 5, 48, 0.01, 7
BLOCK_BYTES = 1 << 19
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


@dataclass
class Net:
    embed: np.ndarray  # (256, EMBED)
    filters: np.ndarray  # (WIDTH * EMBED, FILTERS)
    bias: np.ndarray
    weights: np.ndarray  # (2 * FILTERS,)
    offset: np.ndarray  # (1,)

    @classmethod
    def new(cls) -> Net:
        rng = np.random.default_rng(SEED)
        f = np.float32
        return cls(rng.normal(0, 0.5, (256, EMBED)).astype(f), rng.normal(0, 1 / np.sqrt(WIDTH * EMBED), (WIDTH * EMBED, FILTERS)).astype(f), np.zeros(FILTERS, f), np.zeros(2 * FILTERS, f), np.zeros(1, f))

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.weights, self.offset]


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Documents one after the other, each padded by at least WIDTH zeros to whole half chunks; halves of each."""
    halves = np.array([-(-(len(t) + WIDTH) // HALF) for t in texts])
    return np.frombuffer(b"".join(t.ljust(int(h) * HALF, b"\0") for t, h in zip(texts, halves, strict=True)) + bytes(WIDTH), np.uint8), halves


def _patches(data: np.ndarray, embed: np.ndarray) -> np.ndarray:
    """A view: (positions, WIDTH * EMBED)."""
    rows = embed[data]
    n = (len(data) - WIDTH) // STRIDE
    step = rows.strides[0]
    return np.lib.stride_tricks.as_strided(rows, (n, WIDTH * EMBED), (step * STRIDE, rows.strides[1]))


def _forward(net: Net, data: np.ndarray, halves: np.ndarray, places: bool = False):
    """Chunk maxima pooled per document: (docs, 2 * FILTERS); with places, what backpropagation needs."""
    made = _patches(data, net.embed) @ net.filters
    made = made.reshape(-1, HALF // STRIDE, FILTERS)
    top = made.max(1)
    first = np.cumsum(halves) - halves
    n_chunks = np.maximum(halves - 1, 1)
    at = np.repeat(first, n_chunks) + np.arange(n_chunks.sum()) - np.repeat(np.cumsum(n_chunks) - n_chunks, n_chunks)
    also = np.minimum(at + 1, np.repeat(first + halves - 1, n_chunks))
    chunk = np.maximum(np.maximum(top[at], top[also]) + net.bias, 0)
    begins = np.cumsum(n_chunks) - n_chunks
    mean = np.add.reduceat(chunk, begins) / n_chunks[:, None]
    most = np.maximum.reduceat(chunk, begins)
    pooled = np.concatenate([mean, most], 1)
    return (pooled, made, top, at, also, chunk, begins, n_chunks, most) if places else pooled


def scores(net: Net, texts: list[bytes]) -> np.ndarray:
    out = np.empty(len(texts))
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= BLOCK_BYTES):
            size += len(texts[hi])
            hi += 1
        if len(texts[lo]) > 2 * BLOCK_BYTES:  # one very long text: its chunks in turn
            out[lo] = _score_long(net, texts[lo])
            hi = lo + 1
        else:
            data, halves = laid_out(texts[lo:hi])
            out[lo:hi] = _logistic(_forward(net, data, halves) @ net.weights + net.offset)
        lo = hi
    return out


def _score_long(net: Net, text: bytes) -> float:
    """The same network over one long text; its parts share half chunks, so that no chunk is lost."""
    n_chunks, total, most, lo = 0, np.zeros(FILTERS, np.float64), np.zeros(FILTERS, np.float32), 0
    while lo == 0 or lo + HALF < len(text) + WIDTH:
        piece = text[lo : lo + BLOCK_BYTES + HALF + WIDTH]
        ended = lo + BLOCK_BYTES + HALF >= len(text) + WIDTH
        halves = -(-(len(piece) + WIDTH) // HALF) if ended else BLOCK_BYTES // HALF + 1
        data = np.frombuffer(piece[: halves * HALF + WIDTH].ljust(halves * HALF + WIDTH, b"\0"), np.uint8)
        pooled = _forward(net, data, np.array([halves]))[0]
        n = max(halves - 1, 1)
        total += pooled[:FILTERS].astype(np.float64) * n
        most = np.maximum(most, pooled[FILTERS:])
        n_chunks += n
        lo += BLOCK_BYTES
        if ended:
            break
    return float(_logistic(np.concatenate([total / n_chunks, most]) @ net.weights + net.offset)[0])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(texts: list[bytes], labels: np.ndarray) -> Net:
    """Balanced logistic loss; an empty or one-sided sample leaves a network that says its share of label 1."""
    net = Net.new()
    share = float(labels.mean()) if len(labels) else 0.5
    if share in (0.0, 1.0) or not len(labels):
        net.offset[:] = np.log((share + 0.01) / (1.01 - share))
        return net
    cost = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    rng, moments, n = np.random.default_rng(SEED), [(np.zeros_like(p), np.zeros_like(p)) for p in net.parts()], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), BATCH):
            pick = order[lo : lo + BATCH]
            n += 1
            rate = RATE * 0.5 ** (epoch / 2)
            for p, g, (m, v) in zip(net.parts(), _gradients(net, [texts[i] for i in pick], labels[pick], cost[pick]), moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.999**n)) + 1e-7)
    return net


def _gradients(net: Net, texts: list[bytes], labels: np.ndarray, cost: np.ndarray) -> list[np.ndarray]:
    data, halves = laid_out(texts)
    pooled, made, top, at, also, chunk, begins, n_chunks, most = _forward(net, data, halves, places=True)
    error = ((_logistic(pooled @ net.weights + net.offset) - labels) * cost / len(texts)).astype(np.float32)
    owner = np.repeat(np.arange(len(texts)), n_chunks)
    back = error[:, None] * net.weights
    # to chunks: through the mean, and to the first chunk that has the maximum
    d_chunk = back[owner, :FILTERS] / n_chunks[owner, None]
    is_top = chunk == most[owner]
    first = np.full((len(texts), FILTERS), len(chunk))
    np.minimum.at(first, owner, np.where(is_top, np.arange(len(chunk))[:, None], len(chunk)))
    d_chunk[first, np.arange(FILTERS)] += back[:, FILTERS:]
    d_chunk = np.where(chunk > 0, d_chunk, 0)
    d_top = np.zeros_like(top)
    left = top[at] >= top[also]
    np.add.at(d_top, at, np.where(left, d_chunk, 0))
    np.add.at(d_top, also, np.where(left, 0, d_chunk))
    # to the position of each half chunk's maximum
    where = made.argmax(1) + np.arange(len(made))[:, None] * (HALF // STRIDE)
    patches = _patches(data, net.embed)
    d_filters, d_embed = np.zeros_like(net.filters), np.zeros_like(net.embed)
    for f in range(FILTERS):
        picked = patches[where[:, f]]
        d_filters[:, f] = picked.T @ d_top[:, f]
        spread = d_top[:, f, None] * net.filters[:, f]
        letters = data[where[:, f, None] * STRIDE + np.arange(WIDTH)]
        np.add.at(d_embed, letters.ravel(), spread.reshape(-1, EMBED))
    return [d_embed, d_filters, d_chunk.sum(0), pooled.T @ error, error.sum(keepdims=True)]


def fit(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, doc_bytes: int = TRAIN_DOC_BYTES) -> Net:
    """Learns from at most rows labelled documents that aren't held out, of at most doc_bytes bytes each.

    Of several labels of a document the mean counts, from a half on as 1.
    """
    usable = labels.where("doc_id is not null and quality is not null and crc32(cast(doc_id as string)) % 3 <> 1").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = documents.select("doc_id", "text").where(F.octet_length("text").between(1, doc_bytes)).join(F.broadcast(chosen), "doc_id")  # at most rows rows of two numbers
    got = found.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(rows).collect()
    return train([r["text"].encode() for r in got], np.array([r["label"] for r in got], np.float32))


def classify(documents: DataFrame, net: Net) -> DataFrame:
    """One row per row of documents: doc_id, held_out, score, predicted.

    Null texts score as empty ones; texts of any length are read whole, a bounded
    part at a time. Repeated rows are scored each; a null doc_id isn't held out;
    an empty table gives no rows; other columns aren't looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                got = scores(net, [(t or "").encode() for t in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(got), pa.array((got >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.expr("coalesce(crc32(cast(doc_id as string)) % 3 = 1, false)").alias("held_out"), "text")
    return rows.transform(mapped, run, SCHEMA)
