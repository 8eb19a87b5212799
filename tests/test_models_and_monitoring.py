"""Neural embedders on a tiny model, stream progress, and small report parts that ran nowhere else."""

import struct

import numpy as np
import pytest

from frametide import monitoring
from frametide.operators import embedders, report


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number, value):
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _tensor_of(name, dims):
    shape = b"".join(_field(1, _field(1, d) if isinstance(d, int) else _field(2, d)) for d in dims)
    return _field(1, name) + _field(2, _field(1, _field(1, 1) + _field(2, shape)))


def _model(weights):
    """An ONNX file: the mean colour of each picture times a matrix."""
    dim = weights.shape[1]
    node = lambda kind, ins, out: _field(1, b"".join(_field(1, i) for i in ins) + _field(2, out) + _field(4, kind))
    held = _field(1, 3) + _field(1, dim) + _field(2, 1) + _field(8, "w") + _field(9, b"".join(struct.pack("<f", x) for x in weights.ravel()))
    graph = node("GlobalAveragePool", ["x"], "p") + node("Flatten", ["p"], "f") + node("MatMul", ["f", "w"], "y") + _field(2, "g") + _field(5, held)
    graph += _field(11, _tensor_of("x", ["n", 3, "h", "v"])) + _field(12, _tensor_of("y", ["n", dim]))
    return _field(1, 8) + _field(7, graph) + _field(8, _field(1, "") + _field(2, 13))


@pytest.mark.parametrize("name", ["clip-vit-b32", "clip-vit-l14", "sscd-disc-mixup", "dinov2-base"])
def test_networks_run_a_model(name, tmp_path, monkeypatch):
    dim, size = {"clip-vit-b32": (512, 224), "clip-vit-l14": (768, 224), "sscd-disc-mixup": (512, 288), "dinov2-base": (768, 224)}[name]
    weights = np.random.default_rng(1).normal(size=(3, dim)).astype(np.float32)
    (tmp_path / "m.onnx").write_bytes(_model(weights))
    monkeypatch.setenv("FRAMETIDE_MODEL_" + name.upper().replace("-", "_"), str(tmp_path / "m.onnx"))
    made = embedders.create(name)
    frames = [np.full((40, 64, 3), c, np.uint8) for c in ((10, 200, 90), (250, 3, 77))] + [np.random.default_rng(2).integers(0, 256, (90, 50, 3), np.uint8)]
    got = made.embed(frames)
    assert got.shape == (3, dim) == (3, made.dim) and np.allclose(np.linalg.norm(got, axis=1), 1, atol=1e-5)
    mean, deviation = (embedders.CLIP_MEAN, embedders.CLIP_DEVIATION) if name.startswith("clip") else (embedders.MEAN, embedders.DEVIATION)
    for row, frame in zip(got[:2], frames, strict=False):  # one colour: nothing depends on how it is resized
        want = ((frame[0, 0] / 255 - np.array(mean)) / np.array(deviation)) @ weights
        assert np.allclose(row, want / np.linalg.norm(want), atol=2e-4)  # sums of single precision
    assert made._fitted(frames[2]).shape == (size, size, 3)
    assert np.allclose(made.embed(frames[2:]), got[2:], atol=1e-6)


def test_progress_counts_streams(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    seen = monitoring.Progress()
    spark.streams.addListener(seen)
    try:
        read = lambda: spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
        read().writeStream.format("noop").option("checkpointLocation", str(tmp_path / "a")).trigger(availableNow=True).start().awaitTermination(60)
        bad = read().selectExpr("raise_error('broken')").writeStream.format("noop").option("checkpointLocation", str(tmp_path / "b")).trigger(availableNow=True).start()
        with pytest.raises(Exception, match="broken"):
            bad.awaitTermination(60)
        for _ in range(100):
            if seen.rows >= 5 and seen.failures:
                break
            import time

            time.sleep(0.1)
        assert seen.rows >= 5 and seen.batches >= 1 and seen.failures == 1
    finally:
        spark.streams.removeListener(seen)


def test_base_index(spark):
    rows = spark.createDataFrame([(x,) for x in ["b", "a", "b", "c", "a"]], "base_id string")
    made = report.base_index(rows)
    assert sorted(tuple(r) for r in made.collect()) == [("a", 0), ("b", 1), ("c", 2)]
    assert "SinglePartition" not in made._jdf.queryExecution().executedPlan().toString()
