"""Frame embedders and pixel kernels in numpy, behind Arrow.

An embedder is a class with name, dim and embed(frames) -> (n, dim) unit rows;
register adds more. Neural ones run ONNX files, which are the user's to bring.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_REGISTRY: dict[str, Callable[[], object]] = {}


def register(name: str):
    def put(make):
        _REGISTRY[name] = make
        return make

    return put


def create(name: str):
    if name not in _REGISTRY:
        raise ValueError(f"unknown embedder {name}; known: {', '.join(sorted(_REGISTRY))}")
    return _REGISTRY[name]()


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def gray(rgb: np.ndarray) -> np.ndarray:
    return rgb.astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def _shares(n: int, m: int) -> np.ndarray:
    """(m, n): how much of each of n source cells is in each of m equal parts."""
    edge = np.arange(m + 1) * (n / m)
    lo, hi = np.maximum(edge[:-1, None], np.arange(n)), np.minimum(edge[1:, None], np.arange(1, n + 1))
    return np.maximum(hi - lo, 0) / (n / m)


def resize_area(image: np.ndarray, h: int, w: int) -> np.ndarray:
    """Each pixel is the mean of the area that it covers."""
    rows, cols = _shares(image.shape[0], h), _shares(image.shape[1], w)
    by_rows = np.tensordot(rows, image.astype(np.float64), (1, 0))
    return np.moveaxis(np.tensordot(by_rows, cols, (1, 1)), -1, 1)


def shrink(image: np.ndarray, short_side: int) -> np.ndarray:
    """Short side to short_side; never larger."""
    scale = short_side / min(image.shape[:2])
    if scale >= 1:
        return image
    return np.rint(resize_area(image, max(1, round(image.shape[0] * scale)), max(1, round(image.shape[1] * scale)))).astype(np.uint8)


@register("tiny16")
class Tiny:
    """A centred 16 x 16 grey thumbnail."""

    name, dim = "tiny16", 256

    def embed(self, frames: list[np.ndarray]) -> np.ndarray:
        flat = np.stack([resize_area(gray(f), 16, 16).ravel() for f in frames]) if frames else np.zeros((0, 256))
        return unit_rows(flat - flat.mean(1, keepdims=True) if len(flat) else flat)


def _dct(n: int) -> np.ndarray:
    k, i = np.arange(n)[:, None], np.arange(n)[None]
    m = np.sqrt(2 / n) * np.cos(np.pi * (2 * i + 1) * k / (2 * n))
    m[0] /= np.sqrt(2)
    return m


@register("phash64")
class PerceptualHash:
    """Signs of the 8 x 8 low frequencies of a 32 x 32 thumbnail against their median without the constant; dot = 1 - 2 * hamming / 64."""

    name, dim = "phash64", 64

    def embed(self, frames: list[np.ndarray]) -> np.ndarray:
        m = _dct(32)
        out = np.zeros((len(frames), 64), np.float32)
        for n, f in enumerate(frames):
            low = (m @ resize_area(gray(f), 32, 32) @ m.T)[:8, :8].ravel()
            out[n] = np.where(low > np.median(low[1:]), 0.125, -0.125)
        return out


def embed_frames(frames: DataFrame, embedders: list[str], short_side: int = 288) -> DataFrame:
    """(video_id, t, embedder, vector) of frames(video_id, t, h, w, rgb): each frame is read once for all embedders.

    A frame whose bytes aren't h * w * 3 is an error of the input and gives no row.
    """
    rows = frames.select("video_id", "t", "h", "w", "rgb", F.lit(None).cast("string").alias("error"))
    return embed_or_tell(rows, embedders, short_side).drop("error")


def embed_or_tell(frames: DataFrame, embedders: list[str], short_side: int = 288) -> DataFrame:
    """As embed_frames, of frames that have errors too: those rows pass, with the error and without a vector, so that one pass gives both."""
    for name in embedders:
        create(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [create(name) for name in embedders]
        names, kinds = ["video_id", "t", "embedder", "vector", "error"], (pa.string(), pa.float64(), pa.string(), pa.list_(pa.float32()), pa.string())

        def told(*columns: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for whole in batches:
            for lo in range(0, whole.num_rows, 32):
                all_rows = whole.slice(lo, 32).to_pylist()
                lost = [r for r in all_rows if r["error"] is not None]
                if lost:
                    none = [None] * len(lost)
                    yield told([r["video_id"] for r in lost], none, none, none, [r["error"] for r in lost])
                rows = [r for r in all_rows if r["error"] is None and r["rgb"] is not None and len(r["rgb"]) == r["h"] * r["w"] * 3]
                images = [shrink(np.frombuffer(r["rgb"], np.uint8).reshape(r["h"], r["w"], 3), short_side) for r in rows]
                for e in made if rows else []:
                    yield told([r["video_id"] for r in rows], [r["t"] for r in rows], [e.name] * len(rows), e.embed(images).tolist(), [None] * len(rows))

    return frames.select("video_id", "t", "h", "w", "rgb", "error").mapInArrow(run, "video_id string, t double, embedder string, vector array<float>, error string")


def capped_height(image: np.ndarray, most: int = 720) -> np.ndarray:
    """At most so many rows; even sides, as codecs want them."""
    h, w = image.shape[:2]
    if h <= most:
        return image
    return np.rint(resize_area(image, most, max(2, round(w * most / h / 2) * 2))).astype(np.uint8)


def paint_overlay(image: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A caption bar with letters' blocks below, and a badge in a corner."""
    out = image.copy()
    h, w = image.shape[:2]
    bar = max(1, h // 8)
    out[-bar:] = out[-bar:] // 3
    for x in range(w // 20, w - w // 20, max(2, w // 24)):
        out[-bar + bar // 4 : h - bar // 4, x : x + max(1, w // 48)] = 235 if rng.random() < 0.8 else 0
    side = max(1, min(h, w) // 7)
    x = 0 if rng.random() < 0.5 else w - side
    out[:side, x : x + side] = rng.integers(0, 256, 3)
    return out


def shift_colors(image: np.ndarray, light: float, contrast: float, saturation: float, hue: float) -> np.ndarray:
    """Brightness and contrast about the middle grey; saturation and hue (radians) turn the colour difference planes."""
    x = (image.astype(np.float64) - 127.5) * contrast + 127.5 + 255 * light
    y = x @ np.array([0.299, 0.587, 0.114])
    u, v = (x[..., 2] - y) * 0.492, (x[..., 0] - y) * 0.877
    u, v = saturation * (u * np.cos(hue) - v * np.sin(hue)), saturation * (u * np.sin(hue) + v * np.cos(hue))
    r, b = y + v / 0.877, y + u / 0.492
    g = (y - 0.299 * r - 0.114 * b) / 0.587
    return np.clip(np.rint(np.stack([r, g, b], -1)), 0, 255).astype(np.uint8)


# The usual colour difference planes of pictures, as rows over red, green, blue.
TO_PLANES = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])


def compress_blocks(image: np.ndarray, strength: float) -> np.ndarray:
    """What a block codec leaves of a picture: the cosine coefficients of 8 x 8 blocks of each plane, rounded to steps.

    A step grows with strength and with the frequency, (1 + u + v) / 4, and is twice
    as large for the colour planes; the steps of a constant block are those of its mean.
    """
    h, w = image.shape[:2]
    planes = np.pad(image.astype(float), ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge") @ TO_PLANES.T
    high, wide = planes.shape[0] // 8, planes.shape[1] // 8
    blocks = planes.reshape(high, 8, wide, 8, 3)
    m = _dct(8)
    freq = np.einsum("ua,iajbc,vb->iujvc", m, blocks, m, optimize=True)
    u = np.arange(8)
    step = np.maximum(1.0, strength * (1 + u[:, None] + u[None, :]) / 4)[None, :, None, :, None] * np.array([1.0, 2.0, 2.0])
    kept = np.einsum("ua,iujvc,vb->iajbc", m, np.rint(freq / step) * step, m, optimize=True)
    out = kept.reshape(high * 8, wide * 8, 3) @ np.linalg.inv(TO_PLANES).T
    return np.clip(np.rint(out[:h, :w]), 0, 255).astype(np.uint8)


def tilt(image: np.ndarray, angle: float) -> np.ndarray:
    """The picture turned about its middle, bilinear, each pixel looked up where it came from; outside of the picture is black."""
    h, w = image.shape[:2]
    y, x = np.mgrid[0:h, 0:w].astype(float)
    cy, cx, c, s = (h - 1) / 2, (w - 1) / 2, np.cos(angle), np.sin(angle)
    sx, sy = c * (x - cx) + s * (y - cy) + cx, -s * (x - cx) + c * (y - cy) + cy
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    out = np.zeros(image.shape)
    for dy in (0, 1):
        for dx in (0, 1):
            px, py = x0 + dx, y0 + dy
            inside = (px >= 0) & (px < w) & (py >= 0) & (py < h)
            weight = np.where(inside, (1 - np.abs(sx - px)) * (1 - np.abs(sy - py)), 0.0)
            out += weight[..., None] * image[np.clip(py, 0, h - 1), np.clip(px, 0, w - 1)]
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def distort(image: np.ndarray, kind: str, rng: np.random.Generator) -> np.ndarray:
    """Pixel forms of the ten kinds; compression is an approximation by quantising, screen recording a chain of scale, tilt, blur, noise, fading and block compression.

    speed changes times only. Draws are the same for all frames of a clip where the generator is seeded alike.
    """
    h, w = image.shape[:2]
    if kind in ("original", "speed"):
        return image
    if kind == "mirror":
        return image[:, ::-1]
    if kind == "compression":
        return (image // 24 * 24 + 12).astype(np.uint8)
    if kind == "downscale":
        return shrink(image, min(240, h, w))
    if kind == "crop":
        keep, (y, x) = rng.uniform(0.6, 0.8), rng.random(2)
        ch, cw = max(1, int(h * keep)), max(1, int(w * keep))
        top, left = int(y * (h - ch)), int(x * (w - cw))
        return image[top : top + ch, left : left + cw]
    if kind == "letterbox":  # a square with the picture, unchanged, in its middle
        side = max(h, w)
        out = np.zeros((side, side, 3), np.uint8)
        top, left = (side - h) // 2, (side - w) // 2
        out[top : top + h, left : left + w] = image
        return out
    if kind == "color":
        sign = rng.choice([-1, 1], 2)
        return shift_colors(image, sign[0] * rng.uniform(0.04, 0.10), rng.uniform(1.15, 1.4), rng.uniform(1.3, 1.7), sign[1] * np.radians(rng.uniform(15, 35)))
    if kind == "overlay":
        return paint_overlay(image, rng)
    if kind == "screen_recording":
        small = np.clip(np.rint(resize_area(image, max(1, int(h * 0.88)), max(1, int(w * 0.88)))), 0, 255).astype(np.uint8)
        turned = tilt(small, rng.choice([-1, 1]) * rng.uniform(0.015, 0.04)).astype(float)
        blurred = (turned + np.roll(turned, 1, 0) + np.roll(turned, 1, 1) + np.roll(turned, (1, 1), (0, 1))) / 4
        noisy = blurred + rng.normal(0, 10, turned.shape)
        faded = shift_colors(np.clip(noisy, 0, 255).astype(np.uint8), 0.0, 1.0, 0.85, 0.0)
        return compress_blocks((255 * (faded / 255) ** (1 / 1.15)).astype(np.uint8), 12.0)
    raise ValueError(f"unknown distortion {kind}")


def distort_frames(frames: DataFrame, kinds: list[str], seed: int = 0) -> DataFrame:
    """(video_id, t, distortion, h, w, rgb): each of frames(video_id, t, h, w, rgb) in each kind, with the same draws for all frames of a video."""
    import zlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 32):
                out = []
                for r in whole.slice(lo, 32).to_pylist():
                    if r["rgb"] is None or len(r["rgb"]) != r["h"] * r["w"] * 3:
                        continue
                    image = np.frombuffer(r["rgb"], np.uint8).reshape(r["h"], r["w"], 3)
                    for kind in kinds:
                        made = np.ascontiguousarray(distort(image, kind, np.random.default_rng([seed, zlib.crc32(f"{r['video_id']}/{kind}".encode())])))
                        out.append((r["video_id"], r["t"], kind, made.shape[0], made.shape[1], made.tobytes()))
                if out:
                    a, b, c, d, e, f = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.float64()), pa.array(c, pa.string()), pa.array(d, pa.int32()), pa.array(e, pa.int32()), pa.array(f, pa.binary())], names=["video_id", "t", "distortion", "h", "w", "rgb"])

    return frames.select("video_id", "t", "h", "w", "rgb").mapInArrow(run, "video_id string, t double, distortion string, h int, w int, rgb binary")


# Mean and deviation of the pictures that the usual image networks were trained on.
MEAN, DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
CLIP_MEAN, CLIP_DEVIATION = (0.48145466, 0.4578275, 0.40821073), (0.26862954, 0.26130258, 0.27577711)


def standardized(images: np.ndarray, mean: tuple = MEAN, deviation: tuple = DEVIATION) -> np.ndarray:
    """(n, 3, h, w) single precision of (n, h, w, 3) bytes."""
    x = (images.astype(np.float32) / 255 - np.array(mean, np.float32)) / np.array(deviation, np.float32)
    return np.ascontiguousarray(x.transpose(0, 3, 1, 2))


def by_shape(frames: list[np.ndarray], batch_size: int, run: Callable[[np.ndarray], np.ndarray], dim: int) -> np.ndarray:
    """run over batches of frames of one shape each; rows come back in the order of frames."""
    out = np.zeros((len(frames), dim), np.float32)
    places: dict[tuple, list[int]] = {}
    for i, f in enumerate(frames):
        places.setdefault(f.shape, []).append(i)
    for same in places.values():
        for lo in range(0, len(same), batch_size):
            part = same[lo : lo + batch_size]
            out[part] = run(np.stack([frames[i] for i in part]))
    return out


class Network:
    """A neural embedder from an ONNX file, whose path and sha256 are settings: FRAMETIDE_MODEL_<NAME> and _SHA256."""

    def __init__(self, name: str, dim: int, size: int, *, crop: bool = True, mean: tuple = MEAN, deviation: tuple = DEVIATION, batch_size: int = 32):
        import os

        self.name, self.dim, self.size, self.crop, self.mean, self.deviation, self.batch_size = name, dim, size, crop, mean, deviation, batch_size
        key = "FRAMETIDE_MODEL_" + name.upper().replace("-", "_")
        if key not in os.environ:
            raise ValueError(f"{name} needs a model: set {key} to the path of its ONNX file")
        path = weights(os.environ[key], os.environ.get(f"{key}_SHA256"))
        import onnxruntime

        self._session = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])

    def embed(self, frames: list[np.ndarray]) -> np.ndarray:
        return by_shape([self._fitted(f) for f in frames], self.batch_size, self._run, self.dim)

    def _fitted(self, f: np.ndarray) -> np.ndarray:
        h, w = f.shape[:2]
        if self.crop:  # short side to size, then the middle
            scale = self.size / min(h, w)
            f = resize_area(f, max(self.size, round(h * scale)), max(self.size, round(w * scale)))
            top, left = (f.shape[0] - self.size) // 2, (f.shape[1] - self.size) // 2
            f = f[top : top + self.size, left : left + self.size]
        else:
            f = resize_area(f, self.size, self.size)
        return np.clip(np.rint(f), 0, 255).astype(np.uint8)

    def _run(self, images: np.ndarray) -> np.ndarray:
        (name,) = (x.name for x in self._session.get_inputs())
        return unit_rows(self._session.run(None, {name: standardized(images, self.mean, self.deviation)})[0])


def weights(path: str, sha256: str | None) -> str:
    """path, if the file there has the given digest."""
    if sha256 is not None:
        digest = hashlib.sha256()
        with open(path, "rb") as file:
            while part := file.read(1 << 20):
                digest.update(part)
        if digest.hexdigest() != sha256.lower():
            raise ValueError(f"{path} isn't the model that was asked for: its sha256 is {digest.hexdigest()}")
    return path


register("clip-vit-b32")(lambda: Network("clip-vit-b32", 512, 224, mean=CLIP_MEAN, deviation=CLIP_DEVIATION))
register("clip-vit-l14")(lambda: Network("clip-vit-l14", 768, 224, mean=CLIP_MEAN, deviation=CLIP_DEVIATION))
register("sscd-disc-mixup")(lambda: Network("sscd-disc-mixup", 512, 288, crop=False))
register("dinov2-base")(lambda: Network("dinov2-base", 768, 224, crop=False))
