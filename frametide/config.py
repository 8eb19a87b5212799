"""Settings with bounds, from the environment (prefix FRAMETIDE_) or keywords."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

# Fixed values: (least, most) of each numeric setting; a least written as a string is exclusive.
BOUNDS = {
    "batch_size": (1, 512), "index_fps": ("0", 30), "query_fps": ("0", 30), "query_max_frames": (1, 1000), "frame_short_side": (32, 2160), "top_k": (1, 200), "v1_min_conf": (0, 1), "v1_min_vote_ratio": (0, 1),
    "v2_min_score": (0, 1), "v2_max_ratio": (0, 1), "v2_tolerance_s": ("0", 5), "max_upload_mb": ("0", None), "max_clip_seconds": ("0", None),
}


@dataclass(frozen=True)
class Settings:
    embedder: str = "tiny16"
    batch_size: int = 32
    index_fps: float = 2.0
    query_fps: float = 3.0
    query_max_frames: int = 40
    frame_short_side: int = 288
    top_k: int = 10
    algorithm: str = "v2"
    v1_min_conf: float = 0.83
    v1_min_vote_ratio: float = 0.90
    v2_min_score: float = 0.785
    v2_max_ratio: float = 0.8
    v2_tolerance_s: float = 0.6
    max_upload_mb: float = 50
    max_clip_seconds: float = 60

    def __post_init__(self):
        if self.algorithm not in ("v1", "v2"):
            raise ValueError(f"algorithm: {self.algorithm}")
        for name, (least, most) in BOUNDS.items():
            x = getattr(self, name)
            if x < float(least) or isinstance(least, str) and x <= float(least) or most is not None and x > most:
                raise ValueError(f"{name}: {x}")

    @classmethod
    def from_env(cls, **given) -> Settings:
        found = {f.name: type(f.default)(os.environ[k]) for f in fields(cls) if (k := f"FRAMETIDE_{f.name.upper()}") in os.environ}
        return cls(**found | given)
