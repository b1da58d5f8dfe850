"""Schemas, sentinels and the segmentation settings."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, fields
from typing import Any

from pyspark.sql import types as T

UNASSIGNED, SHRUB = -1, 17
WOOD, LEAF = 0, 1

POINT = T.StructType(
    [
        T.StructField("point_id", T.LongType(), False),
        T.StructField("x", T.DoubleType(), False),
        T.StructField("y", T.DoubleType(), False),
        T.StructField("z", T.DoubleType(), False),
        T.StructField("classification", T.IntegerType(), True),
    ]
)
SEGMENT = "tree_no int, seg_no int, x double, y double, z double, radius double, parent_id int, section_id int"


@dataclass(frozen=True)
class Config:
    """Settings of the segmentation; unknown keys are refused by the constructor."""

    height_min: float = 2.0
    max_diameter: float = 0.9
    crop_length: float = 1.0
    distance_limit: float = 0.3
    girth_height_ratio: float = 0.12
    gravity_factor: float = 0.75
    global_taper: float | None = None
    global_taper_factor: float | None = None
    grid_width: float | None = None
    use_rays: bool = False
    ground_label: int | None = None
    tree_label: int | None = None
    wood_distance: float = 0.02
    wood_propagation_height: float = 1.35
    wood_propagation_radius: float = 0.3
    wood_propagation_vertical_radius: float = 0.6
    wood_propagation_min_points: int = 3
    verbose: bool = False

    def __post_init__(self) -> None:
        for name in ("wood_distance", "wood_propagation_height"):
            if not _real(value := getattr(self, name)) or value < 0:
                raise ValueError(f"{name} must be finite and not negative")
        for name in ("wood_propagation_radius", "wood_propagation_vertical_radius"):
            if not _real(value := getattr(self, name)) or value <= 0:
                raise ValueError(f"{name} must be finite and positive")
        n = self.wood_propagation_min_points
        if isinstance(n, bool) or not isinstance(n, int) or n < 1:
            raise ValueError("wood_propagation_min_points must be an integer of at least 1")

    @classmethod
    def load(cls, cfg: dict[str, Any] | None = None, cfg_path: str | None = None, verbose: bool = False) -> Config:
        """Settings from a dict, else from a JSON file; one of the two is needed."""
        if cfg is None and cfg_path is None:
            raise ValueError("give cfg or cfg_path")
        if cfg is None:
            with open(cfg_path, encoding="utf-8") as source:
                cfg = json.load(source)
        unknown = set(cfg) - {f.name for f in fields(cls)}
        if unknown:
            raise TypeError(f"unknown settings: {sorted(unknown)}")
        return cls(**{**cfg, "verbose": verbose})

    def dumped(self) -> dict[str, Any]:
        """The settings as a dict."""
        return asdict(self)


def _real(value: Any) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value)
