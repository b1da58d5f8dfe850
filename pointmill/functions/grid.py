"""Cell keys and neighbourhoods on regular grids."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def cell(value: str | Column, size: float) -> Column:
    """The cell of a coordinate, divided in 32-bit floats as the data are held."""
    value = F.col(value) if isinstance(value, str) else value
    return F.floor((value.cast("float") / F.lit(size).cast("float")).cast("float")).cast("long")


def cell_double(value: str | Column, size: float) -> Column:
    """The cell of a coordinate, divided in 64 bits."""
    value = F.col(value) if isinstance(value, str) else value
    return F.floor(value / F.lit(float(size))).cast("long")


def half_offsets(dims: int) -> list[tuple[int, ...]]:
    """One of each pair of opposite steps to a neighbouring cell."""
    return [step for step in product((-1, 0, 1), repeat=dims) if step > (0,) * dims]


def spread(df: DataFrame, keys: tuple[str, ...], reach: int = 1) -> DataFrame:
    """Every row once for each cell within ``reach`` cells of its own."""
    around = F.sequence(F.lit(-reach).cast("long"), F.lit(reach).cast("long"))
    for key in keys:
        df = df.withColumn("step__", F.explode(around)).withColumn(key, F.col(key) + F.col("step__")).drop("step__")
    return df


def checked_size(size: float, name: str = "size") -> float:
    """A positive cell size, or ValueError."""
    if not size > 0:
        raise ValueError(f"{name} must be positive")
    return float(size)
