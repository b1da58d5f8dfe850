"""Tiles with a halo, and gathering points by boxes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grid import checked_size
from ..plans.joins import shuffled


def tile_table(points: DataFrame, size: float = 50.0, overlap: float = 3.0) -> DataFrame:
    """Tiles from the smallest x and y on, x first: core box, and box with the overlap around it."""
    size = checked_size(size)
    spark = points.sparkSession
    low = points.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).head()
    schema = "ix int, iy int, cx_min double, cy_min double, cx_max double, cy_max double, x_min double, y_min double, x_max double, y_max double"
    if low[0] is None:
        return spark.createDataFrame([], schema)
    x0, y0, x1, y1 = map(float, low)
    nx, ny = math.ceil((x1 - x0) / size), math.ceil((y1 - y0) / size)
    tiles = spark.range(nx * ny).select((F.col("id") / ny).cast("int").alias("ix"), (F.col("id") % max(ny, 1)).cast("int").alias("iy"))
    tiles = tiles.select("ix", "iy", (F.lit(x0) + F.col("ix") * size).alias("cx_min"), (F.lit(y0) + F.col("iy") * size).alias("cy_min"))
    tiles = tiles.withColumns({"cx_max": F.col("cx_min") + size, "cy_max": F.col("cy_min") + size})
    return tiles.withColumns({f"{a}_{e}": F.col(f"c{a}_{e}") + (overlap if e == "max" else -overlap) for e in ("min", "max") for a in "xy"})


def core_mask(tile: dict[str, float]) -> Column:
    """Whether a point is in the half-open core of a tile."""
    return (F.col("x") >= tile["cx_min"]) & (F.col("x") < tile["cx_max"]) & (F.col("y") >= tile["cy_min"]) & (F.col("y") < tile["cy_max"])


def tile_mask(tile: dict[str, float]) -> Column:
    """Whether a point is in the half-open box of a tile with its overlap."""
    return (F.col("x") >= tile["x_min"]) & (F.col("x") < tile["x_max"]) & (F.col("y") >= tile["y_min"]) & (F.col("y") < tile["y_max"])


def tiled(points: DataFrame, size: float = 50.0, overlap: float = 3.0) -> DataFrame:
    """Every point once for each tile whose box with overlap holds it: ix, iy, and ``core``."""
    size = checked_size(size)
    low = points.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).head()
    if low[0] is None:
        return points.withColumns({"ix": F.lit(0), "iy": F.lit(0), "core": F.lit(True)})
    out = points
    for i, a in enumerate("xy"):
        n = math.ceil((low[i + 2] - low[i]) / size)
        place = lambda shift, a=a, i=i: F.floor((F.col(a) + F.lit(float(shift)) - F.lit(float(low[i]))) / F.lit(size)).cast("int")
        out = out.withColumn(f"c{a}", place(0)).withColumn(f"i{a}", F.explode(F.sequence(place(-overlap), place(overlap)))).where((F.col(f"i{a}") >= 0) & (F.col(f"i{a}") < n))
    return out.withColumn("core", (F.col("cx") == F.col("ix")) & (F.col("cy") == F.col("iy"))).drop("cx", "cy")


def group_boxes(points: DataFrame, group: str) -> DataFrame:
    """The closed box of each group's points."""
    return points.groupBy(group).agg(*(f(a).alias(f"{a}_{n}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))))


def gathered(points: DataFrame, boxes: DataFrame, group: str, cell_size: float = 8.0) -> DataFrame:
    """All points in each group's closed box; boxes meet points through the cells that they cover."""
    span = lambda a: F.sequence(F.floor(F.col(f"{a}_min") / cell_size).cast("long"), F.floor(F.col(f"{a}_max") / cell_size).cast("long"))
    covering = boxes.withColumn("cell_x", F.explode(span("x"))).withColumn("cell_y", F.explode(span("y")))
    keyed = points.withColumns({f"cell_{a}": F.floor(F.col(a) / cell_size).cast("long") for a in "xy"})
    if group in keyed.columns:
        keyed = keyed.drop(group)
    inside = [F.col(a).between(F.col(f"{a}_min"), F.col(f"{a}_max")) for a in "xyz"]
    return keyed.join(shuffled(covering), ["cell_x", "cell_y"]).where(inside[0] & inside[1] & inside[2]).select(group, *[c for c in points.columns if c != group])
