"""Filling of vertical gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranking import order_statistic


def vertical_gaps(points: DataFrame, xy_voxel_size: float = 0.25) -> DataFrame:
    """Each point with the next one above it in its column, and the gap between."""
    column = [F.floor(F.col(a).cast("double") * F.lit(1.0 / xy_voxel_size)).cast("long") for a in "xy"]
    keyed = points.select("point_id", "x", "y", "z", column[0].alias("col_x"), column[1].alias("col_y"))
    above = F.lead(F.struct("x", "y", "z")).over(Window.partitionBy("col_x", "col_y").orderBy("z", "point_id"))
    return keyed.withColumn("above", above).where(F.col("above").isNotNull()).withColumn("gap", (F.col("above.z") - F.col("z")).cast("double"))


def dense_gap(gaps: DataFrame, percentile: float = 25.0) -> float | None:
    """The order statistic at int(n * p / 100), without interpolation; None without gaps."""
    n = gaps.count()
    if not n:
        return None
    at = min(max(int(n * percentile / 100), 0), n - 1)
    return order_statistic(gaps, "gap", at)


def densified(points: DataFrame, xy_voxel_size: float = 0.25, max_vertical_gap: float = 0.6, density_factor: float = 6.0, density_percentile: float = 25.0, vertical_spacing: float | None = None) -> DataFrame:
    """The points (``original`` true) and new ones that fill gaps of density_factor times the dense gap up to the largest.

    New points lie evenly on the line between both ends, no farther apart than
    the spacing (by default the dense gap); they carry the lower end's id.
    """
    if xy_voxel_size <= 0 or max_vertical_gap <= 0 or density_factor <= 1:
        raise ValueError("sizes must be positive, and density_factor above 1")
    own = points.select("point_id", "x", "y", "z", F.lit(True).alias("original"))
    gaps = vertical_gaps(points, xy_voxel_size)
    dense = dense_gap(gaps, density_percentile)
    if dense is None or dense <= 0:
        return own
    spacing = dense if vertical_spacing is None else vertical_spacing
    if spacing <= 0:
        raise ValueError("vertical_spacing must be positive")
    wide = gaps.where(F.col("gap").between(F.lit(density_factor * dense), F.lit(float(max_vertical_gap))))
    wide = wide.withColumn("n", F.ceil(F.col("gap") / F.lit(float(spacing))).cast("int") - 1).where(F.col("n") > 0)
    new = wide.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    at = F.col("i") / (F.col("n") + 1)
    made = new.select("point_id", *((F.col(a) + (F.col(f"above.{a}") - F.col(a)) * at).cast(points.schema[a].dataType).alias(a) for a in "xyz"), F.lit(False).alias("original"))
    return own.unionByName(made)
