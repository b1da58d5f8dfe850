"""Thinning, ground estimation and subsampling: one point per cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grid import AXES, cell, checked_size
from ..plans.joins import shuffled


def _first(points: DataFrame, keys: list[str], order) -> DataFrame:
    """Of each group of keys the row that comes first."""
    own = [c for c in points.columns if c not in keys]
    return points.groupBy(*keys).agg(F.min_by(F.struct(*own), order).alias("row")).select("row.*")


def thinned(points: DataFrame, size: float = 1.0) -> DataFrame:
    """The first point (by id) of each cubic cell."""
    keyed = points.withColumns({f"cell_{a}": cell(a, checked_size(size)) for a in AXES})
    return _first(keyed, [f"cell_{a}" for a in AXES], F.col("point_id"))


def estimated(points: DataFrame, grid_size: float = 2.0) -> DataFrame:
    """The lowest point of each square column, columns counted from the smallest x and y.

    Columns are half-open, and as many as steps of the size from the smallest up to
    the largest plus one size: points at the very end of an exact multiple drop out.
    """
    size = checked_size(grid_size, "grid_size")
    low = points.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).head()
    if low[0] is None:
        return points.limit(0)
    cells = [F.floor((F.col(a) - F.lit(float(low[i]))) / F.lit(size)).cast("long") for i, a in enumerate("xy")]
    counts = [F.lit(int(-(-((low[i + 2] + size) - low[i]) // size)) - 1) for i in range(2)]
    keyed = points.withColumns({"cell_x": cells[0], "cell_y": cells[1]}).where((F.col("cell_x") < counts[0]) & (F.col("cell_y") < counts[1]))
    return _first(keyed, ["cell_x", "cell_y"], F.struct("z", "point_id"))


def subsampled(points: DataFrame, size: float = 0.25) -> DataFrame:
    """All points with ``kept``: whether the point is the nearest to its cell's centre (ties: smallest id)."""
    checked_size(size)
    keyed = points.withColumns({f"cell_{a}": cell(a, size) for a in AXES})
    far = sum((F.pow(F.col(a) - (F.col(f"cell_{a}") + 0.5) * F.lit(float(size)), F.lit(2.0)) for a in AXES), F.lit(0.0))
    best = keyed.groupBy(*(f"cell_{a}" for a in AXES)).agg(F.min_by("point_id", F.struct(far, F.col("point_id"))).alias("point_id")).select("point_id", F.lit(True).alias("kept"))
    return points.join(shuffled(best), "point_id", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
