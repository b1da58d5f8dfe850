"""What a viewer needs to draw a cloud: checked features and the limits of their colours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, NumericType, ShortType

#: Colour scales by kind of feature.
CATEGORIES, CONTINUOUS, PLAIN = "tab20", "viridis", "green"


def checked_view(points: DataFrame, feature: str | None, buffer_size: int = 500_000) -> str:
    """The colour scale of a feature: categories for whole numbers, a range for others, one colour without any."""
    if not {"x", "y", "z"} <= set(points.columns):
        raise ValueError("points need x, y and z")
    if buffer_size <= 0:
        raise ValueError("buffer_size must be positive")
    if feature is None:
        return PLAIN
    if feature not in points.columns or not isinstance(points.schema[feature].dataType, NumericType):
        raise ValueError(f"there is no numeric column {feature}")
    return CATEGORIES if isinstance(points.schema[feature].dataType, (ByteType, ShortType, IntegerType, LongType)) else CONTINUOUS


def colour_limits(points: DataFrame, feature: str, by: str | None = None, buffer_size: int = 500_000) -> DataFrame:
    """The number of points, the smallest and largest finite value of a feature, and the chunks a viewer draws, in all or by a column."""
    checked_view(points, feature, buffer_size)
    value = F.col(feature).cast("double")
    finite = F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")), value)
    return (points.groupBy(by) if by else points.groupBy()).agg(F.count("*").alias("n"), F.min(finite).alias("low"), F.max(finite).alias("high"), F.ceil(F.count("*") / buffer_size).cast("long").alias("chunks"))
