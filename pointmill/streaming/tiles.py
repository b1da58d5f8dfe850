"""Points that arrive as a stream, kept up to date per tile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tile_counts(stream: DataFrame, size: float = 50.0) -> DataFrame:
    """Points, lowest and highest z per square tile; works on a stream (update or complete mode) and on a table."""
    tile = [F.floor(F.col(a) / F.lit(float(size))).cast("long").alias(f"i{a}") for a in "xy"]
    return stream.groupBy(*tile).agg(F.count("*").alias("n"), F.min("z").alias("min_z"), F.max("z").alias("max_z"))


def time_counts(stream: DataFrame, window: str = "10 minutes", late: str = "30 minutes", time_col: str = "ts") -> DataFrame:
    """Points per window of event time, with late data up to a limit."""
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, window).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")
