"""A point cloud derived from the events table, and stand-ins for what a scan would bring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One clump of points for each user, on a grid of 4 m; coordinates are multiples of 1/16.
POINTS_SQL = """
SELECT CAST(event_id AS BIGINT) AS point_id,
  CAST((user_id % 16) * 4 + ((event_id * 37) % 17) * CAST(0.125 AS DOUBLE) AS DOUBLE) AS x,
  CAST(floor(user_id / 16) * 4 + ((event_id * 53) % 17) * CAST(0.125 AS DOUBLE) AS DOUBLE) AS y,
  CAST((user_id % 8) * CAST(0.125 AS DOUBLE) + CASE WHEN event_type = 'error' THEN CAST(0 AS DOUBLE)
       ELSE floor(value) * CAST(0.0625 AS DOUBLE) END AS DOUBLE) AS z,
  CAST(CASE WHEN event_type = 'error' THEN 1 WHEN event_type = 'signup' THEN 2 ELSE 7 END AS INT) AS classification,
  CAST(user_id AS INT) AS tree_seed,
  CAST(event_id * CAST(0.03125 AS DOUBLE) AS DOUBLE) AS gps_time,
  CAST(user_id % 4 AS INT) AS point_source_id,
  CAST(((event_id * 13) % 41) - 20 AS DOUBLE) AS scan_angle_deg
FROM {events}
"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived cloud."""
    return spark.sql(POINTS_SQL, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def of_class(spark: SparkSession, sf_dir: str, label: int) -> DataFrame:
    """Its points of one class: 1 ground, 7 trees."""
    return points(spark, sf_dir).where(F.col("classification") == label)


def cylinders(cloud: DataFrame) -> DataFrame:
    """One upright cylinder of 8 m for each seed."""
    seeds = cloud.select("tree_seed").distinct()
    foot = {"px": (F.col("tree_seed") % 16) * 4 + 1.0, "py": F.floor(F.col("tree_seed") / 16) * 4 + 1.0, "pz": (F.col("tree_seed") % 8) * 0.125}
    feet = seeds.select(F.col("tree_seed").alias("tree_no"), F.lit(1).alias("seg_no"), *(v.cast("double").alias(k) for k, v in foot.items()))
    return feet.withColumns({"x": F.col("px"), "y": F.col("py"), "z": F.col("pz") + 8.0, "radius": F.lit(0.5)})
