"""Scanner rays from flight metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.joins import shuffled
from ..plans.scratch import written

LEAST_ANGLE = 5.0
RAY = ("ray_x", "ray_y", "ray_z")
ANGLES = ("scan_angle_rank", "scan_angle", "scan_angle_deg")


def has_valid_angles(points: DataFrame, angle: str = "scan_angle_deg") -> bool:
    """Whether any angle is steeper than five degrees."""
    return bool(points.agg(F.max(F.abs(angle)) > LEAST_ANGLE).head()[0])


def flight_lines(points: DataFrame) -> DataFrame:
    """Per source: size, first and last time, number of bins of about a second, and whether an angle is valid."""
    lines = points.groupBy("point_source_id").agg(F.count("*").alias("n"), F.min("gps_time").alias("t_min"), F.max("gps_time").alias("t_max"), (F.max(F.abs("scan_angle_deg")) > LEAST_ANGLE).alias("valid"))
    span = F.col("t_max") - F.col("t_min")
    return lines.withColumn("bins", F.when(span < 1, F.lit(1).cast("long")).otherwise(F.floor(span).cast("long") + 1))


def binned(points: DataFrame) -> DataFrame:
    """Points with the bin of their flight line that holds their time: left-closed, the last one holds the end.

    Sources are 16-bit numbers, so the table of lines is small and is broadcast.
    """
    step = (F.col("t_max") - F.col("t_min")) / F.col("bins")
    raw = F.when(step > 0, F.floor((F.col("gps_time") - F.col("t_min")) / step)).otherwise(F.lit(0)).cast("long")
    edge = lambda k: F.col("t_min") + k * step
    fixed = F.when(F.col("gps_time") < edge(F.col("raw__")), F.col("raw__") - 1).when(F.col("gps_time") >= edge(F.col("raw__") + 1), F.col("raw__") + 1).otherwise(F.col("raw__"))
    joined = points.join(F.broadcast(flight_lines(points)), "point_source_id").withColumn("raw__", raw)
    return joined.withColumn("bin", F.greatest(F.lit(0).cast("long"), F.least(fixed, F.col("bins") - 1))).select(*points.columns, "bin")


def filled(heights: DataFrame, value: str = "height", key: str = "point_source_id", order: str = "bin") -> DataFrame:
    """Missing heights become the mean of the nearest known ones before and after, or the one there is.

    Both windows run over rows gone by, one of them from the end: a frame that
    starts anew after each row would take the square of a line's bins.
    """
    window = lambda *by: Window.partitionBy(key).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(value, ignorenulls=True).over(window(F.col(order).asc()))
    after = F.last(value, ignorenulls=True).over(window(F.col(order).desc()))
    both = heights.withColumns({"before__": before, "after__": after})
    mean: Column = (F.col("before__") + F.col("after__")) / 2
    return both.withColumn(value, F.coalesce(value, mean, "before__", "after__")).drop("before__", "after__")


def sensor_heights(points: DataFrame) -> DataFrame:
    """Per source and bin: the mean place of its points, and the sensor's height from the valid angles, gaps filled."""
    return _heights(binned(points))


def _heights(own: DataFrame) -> DataFrame:
    """The sensor's heights from points with their bins."""
    valid = F.abs("scan_angle_deg") > LEAST_ANGLE
    centres = own.groupBy("point_source_id", "bin").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.avg(F.when(valid, F.col("z"))).alias("mean_z"))
    away = F.sqrt(F.pow(F.col("cx") - F.col("x"), F.lit(2.0)) + F.pow(F.col("cy") - F.col("y"), F.lit(2.0)))
    rise = F.when(valid, away / F.tan(F.radians(F.abs("scan_angle_deg"))))
    medians = own.join(shuffled(centres), ["point_source_id", "bin"]).groupBy("point_source_id", "bin").agg(F.median(rise).alias("rise"))
    return filled(centres.join(shuffled(medians), ["point_source_id", "bin"]).select("point_source_id", "bin", "cx", "cy", (F.col("mean_z") + F.col("rise")).alias("height")))


def rays(points: DataFrame) -> DataFrame | None:
    """Points with ray_x, ray_y, ray_z (32-bit) from point to sensor.

    None if a metadata column is missing, the table is empty, or a flight line
    has no valid angle; one such line spoils the whole cloud.
    """
    if not {"gps_time", "point_source_id", "scan_angle_deg"} <= set(points.columns):
        return None
    bad = flight_lines(points).agg(F.count("*"), F.count_if(~F.col("valid"))).head()
    if not bad[0] or bad[1]:
        return None
    own = written(binned(points), "binned")
    heights = written(_heights(own), "heights")
    joined = own.join(shuffled(heights), ["point_source_id", "bin"])
    return joined.select(*points.columns, *((F.col(f"c{a}") - F.col(a)).cast("float").alias(f"ray_{a}") for a in "xy"), (F.col("height") - F.col("z")).cast("float").alias("ray_z"))


def checked(points: DataFrame) -> DataFrame:
    """The points, or ValueError if they have some of the three ray columns only, or a ray that is not finite."""
    missing = [c for c in RAY if c not in points.columns]
    if missing:
        raise ValueError(f"rays need the columns {', '.join(RAY)}; missing: {', '.join(missing)}")
    odd = [F.col(c).isNull() | F.isnan(F.col(c)) | (F.abs(F.col(c)) == float("inf")) for c in RAY]
    if not points.where(odd[0] | odd[1] | odd[2]).isEmpty():
        raise ValueError("a ray is not finite")
    return points


def ray_columns(points: DataFrame, angle: str | None = None) -> DataFrame:
    """Metadata by its usual names: ranks are degrees, other angles 0.006 of one; without it the table comes back as it is.

    ``angle`` names the angle column to use; without it, ranks come first.  Two
    columns of angles in degrees, a rank next to scan_angle_deg, are refused.
    """
    names = {c.lower(): c for c in points.columns}
    if not {"gps_time", "point_source_id"} <= set(names):
        return points
    if angle is None and {"scan_angle_rank", "scan_angle_deg"} <= set(names):
        raise ValueError("two columns of scan angles, scan_angle_rank and scan_angle_deg; name one")
    use = angle or next((a for a in ("scan_angle_deg", "scan_angle_rank", "scan_angle") if a in names), None)
    if use is None or use == "scan_angle_deg":
        return points
    if use not in names:
        raise ValueError(f"there is no column {use}")
    degrees = F.col(names[use]) * F.lit(0.006) if use == "scan_angle" else F.col(names[use]).cast("double")
    return points.withColumn("scan_angle_deg", degrees)
