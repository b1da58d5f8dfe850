"""Connected components on sparse grids, and operations on the clusters they give."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grid import cell, cell_double, checked_size, half_offsets, spread
from ..functions.ranking import dense_index
from ..plans.joins import shuffled
from ..plans.scratch import written
from ..schema import UNASSIGNED
from . import labels, nearest
from .components import connected


def grid_components(points: DataFrame, size: float, axes: str = "xy", name: str = "cluster") -> DataFrame:
    """Points with the component of their occupied cell; cells touch by side, edge or corner.

    Components run over distinct cells, not points, and are numbered by their
    first cell in raster order.
    """
    size = checked_size(size, "voxel_size")
    keys = [f"cell_{a}" for a in axes]
    keyed = points.withColumns({k: cell(a, size) for k, a in zip(keys, axes)})
    bounds = keyed.agg(*(F.min(k) for k in keys), *(F.max(k) for k in keys)).head()
    if bounds[0] is None:
        return points.withColumn(name, F.lit(0)).limit(0)
    low, spans = bounds[: len(axes)], [b - a + 1 for a, b in zip(bounds[: len(axes)], bounds[len(axes) :])]
    place = F.lit(0).cast("long")
    for k, base, span in zip(keys, low, spans):
        place = place * F.lit(span) + (F.col(k) - F.lit(base))
    cells = written(keyed.select(*keys).distinct().withColumn("place", place), "cells")
    steps = F.explode(F.array(*(F.struct(*(F.lit(d).cast("long").alias(f"d{i}") for i, d in enumerate(step))) for step in half_offsets(len(axes)))))
    moved = cells.withColumn("step", steps).select(F.col("place").alias("src"), *((F.col(k) + F.col(f"step.d{i}")).alias(k) for i, k in enumerate(keys)))
    edges = moved.join(shuffled(cells.withColumnRenamed("place", "dst")), keys).select("src", "dst")
    found = cells.join(shuffled(connected(edges)), F.col("place") == F.col("id"), "left").select(*keys, F.coalesce("component", "place").alias("component"))
    index = dense_index(found, "component", name)
    numbered = found.join(shuffled(index), "component").select(*keys, F.col(name).cast("int").alias(name))
    return keyed.join(shuffled(numbered), keys).select(*points.columns, name)


def bounds_of(points: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Per cluster: size, lowest z and the box in x and y."""
    return points.groupBy(cluster).agg(F.count("*").alias("n"), F.min("z").alias("min_z"), F.min("x").alias("x_min"), F.min("y").alias("y_min"), F.max("x").alias("x_max"), F.max("y").alias("y_max"))


def ground_gaps(points: DataFrame, ground: DataFrame | None, voxel_size: float = 0.5, max_gap: float = 0.4, boundary_margin: float = 0.5, nearest_ground_points: int = 10) -> tuple[DataFrame, DataFrame]:
    """Points with their 3-D component, and per component its ground level, gap and whether the gap is accepted.

    Ground level is the mean z of ground points in the component's box with its
    margin (closed), else of the nearest ones to the box's centre; without any
    ground the lowest component stands for it.
    """
    if boundary_margin < 0 or nearest_ground_points < 1:
        raise ValueError("boundary_margin must not be negative, nearest_ground_points at least 1")
    member = written(grid_components(points, voxel_size, "xyz"), "members")
    boxes = bounds_of(member)
    if ground is None or ground.isEmpty():
        least = boxes.agg(F.min("min_z")).head()[0]
        report = boxes.withColumn("ground_z", F.lit(least))
    else:
        margin = F.lit(float(boundary_margin))
        boxes = written(boxes, "boxes")
        wide = boxes.select("cluster", *((F.col(f"{a}_min") - margin).alias(f"{a}_min") for a in "xy"), *((F.col(f"{a}_max") + margin).alias(f"{a}_max") for a in "xy"))
        size = 4.0
        cover = wide
        for a in "xy":
            cover = cover.withColumn(f"g{a}", F.explode(F.sequence(F.floor(F.col(f"{a}_min") / size).cast("long"), F.floor(F.col(f"{a}_max") / size).cast("long"))))
        keyed = ground.select(F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("z").alias("tz")).withColumns({"gx": cell_double("tx", size), "gy": cell_double("ty", size)})
        inside = cover.join(shuffled(keyed), ["gx", "gy"]).where(F.col("tx").between(F.col("x_min"), F.col("x_max")) & F.col("ty").between(F.col("y_min"), F.col("y_max")))
        means = written(inside.groupBy("cluster").agg(F.avg("tz").alias("ground_z")), "ground")
        rest = boxes.join(shuffled(means), "cluster", "left_anti").select(F.col("cluster").cast("long").alias("qid"), ((F.col("x_min") + F.col("x_max")) / 2).alias("qx"), ((F.col("y_min") + F.col("y_max")) / 2).alias("qy"))
        targets = ground.select(F.col("point_id").alias("tid"), F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("z").alias("tz"))
        near = nearest.nearest(rest, targets, nearest_ground_points, size).groupBy("qid").agg(F.avg("tz").alias("ground_z")).select(F.col("qid").cast("int").alias("cluster"), "ground_z")
        report = boxes.join(shuffled(means.unionByName(near)), "cluster")
    report = report.withColumn("gap", F.col("min_z") - F.col("ground_z")).withColumn("accepted", F.col("gap") <= max_gap)
    return member, report


def floating_filter(points: DataFrame, ground: DataFrame | None = None, **settings) -> DataFrame:
    """Points with ``kept``: whether their component is near enough to the ground."""
    member, report = ground_gaps(points, ground, **settings)
    return member.join(shuffled(report.select("cluster", F.col("accepted").alias("kept"))), "cluster").select(*points.columns, "cluster", "kept")


def connect_floating(points: DataFrame, ground: DataFrame, ground_z_threshold: float = 0.5, min_cluster_size: int = 5000, max_tilt_deg: float = 30.0, label: str = "label") -> DataFrame:
    """Clusters that do not reach the ground join a grounded one.

    Grounded: lowest z within the threshold of the highest ground point, or
    large.  A floating cluster takes the grounded centroid below its own with the
    least horizontal distance less the allowance for tilt (ties: lowest label),
    else the nearest centroid in space.
    """
    highest = ground.agg(F.max("z")).head()[0]
    stats = written(points.where(F.col(label) != UNASSIGNED).groupBy(label).agg(*(F.avg(a).alias(f"c{a}") for a in "xyz"), F.min("z").alias("min_z"), F.count("*").alias("n")), "centroids")
    if highest is None or stats.isEmpty():
        return points
    grounded = (F.col("min_z") <= F.lit(float(highest) + ground_z_threshold)) | (F.col("n") >= min_cluster_size)
    fixed = stats.where(grounded).select(F.col(label).cast("long").alias("tid"), F.col("cx").alias("tx"), F.col("cy").alias("ty"), F.col("cz").alias("tz"))
    loose = stats.where(~grounded).select(F.col(label).cast("long").alias("qid"), F.col("cx").alias("qx"), F.col("cy").alias("qy"), F.col("cz").alias("qz"))
    lowest = fixed.agg(F.min("tz")).head()[0]
    if lowest is None or loose.isEmpty():
        return points
    slope, size = math.tan(math.radians(max_tilt_deg)), 8.0
    flat = F.sqrt(F.pow(F.col("qx") - F.col("tx"), F.lit(2.0)) + F.pow(F.col("qy") - F.col("ty"), F.lit(2.0)))
    tilted = flat - F.lit(slope) * (F.col("qz") - F.col("tz"))
    below = nearest.ring_join(loose.where(F.col("qz") > lowest), fixed, 1, size, tilted, lambda r: F.lit(r) - F.lit(slope) * (F.col("qz") - F.lit(float(lowest))), F.col("tz") < F.col("qz"))
    above = nearest.nearest(loose.where(F.col("qz") <= lowest), fixed, 1, size, dims=3)
    moves = below.select("qid", "tid").unionByName(above.select("qid", "tid")).select(F.col("qid").alias(label), F.col("tid").alias("to__"))
    moved = points.join(shuffled(moves), label, "left")
    return moved.withColumn(label, F.coalesce(F.col("to__").cast(points.schema[label].dataType), F.col(label))).select(points.columns)


def trunk_positions(points: DataFrame, band: tuple[float, float] = (0.5, 2.0), min_points: int = 1, label: str = "label") -> DataFrame:
    """Per label the mean x and y of the points in a band above its lowest (closed), and its size; null if none are there."""
    lows = points.where(F.col(label) != UNASSIGNED).groupBy(label).agg(F.min("z").alias("low__"), F.count("*").alias("n")).where(F.col("n") >= min_points)
    inside = F.col("z").between(F.col("low__") + band[0], F.col("low__") + band[1])
    return points.join(shuffled(lows), label).groupBy(label).agg(F.avg(F.when(inside, F.col("x"))).alias("x"), F.avg(F.when(inside, F.col("y"))).alias("y"), F.first("n").alias("n"))


def trunk_groups(points: DataFrame, min_trunk_dist: float = 1.5, trunk_height_band: tuple[float, float] = (0.5, 2.0), min_points: int = 50, label: str = "label") -> DataFrame:
    """Labels whose trunks stand within a distance of each other, with the largest of their group (ties: lowest label): label, root."""
    trunks = written(trunk_positions(points, trunk_height_band, min_points, label).where(F.col("x").isNotNull()).withColumnRenamed(label, "trunk"), "trunks")
    size = 2.0 ** math.floor(math.log2(min_trunk_dist) + 1)
    keyed = trunks.withColumns({"gx": cell_double("x", size), "gy": cell_double("y", size)})
    other = keyed.select(F.col("trunk").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"), "gx", "gy")
    far = F.pow(F.col("x") - F.col("ox"), F.lit(2.0)) + F.pow(F.col("y") - F.col("oy"), F.lit(2.0))
    pairs = spread(keyed, ("gx", "gy")).join(shuffled(other), ["gx", "gy"]).where((F.col("trunk") < F.col("other")) & (far <= min_trunk_dist**2))
    groups = connected(pairs.select(F.col("trunk").cast("long").alias("src"), F.col("other").cast("long").alias("dst")))
    sized = groups.join(shuffled(trunks.select(F.col("trunk").cast("long").alias("id"), "n")), "id")
    roots = sized.groupBy("component").agg(F.max_by("id", F.struct("n", -F.col("id"))).alias("root"))
    return sized.join(shuffled(roots), "component").select(F.col("id").alias(label), "root")


def merge_trunks(points: DataFrame, min_trunk_dist: float = 1.5, trunk_height_band: tuple[float, float] = (0.5, 2.0), min_points: int = 50, label: str = "label") -> DataFrame:
    """Labels of close trunks become one, then all are re-indexed; without a pair nothing changes."""
    roots = written(trunk_groups(points, min_trunk_dist, trunk_height_band, min_points, label), "roots")
    if roots.isEmpty():
        return points
    joined = points.join(shuffled(roots), label, "left").withColumn(label, F.coalesce(F.col("root").cast(points.schema[label].dataType), F.col(label))).select(points.columns)
    return labels.reduced(joined, label)
