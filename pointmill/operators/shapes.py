"""Shapes of clusters: covariance, trunk test, hulls, and the shrub filter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.ranking import dense_index
from ..plans.joins import shuffled
from ..plans.scratch import written
from ..schema import UNASSIGNED
from . import clusters, nearest

PAIRS = ("xx", "xy", "xz", "yy", "yz", "zz")
HULL_PARTS = 16


def covariances(points: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Per cluster its size and the six population covariances of its coordinates."""
    return points.groupBy(cluster).agg(F.count("*").alias("n"), *(F.covar_pop(p[0], p[1]).alias(f"cov_{p}") for p in PAIRS))


def _axes(*covs: pd.Series) -> pd.DataFrame:
    """Linearity, and how upright the main axis is."""
    six = np.nan_to_num(np.column_stack(covs).astype(float))
    full = six[:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3)
    values, vectors = np.linalg.eigh(full)
    values = np.clip(values, 0, None)
    top = values[:, 2]
    linear = np.where(top > 0, (top - values[:, 1]) / np.where(top > 0, top, 1), 0.0)
    return pd.DataFrame({"linearity": linear, "upright": np.abs(vectors[:, 2, 2])})


_axes_udf = F.pandas_udf(_axes, StructType([StructField("linearity", DoubleType()), StructField("upright", DoubleType())]))


def partial_trunks(points: DataFrame, cluster: str = "cluster", min_points: int = 100, linearity: float = 0.55, upright: float = 0.70) -> DataFrame:
    """Per cluster whether it is a piece of a trunk: many points, drawn out along one axis, and that axis upright."""
    found = covariances(points, cluster).withColumn("axes", _axes_udf(*(f"cov_{p}" for p in PAIRS)))
    found = found.select(cluster, "n", "axes.linearity", "axes.upright")
    return found.withColumn("is_trunk", (F.col("n") >= min_points) & (F.col("linearity") >= linearity) & (F.col("upright") >= upright))


def without_trunks(points: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Points of clusters that are no pieces of trunks; negative cluster ids raise."""
    if not points.where(F.col(cluster) < 0).isEmpty():
        raise ValueError("cluster ids must not be negative")
    return points.join(shuffled(partial_trunks(points, cluster).where("is_trunk").select(cluster)), cluster, "left_anti").select(points.columns)


def _inside(xy: np.ndarray) -> np.ndarray:
    """Points strictly inside the polygon of those that are extreme in eight directions."""
    sums = [xy[:, 0], xy[:, 0] + xy[:, 1], xy[:, 1], xy[:, 1] - xy[:, 0]]
    ends = xy[[int(f(v)) for f in (np.argmax, np.argmin) for v in sums]]
    within = np.ones(len(xy), bool)
    for (ax, ay), (bx, by) in zip(ends, np.roll(ends, -1, axis=0)):
        if ax != bx or ay != by:
            within &= (bx - ax) * (xy[:, 1] - ay) - (by - ay) * (xy[:, 0] - ax) > 0
    return within


def hull(xy: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, by Andrew's monotone chains, without points that lie inside a polygon of extreme ones."""
    if len(xy) > 64:
        xy = xy[~_inside(xy)]
    xy = np.unique(xy, axis=0)
    if len(xy) < 3:
        return xy

    def half(rows: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(xy) + half(xy[::-1]))


def shoelace(corners: np.ndarray) -> float:
    """Area of a polygon."""
    if len(corners) < 3:
        return 0.0
    x, y = corners[:, 0], corners[:, 1]
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)


def _corners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Corners of the hull of each run of rows of one cluster; what is held is one hull and one batch."""
    held: tuple | None = None
    for batch in batches:
        ids, xy = batch.column(0).to_numpy(), np.column_stack([batch.column(k).to_numpy() for k in (1, 2)])
        order = np.argsort(ids, kind="stable")
        ids, xy = ids[order], xy[order]
        cuts = np.flatnonzero(np.diff(ids, prepend=ids[:1] - 1)) if len(ids) else np.zeros(0, int)
        out = []
        for a, b in zip(cuts, [*cuts[1:], len(ids)]):
            own = hull(xy[a:b])
            if held is not None and held[0] == ids[a]:
                held = held[0], hull(np.vstack([held[1], own]))
            else:
                out += [held] if held is not None else []
                held = ids[a], own
        if out:
            yield _corner_rows(out)
    if held is not None:
        yield _corner_rows([held])


def _corner_rows(hulls: list[tuple]) -> pa.RecordBatch:
    xy = np.vstack([h for _, h in hulls])
    return pa.RecordBatch.from_arrays([pa.array(np.repeat([c for c, _ in hulls], [len(h) for _, h in hulls])), pa.array(xy[:, 0]), pa.array(xy[:, 1])], ["cluster__", "x", "y"])


def _areas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each cluster, whose corners follow each other: its area, null if it has none."""
    ids, areas, own, last = [], [], [], None

    def close() -> None:
        if last is not None:
            found = shoelace(hull(np.array(own)))
            ids.append(last), areas.append(found if found > 0 else None)

    for batch in _corners(batches):
        for cluster, x, y in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if cluster != last:
                close()
                own, last = [], cluster
            own.append((x, y))
    close()
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(areas, pa.float64())], ["cluster__", "area"])


def hull_areas(points: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Per cluster the area of the convex hull in x and y, null if it has none; points without a cluster are left out.

    Hulls of the rows that a task has come first, without a shuffle; their corners
    meet by cluster and part, then by cluster, so no task holds a whole cluster.
    """
    kind, corners = points.schema[cluster].dataType.simpleString(), "cluster__ long, x double, y double"
    places = points.where(F.col(cluster).isNotNull()).select(F.col(cluster).cast("long").alias("cluster__"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    local = places.mapInArrow(_corners, corners).withColumn("part__", F.pmod(F.xxhash64("x", "y"), F.lit(HULL_PARTS)))
    parts = local.repartition("cluster__", "part__").sortWithinPartitions("cluster__").select("cluster__", "x", "y").mapInArrow(_corners, corners)
    whole = parts.repartition("cluster__").sortWithinPartitions("cluster__").mapInArrow(_areas, "cluster__ long, area double")
    return whole.select(F.col("cluster__").cast(kind).alias(cluster), "area")


def lowest_points(points: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Per cluster its lowest point (ties: smallest id) as ``low``, and its height from there."""
    low = F.min_by(F.struct("point_id", "x", "y", "z"), F.struct("z", "point_id")).alias("low")
    return points.groupBy(cluster).agg(low, (F.max("z") - F.min("z")).alias("height"))


def shrub_report(points: DataFrame, ground: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Per cluster what the shrub filter looks at, and whether it passes.

    Ground is the mean of the ground points within 0.75 in x and y of the lowest
    point; the section reaches 0.4 above it.  Widths are hull areas over pi.
    """
    lowest = written(lowest_points(points, cluster).select(cluster, "height", F.col("low.x").alias("qx"), F.col("low.y").alias("qy"), F.col("low.z").alias("low_z")), "lowest")
    level = nearest.box_mean(lowest.select(F.col(cluster).cast("long").alias("qid"), "qx", "qy"), ground, 0.75).select(F.col("qid").alias(cluster), "ground_z")
    level = written(lowest.join(shuffled(level), cluster, "left"), "levels")
    section = points.join(shuffled(level.select(cluster, "ground_z")), cluster).where(F.col("z").between(F.col("ground_z"), F.col("ground_z") + 0.4))
    base = hull_areas(section, cluster).withColumnRenamed("area", "base_area")
    counts = section.groupBy(cluster).agg(F.count("*").alias("base_n"))
    report = level.join(shuffled(base), cluster, "left").join(shuffled(counts), cluster, "left").join(shuffled(hull_areas(points, cluster)), cluster, "left")
    width, base_width = F.col("area") / F.lit(np.pi), F.col("base_area") / F.lit(np.pi)
    report = report.select(cluster, "ground_z", "low_z", "height", F.coalesce("base_n", F.lit(0)).alias("base_n"), base_width.alias("base_width"), width.alias("width"))
    ratio = F.col("height") / F.col("width")
    passes = (F.col("base_n") >= 3) & (F.col("base_width") <= 5.0) & (F.abs(F.col("low_z") - F.col("ground_z")) <= 0.4) & (F.col("width") > 0) & (ratio >= 0.6) & (ratio <= 1.4)
    return report.withColumn("is_shrub", F.coalesce(passes, F.lit(False)))


def shrub_points(points: DataFrame, ground: DataFrame | None, cluster: str = "cluster") -> DataFrame:
    """Points of the clusters that pass the shrub filter; none without ground."""
    if ground is None:
        return points.limit(0)
    return points.join(shuffled(shrub_report(points, ground, cluster).where("is_shrub").select(cluster)), cluster, "left_semi").select(points.columns)


def shrubs(points: DataFrame, ground: DataFrame | None = None, xy_voxel_size: float = 0.5, outlier_neighbors: int = 48, outlier_std_ratio: float = 0.5, tree: str = "tree_id") -> DataFrame:
    """Points with ``shrub_id``: clusters of points off trees that pass the shrub filter and are no trunks, numbered from 0.

    The outlier settings are checked, and otherwise unused.
    """
    if xy_voxel_size <= 0 or outlier_neighbors < 1 or outlier_std_ratio <= 0:
        raise ValueError("sizes, neighbours and ratios must be positive")
    loose = points.where(F.col(tree) == UNASSIGNED)
    none = points.withColumn("shrub_id", F.lit(UNASSIGNED))
    if ground is None or loose.limit(2).count() < 2:
        return none
    member = written(clusters.grid_components(loose, xy_voxel_size), "members")
    passing = written(without_trunks(shrub_points(member, ground)), "shrubs")
    index = dense_index(passing, "cluster", "shrub_id")
    ids = passing.join(shuffled(index), "cluster").select("point_id", F.col("shrub_id").cast("int").alias("shrub_id"))
    return points.join(shuffled(ids), "point_id", "left").withColumn("shrub_id", F.coalesce("shrub_id", F.lit(UNASSIGNED)))
