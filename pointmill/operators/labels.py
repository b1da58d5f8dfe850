"""Label algebra: filters, re-indexing, merging and offsets.  -1 means unassigned throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import dense_index
from ..plans.joins import shuffled
from ..schema import SHRUB, UNASSIGNED

INT_MAX = 2**31 - 1


def tree_points(points: DataFrame, tree_label: int | None, label_col: str = "classification") -> DataFrame:
    """Points of the tree class; all points where no label is set or the table has none."""
    if tree_label is None or label_col not in points.columns:
        return points
    return points.where(F.col(label_col) == tree_label)


def ground_points(points: DataFrame, ground_label: int | None, label_col: str = "classification") -> DataFrame:
    """Points of the ground class; none where no label is set."""
    if ground_label is None or label_col not in points.columns:
        return points.limit(0)
    return points.where(F.col(label_col) == ground_label)


def class_counts(points: DataFrame, label_col: str = "classification") -> DataFrame:
    """Points per class."""
    return points.groupBy(label_col).agg(F.count("*").alias("n"))


def centred(points: DataFrame) -> DataFrame:
    """Coordinates less their mean, as 32-bit floats; the means are one row."""
    means = points.agg(*(F.avg(c).alias(f"mean_{c}") for c in "xyz")).head()
    return points.withColumns({c: (F.col(c) - F.lit(means[f"mean_{c}"])).cast("float") for c in "xyz"})


def reduced(points: DataFrame, label: str = "label") -> DataFrame:
    """Labels re-indexed from 0 in ascending order; -1 stays."""
    index = dense_index(points.where(F.col(label) != UNASSIGNED), label, "index__")
    return points.join(shuffled(index), label, "left").withColumn(label, F.coalesce(F.col("index__").cast("int"), F.lit(UNASSIGNED))).drop("index__").select(points.columns)


def without_small(points: DataFrame, min_points: int = 100, label: str = "label") -> DataFrame:
    """Labels with fewer than ``min_points`` points become -1."""
    small = points.where(F.col(label) != UNASSIGNED).groupBy(label).agg(F.count("*").alias("n__")).where(F.col("n__") < min_points)
    joined = points.join(shuffled(small), label, "left")
    return joined.withColumn(label, F.when(F.col("n__").isNull(), F.col(label)).otherwise(F.lit(UNASSIGNED)).cast(points.schema[label].dataType)).select(points.columns)


def merged_instances(points: DataFrame, tree: str = "tree_id", shrub: str = "shrub_id") -> DataFrame:
    """Columns instance_id and species_id from tree and shrub ids.

    Shrubs follow the largest tree id; gaps stay.  A point in both raises, and so
    does an id beyond 32 bits.
    """
    most = points.agg(F.max(tree).alias("tree"), F.max(shrub).alias("shrub"), F.max((F.col(tree) >= 0) & (F.col(shrub) >= 0)).alias("both")).head()
    if most["both"]:
        raise ValueError("a point is both tree and shrub")
    offset = max(-1, most["tree"] if most["tree"] is not None else -1) + 1
    if (most["shrub"] if most["shrub"] is not None else -1) + offset > INT_MAX:
        raise OverflowError("instance ids exceed 32 bits")
    is_shrub = F.col(shrub) >= 0
    instance = F.when(is_shrub, F.col(shrub) + F.lit(offset)).otherwise(F.col(tree))
    return points.withColumn("instance_id", instance.cast("int")).withColumn("species_id", F.when(is_shrub, F.lit(SHRUB)).otherwise(F.lit(UNASSIGNED)).cast("byte"))


def group_offsets(points: DataFrame, group: str, label: str) -> DataFrame:
    """Per group the sum of (largest label + 1) of the groups before it; groups are few and ranked on the driver."""
    sizes = points.groupBy(group).agg(F.max(F.when(F.col(label) >= 0, F.col(label))).alias("most")).orderBy(group).collect()
    rows, at = [], 0
    for r in sizes:
        rows.append((r[group], at))
        at += 0 if r["most"] is None else int(r["most"]) + 1
    kind = points.schema[group].dataType.simpleString()
    return points.sparkSession.createDataFrame(rows, f"`{group}` {kind}, offset long")


def offset_labels(points: DataFrame, group: str, label: str) -> DataFrame:
    """Labels made different across groups by the groups' offsets."""
    offsets = group_offsets(points, group, label)
    return points.join(F.broadcast(offsets), group).withColumn(label, F.when(F.col(label) >= 0, (F.col(label) + F.col("offset")).cast("int")).otherwise(F.lit(UNASSIGNED))).select(points.columns)


def wood_reset(tree: str = "tree_id", wood: str = "wood_leaf") -> Column:
    """Wood or leaf, -1 off trees."""
    return F.when(F.col(tree) < 0, F.lit(UNASSIGNED)).otherwise(F.col(wood)).cast("byte")


def scattered(full: DataFrame, part: DataFrame, column: str, default: int = UNASSIGNED) -> DataFrame:
    """A column computed for some points, brought to all of them."""
    return full.join(shuffled(part.select("point_id", column)), "point_id", "left").withColumn(column, F.coalesce(column, F.lit(default)))
