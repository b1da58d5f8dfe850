"""Wood and leaf: points inside branch cylinders, and the spread of wood near the ground."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.joins import shuffled
from ..plans.scratch import dropped, written
from ..schema import LEAF, UNASSIGNED, WOOD
from . import nearest

#: Width of a cell in the scaled space, and how far an ellipsoid may reach there, with room for rounding.
CELL, REACH = 2.0, 1.000001


def branches(segments: DataFrame) -> DataFrame:
    """Segments with their parent's end: one row per branch cylinder, without the roots."""
    parent = segments.select("tree_no", F.col("seg_no").alias("parent_id"), *(F.col(a).alias(f"p{a}") for a in "xyz"))
    joined = segments.join(shuffled(parent), ["tree_no", "parent_id"])
    return joined.select("tree_no", "seg_no", "px", "py", "pz", "x", "y", "z", "radius")


def checked_segments(segments: DataFrame) -> DataFrame:
    """The segments, or ValueError if they are no forest: two segments or more a tree, roots first, parents before children."""
    trees = segments.groupBy("tree_no").agg(F.count("*").alias("n"), F.max(F.when(F.col("seg_no") == 0, F.col("parent_id"))).alias("root"))
    numbers = [F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")) for c in ("x", "y", "z", "radius")]
    odd = numbers[0] | numbers[1] | numbers[2] | numbers[3] | (F.col("radius") < 0)
    wrong = (F.col("seg_no") > 0) & (F.col("parent_id").isNull() | (F.col("parent_id") < 0) | (F.col("parent_id") >= F.col("seg_no")))
    bad = segments.agg(F.count("*"), F.count_if(odd), F.count_if(wrong)).head()
    if not bad[0] or bad[1] or bad[2]:
        raise ValueError("no trees, bad numbers or bad parents")
    if not trees.where((F.col("n") < 2) | F.col("root").isNull() | (F.col("root") != -1)).isEmpty():
        raise ValueError("a tree has fewer than two segments or no root")
    return segments


def in_cylinders(points: DataFrame, cylinders: DataFrame, distance: float = 0.02, cell_size: float | None = None) -> DataFrame:
    """Ids of points inside any cylinder widened by ``distance``.

    Along the axis the ends are closed, across it the limit is open; cylinders
    without length hold nothing.  Every cylinder goes to the cells its box covers.
    """
    reach = F.col("radius") + 2 * distance
    axis = {a: F.col(a) - F.col(f"p{a}") for a in "xyz"}
    length = F.sqrt(axis["x"] * axis["x"] + axis["y"] * axis["y"] + axis["z"] * axis["z"])
    own = cylinders.withColumn("length", length).where(F.col("length") > 0)
    if cell_size is None:
        middle = own.agg(F.percentile_approx(F.col("radius") + 2 * distance, 0.5)).head()[0]
        cell_size = max(float(middle or 0.0) * 2, 0.05)
    for a in "xyz":
        ends = [F.floor((f(F.col(a), F.col(f"p{a}")) + s * reach) / cell_size).cast("long") for f, s in ((F.least, -1), (F.greatest, 1))]
        own = own.withColumn(f"g{a}", F.explode(F.sequence(*ends)))
    keyed = points.select("point_id", *(F.col(a).cast("double").alias(f"q{a}") for a in "xyz"))
    keyed = keyed.withColumns({f"g{a}": F.floor(F.col(f"q{a}") / cell_size).cast("long") for a in "xyz"})
    off = {a: F.col(f"q{a}") - F.col(f"p{a}") for a in "xyz"}
    along = (off["x"] * axis["x"] + off["y"] * axis["y"] + off["z"] * axis["z"]) / F.col("length")
    across = off["x"] * off["x"] + off["y"] * off["y"] + off["z"] * off["z"] - along * along
    met = keyed.join(shuffled(own), ["gx", "gy", "gz"]).where((along >= -distance) & (along <= F.col("length") + distance) & (F.greatest(across, F.lit(0.0)) < F.pow(F.col("radius") + distance, F.lit(2.0))))
    return met.select("point_id").distinct()


def wood_leaf(points: DataFrame, segments: DataFrame | None, distance: float = 0.02, tree: str = "tree_id") -> DataFrame:
    """Points with ``wood_leaf``: wood inside any tree's branches, else leaf, -1 off trees."""
    on_tree = points.where(F.col(tree) >= 0)
    if segments is None or on_tree.isEmpty():
        return points.withColumn("wood_leaf", F.when(F.col(tree) >= 0, F.lit(LEAF)).otherwise(F.lit(UNASSIGNED)).cast("byte"))
    wood = in_cylinders(on_tree, branches(checked_segments(segments)), distance).withColumn("wood__", F.lit(True))
    joined = points.join(shuffled(wood), "point_id", "left")
    label = F.when(F.col(tree) < 0, F.lit(UNASSIGNED)).when(F.col("wood__"), F.lit(WOOD)).otherwise(F.lit(LEAF))
    return joined.withColumn("wood_leaf", label.cast("byte")).drop("wood__")


def propagated(points: DataFrame, ground: DataFrame, height: float = 1.35, radius: float = 0.3, min_points: int = 3, vertical_radius: float | None = None, tree: str = "tree_id", wood: str = "wood_leaf") -> DataFrame:
    """Leaf points near the ground become wood if enough wood of their tree lies in an ellipsoid around them; repeated until nothing changes.

    Only points at most ``height`` over the ground take part.  Each round joins
    the remaining leaf points to the new wood of their tree by cells of the scaled
    space, so trees of any size are dealt over many tasks; the label of a round
    depends on the round before, not on any order.  A leaf point stays in its
    cell; wood goes to the cells that its ellipsoid touches, mostly eight.
    """
    rise = radius if vertical_radius is None else vertical_radius
    able = points.where((F.col(tree) >= 0) & (F.col(wood) >= 0))
    if able.isEmpty():
        return points
    if ground.isEmpty():
        raise ValueError("no ground points")
    able = nearest.height_above_ground(able, ground).where(F.col("height") <= height)
    able = written(able.select("point_id", F.col(tree).alias("tree"), F.col(wood).alias("wood"), "x", "y", "z"), "able")
    origin = able.groupBy("tree").agg(F.min_by(F.struct("x", "y", "z"), "point_id").alias("o"))
    scaled = able.join(shuffled(origin), "tree").select("point_id", "tree", "wood", *(((F.col(a) - F.col(f"o.{a}")) / F.lit(float(s))).alias(f"s{a}") for a, s in zip("xyz", (radius, radius, rise))))
    cells, keyed = ["tree", "gx", "gy", "gz"], written(scaled, "scaled")
    dropped(able)
    fresh = keyed.where(F.col("wood") == WOOD)
    leaves = keyed.where(F.col("wood") == LEAF).withColumns({f"g{a}": F.floor(F.col(f"s{a}") / CELL).cast("long") for a in "xyz"})
    leaves = leaves.select("point_id", *cells, "sx", "sy", "sz", F.lit(0).cast("long").alias("near"))
    promoted, before = None, None
    far = sum((F.pow(F.col(f"s{a}") - F.col(f"w{a}"), F.lit(2.0)) for a in "xyz"), F.lit(0.0))
    while True:  # counts add up: each round brings only the wood that is new
        around = fresh.select(F.col("tree"), *(F.col(f"s{a}").alias(f"w{a}") for a in "xyz"))
        for a in "xyz":
            ends = [F.floor((F.col(f"w{a}") + end) / CELL).cast("long") for end in (-REACH, REACH)]
            around = around.withColumn(f"g{a}", F.explode(F.sequence(*ends)))
        around = around.select(*(F.col(c).alias(f"{c}__") for c in cells), "wx", "wy", "wz")
        same = [F.col(c) == F.col(f"{c}__") for c in cells]
        met = leaves.join(shuffled(around), [*same, far <= 1.0], "left")
        counted = met.groupBy("point_id", *cells, "sx", "sy", "sz", "near").agg(F.count("wx").alias("more"))
        counted = written(counted.withColumn("near", F.col("near") + F.col("more")).drop("more"), "counted")
        dropped(before)
        turned = written(counted.where(F.col("near") >= min_points), "turned")
        if turned.isEmpty():
            dropped(counted, turned)
            break
        ids = turned.select("point_id", F.lit(True).alias("turned__"))
        promoted = ids if promoted is None else promoted.unionByName(ids)
        fresh, before, leaves = turned, counted, counted.where(F.col("near") < min_points)
    dropped(keyed)
    if promoted is None:
        return points
    joined = points.join(shuffled(promoted), "point_id", "left")
    return joined.withColumn(wood, F.when(F.col("turned__"), F.lit(WOOD)).otherwise(F.col(wood)).cast(points.schema[wood].dataType)).select(points.columns)
