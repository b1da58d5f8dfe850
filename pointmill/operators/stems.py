"""Tree extraction.

Two backends give instance labels and branch segments: files of an earlier
extraction (``from_files``), and an approximate one on Spark.  The latter is a
design of its own: points closer than a limit (in cells) are connected, a
component that reaches down to the ground and is tall enough is a tree, and its
slices by height give the stem's segments.

Settings: ``distance_limit`` is the cell, ``height_min`` the least height of a
tree, ``crop_length`` the height of a slice.  A segment's radius is at most half
of ``max_diameter``, and at most ``girth_height_ratio`` times the tree's height.
With ``global_taper`` (radius by height left above the slice) it is drawn towards
that taper by ``global_taper_factor`` (0 to 1, by default 1).  With
``grid_width`` only trees count that stand in the square of that width around
the middle of the cloud.  A ``gravity_factor`` other than the default is refused,
as there are no paths that it could weigh.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranking import dense_index
from ..plans.joins import shuffled
from ..plans.scratch import written
from ..schema import UNASSIGNED, Config
from ..sources import ply, treefile
from . import clusters, nearest


def from_files(labels_path: str, trees_path: str) -> Callable[[DataFrame, DataFrame, Config], tuple[DataFrame, DataFrame]]:
    """An extractor that reads a cloud coloured by instance and a text file of branch cylinders.

    The cloud's vertices belong to the tree points in the order of their ids; a
    different number of them raises.
    """

    def extract(points: DataFrame, ground: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
        spark = points.sparkSession
        own = written(dense_index(points, "point_id", "place"), "places")
        found = written(ply.read_labels(spark, labels_path).withColumnRenamed("point_id", "place"), "file-labels")
        if own.count() != found.count():
            raise ValueError("the labelled cloud has another number of points than the trees")
        labelled = points.join(shuffled(own.join(shuffled(found), "place").select("point_id", "label")), "point_id")
        return labelled.select(*points.columns, "label"), treefile.read_trees(spark, trees_path)

    return extract


def extracted(points: DataFrame, ground: DataFrame, config: Config, reach: float = 1.5) -> tuple[DataFrame, DataFrame]:
    """Points with ``label``, and the segments of all labelled trees (approximate)."""
    if config.gravity_factor != Config.gravity_factor:
        raise ValueError("gravity_factor has no counterpart in this extraction")
    member = written(clusters.grid_components(points, config.distance_limit, "xyz", "cluster"), "components")
    stats = member.groupBy("cluster").agg(F.min_by(F.struct("x", "y", "z"), F.struct("z", "point_id")).alias("foot"), (F.max("z") - F.min("z")).alias("height"), F.count("*").alias("n"))
    feet = written(stats.select("cluster", "height", "n", F.col("foot.x").alias("qx"), F.col("foot.y").alias("qy"), F.col("foot.z").alias("low")), "feet")
    targets = ground.select(F.col("point_id").alias("tid"), F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("z").alias("tz"))
    level = nearest.nearest(feet.select(F.col("cluster").cast("long").alias("qid"), "qx", "qy"), targets, 1, 2.0).select(F.col("qid").cast("int").alias("cluster"), "tz")
    trees = feet.join(shuffled(level), "cluster").where((F.col("height") >= config.height_min) & (F.col("low") - F.col("tz") <= reach))
    if config.grid_width is not None:
        middle = points.agg(*((F.min(a) + F.max(a)) / 2 for a in "xy")).head()
        half = config.grid_width / 2
        trees = trees.where((F.abs(F.col("qx") - F.lit(float(middle[0]))) <= half) & (F.abs(F.col("qy") - F.lit(float(middle[1]))) <= half))
    index = written(dense_index(trees, "cluster", "label"), "trees")
    labelled = member.join(shuffled(index), "cluster", "left").withColumn("label", F.coalesce("label", F.lit(UNASSIGNED)).cast("int")).select(*points.columns, "label")
    return labelled, shaped(segments(labelled, config.crop_length), config)


def shaped(found: DataFrame, config: Config) -> DataFrame:
    """Segments with their radius limited, and drawn towards the taper, by the settings."""
    ends = found.groupBy("tree_no").agg(F.min("z").alias("low__"), F.max("z").alias("high__"))
    height = F.col("high__") - F.col("low__")
    radius = F.least(F.col("radius"), F.lit(config.max_diameter / 2), F.when(height > 0, height * F.lit(config.girth_height_ratio)))
    if config.global_taper is not None:
        factor = 1.0 if config.global_taper_factor is None else config.global_taper_factor
        radius = radius * F.lit(1 - factor) + F.lit(config.global_taper * factor) * (F.col("high__") - F.col("z"))
    return found.join(shuffled(ends), "tree_no").withColumn("radius", radius).select(found.columns)


def segments(points: DataFrame, slice_height: float, label: str = "label") -> DataFrame:
    """Slices of each labelled tree by height as segments: centre, mean distance from it, and the slice below as parent."""
    own = points.where(F.col(label) >= 0)
    lows = own.groupBy(label).agg(F.min("z").alias("low__"))
    sliced = own.join(shuffled(lows), label).withColumn("slice", F.floor((F.col("z") - F.col("low__")) / slice_height).cast("int"))
    keys = [label, "slice"]
    centres = sliced.groupBy(*keys).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.avg("z").alias("cz"))
    away = F.sqrt(F.pow(F.col("x") - F.col("cx"), F.lit(2.0)) + F.pow(F.col("y") - F.col("cy"), F.lit(2.0)))
    rings = sliced.join(shuffled(centres), keys).groupBy(*keys).agg(F.avg(away).alias("radius"), F.first("cx").alias("x"), F.first("cy").alias("y"), F.first("cz").alias("z"))
    number = F.row_number().over(Window.partitionBy(label).orderBy("slice")) - 1
    numbered = rings.withColumn("seg_no", number).withColumn("most", F.count("*").over(Window.partitionBy(label))).where(F.col("most") > 1)
    return numbered.select(F.col(label).alias("tree_no"), "seg_no", "x", "y", "z", "radius", (F.col("seg_no") - 1).alias("parent_id"), F.lit(0).alias("section_id"))
