"""The whole segmentation, from points to instances, species and wood or leaf."""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..operators import clusters, ground, labels, nearest, rays, shapes, stems, tiles, woodleaf
from ..schema import UNASSIGNED, Config
from .joins import shuffled
from .scratch import fresh_path, written

Extractor = Callable[[DataFrame, DataFrame, Config], tuple[DataFrame, DataFrame]]
GROUP_POINTS, GROUPS_AT_ONCE = 4_000_000, 8


def ground_of(points: DataFrame, trees: DataFrame, config: Config) -> DataFrame:
    """Ground points, thinned to one per cubic metre; estimated from the trees' lowest points where no class is set."""
    if config.ground_label is not None and "classification" in points.columns:
        return ground.thinned(labels.ground_points(points, config.ground_label))
    return ground.estimated(trees)


def segmented_trees(points: DataFrame, level: DataFrame, config: Config, extract: Extractor = stems.extracted, min_tree_points: int = 5000, grounded_size: int = 500, grounded_gap: float = 1.5) -> DataFrame:
    """Tree points with tree_id, shrub_id and wood_leaf."""
    if level.limit(3).count() < 3:
        bare = points.withColumn("tree_id", F.lit(UNASSIGNED))
        return shapes.shrubs(bare, level).withColumn("wood_leaf", F.lit(UNASSIGNED).cast("byte"))
    found, segments = extract(points, level, config)
    found = written(found, "labels")
    found = clusters.connect_floating(found, level, grounded_gap, grounded_size)
    found = labels.reduced(labels.without_small(found, min_tree_points)).withColumnRenamed("label", "tree_id")
    found = written(found, "trees")
    own = None if segments.isEmpty() else written(segments, "segments")
    wood = written(woodleaf.wood_leaf(found, own, config.wood_distance), "wood")
    spread = woodleaf.propagated(wood, level, config.wood_propagation_height, config.wood_propagation_radius, config.wood_propagation_min_points, config.wood_propagation_vertical_radius)
    return shapes.shrubs(written(spread, "spread"), level)


def postprocessed(points: DataFrame, min_tree_points: int = 5000) -> DataFrame:
    """A group without any shrub has its close trunks merged and its small trees dropped; one with shrubs stays."""
    if not points.where(F.col("shrub_id") >= 0).isEmpty():
        return points
    merged = clusters.merge_trunks(points, 0.3, (0.5, 1.0), label="tree_id")
    return labels.without_small(merged, min_tree_points, "tree_id")


def coarse_groups(points: DataFrame, n_groups: int | None = None, voxel_size: float = 0.3, seed: int = 7) -> DataFrame:
    """Points with a ``group``: k-means on one point per voxel, then the group of the nearest of these."""
    sample = written(ground.subsampled(points, voxel_size).where("kept").drop("kept"), "sample")
    k = n_groups or max(2, int(points.count() / GROUP_POINTS))
    vectors = sample.withColumn("features", array_to_vector(F.array(*(F.col(a).cast("double") for a in "xyz"))))
    model = KMeans(k=k, seed=seed, predictionCol="group").fit(vectors)
    grouped = written(model.transform(vectors).select("point_id", "x", "y", "z", "group"), "groups")
    return nearest.upsampled(points, grouped, "group", voxel_size)


def segmented_groups(points: DataFrame, config: Config, extract: Extractor = stems.extracted, n_groups: int | None = None, min_tree_points: int = 5000, at_once: int = GROUPS_AT_ONCE) -> DataFrame:
    """The large path: groups of tree points, each segmented within its box, ids made different across groups.

    A group needs only its own part of the gathered points, so up to ``at_once``
    groups run side by side; each writes its result into the folder of its group.
    """
    spark = points.sparkSession
    trees = labels.tree_points(points, config.tree_label)
    grouped = written(coarse_groups(trees, n_groups), "grouped", "group")
    boxes = tiles.group_boxes(grouped, "group")
    near = written(tiles.gathered(points, boxes, "group"), "gathered", "group")
    names = [r["group"] for r in grouped.select("group").distinct().orderBy("group").collect()]
    none = {"tree_id": F.lit(UNASSIGNED), "shrub_id": F.lit(UNASSIGNED), "wood_leaf": F.lit(UNASSIGNED).cast("byte")}
    if not names:
        return trees.withColumns(none)
    folder = fresh_path(spark, "groups")

    def run(group: int) -> DataFrame:
        own = near.where(F.col("group") == group).drop("group")
        own_trees = labels.tree_points(own, config.tree_label)
        found = segmented_trees(own_trees, ground_of(own, own_trees, config), config, extract, min_tree_points)
        mine = found.join(shuffled(grouped.where(F.col("group") == group).select("point_id")), "point_id", "left_semi")
        mine = postprocessed(written(mine, "group"), min_tree_points).select(*trees.columns, *none)
        mine.write.option("compression", "zstd").parquet(f"{folder}/group={group}")
        return mine

    with ThreadPoolExecutor(max(1, min(at_once, len(names)))) as pool:
        schema = list(pool.map(inheritable_thread_target(spark)(run), names))[0].schema
    out = spark.read.schema(schema.add("group", IntegerType())).parquet(folder)
    for name in ("tree_id", "shrub_id"):
        out = labels.offset_labels(out, "group", name)
    out = out.withColumn("wood_leaf", labels.wood_reset())
    return labels.reduced(out, "tree_id").drop("group")


def segment(points: DataFrame, config: Config | None = None, extract: Extractor = stems.extracted, min_tree_points: int = 5000, grounded_size: int = 500, single_pass: int | None = None) -> DataFrame:
    """All points with instance_id, species_id and wood_leaf (-1 where unassigned).

    Without a ground class the ground is estimated from the tree points; without
    a tree class no point is a tree.  Rays come from the columns ray_x, ray_y and
    ray_z, which must be finite, else with ``use_rays`` from the flight metadata;
    the extraction gets them as columns of its points.

    A cloud of any size is segmented whole: groups of points give other trees
    where they part one, so the large path is taken only by a caller who says
    beyond how many tree points.
    """
    config = config or Config()
    none = {"instance_id": F.lit(UNASSIGNED), "species_id": F.lit(UNASSIGNED).cast("byte"), "wood_leaf": F.lit(UNASSIGNED).cast("byte")}
    trees = labels.tree_points(points, config.tree_label) if config.tree_label is not None else points.limit(0)
    n = trees.count()
    if not n:
        return points.withColumns(none)
    with_rays = rays.checked(points) if "ray_x" in points.columns else rays.rays(rays.ray_columns(points)) if config.use_rays else None
    flat = written(labels.centred(points if with_rays is None else with_rays.select(*points.columns, *(c for c in rays.RAY if c not in points.columns))), "centred")
    own = labels.tree_points(flat, config.tree_label)
    if single_pass is not None and n > single_pass:
        found = segmented_groups(flat, config, extract, max(2, math.ceil(n / GROUP_POINTS)), min_tree_points)
    else:
        found = segmented_trees(own, ground_of(flat, own, config), config, extract, min_tree_points, grounded_size)
    merged = labels.merged_instances(written(found, "found")).select("point_id", *none)
    joined = points.join(shuffled(merged), "point_id", "left")
    return joined.select(*points.columns, *(F.coalesce(F.col(k), v).alias(k) for k, v in none.items()))
