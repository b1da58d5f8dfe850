"""Nearest and radius joins on grids."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.grid import cell_double, checked_size, spread
from ..plans.joins import shuffled
from ..plans.scratch import dropped, written

#: Most parts of the targets of a cell, and the targets of a part before there are more.
SALTS, CROWD = 8, 1024


def ring_join(queries: DataFrame, targets: DataFrame, k: int, cell_size: float, score: Column, outside: Callable[[float], Column], keep: Column | None = None) -> DataFrame:
    """The k best targets of each query: the columns of both, score and rank (from 1).

    ``queries`` have qid, qx, qy, ``targets`` tid, tx, ty; ``score`` and ``keep``
    are over both, and ``outside(r)`` bounds from below the score of any target
    farther than r in x and y.  The cell of each query and those around it are
    searched until its k-th score is at most that bound; only queries still open
    go on to cells twice as wide.  Where a cell holds many targets, the targets of
    each cell lie in up to ``SALTS`` parts that the queries all visit.
    """
    size = checked_size(cell_size)
    targets, open_ = written(targets, "targets"), written(queries, "queries")
    ends = targets.agg(F.min("tx"), F.max("tx"), F.min("ty"), F.max("ty")).head()
    own = open_.agg(F.min("qx"), F.max("qx"), F.min("qy"), F.max("qy")).head()
    if ends[0] is None or own[0] is None:
        return queries.join(targets.limit(0), F.lit(False)).withColumn("score", score).withColumn("rank", F.lit(1))
    most = max(ends[1] - own[0], own[1] - ends[0], ends[3] - own[2], own[3] - ends[2])
    found = None
    while True:
        last = size > most
        keyed = targets.withColumns({"gx": cell_double("tx", size), "gy": cell_double("ty", size)})
        crowd = keyed.groupBy("gx", "gy").count().agg(F.max("count")).head()[0]
        salts = max(1, min(SALTS, crowd // CROWD))
        keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("tid"), F.lit(salts)) if salts > 1 else F.lit(0).cast("long"))
        around = spread(open_.withColumns({"gx": cell_double("qx", size), "gy": cell_double("qy", size)}), ("gx", "gy"))
        around = around.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        near = around.join(shuffled(keyed), ["gx", "gy", "salt"]).drop("gx", "gy", "salt").withColumn("score", score)
        near = near if keep is None else near.where(keep)
        ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("score", "tid"))).where(F.col("rank") <= k)
        if last:
            return ranked if found is None else found.unionByName(ranked)
        kth = F.max(F.when(F.col("rank") == k, F.col("score"))).over(Window.partitionBy("qid"))
        sure = ranked.withColumn("kth__", kth).where(F.col("qid").isNotNull() & (F.col("kth__") <= outside(size))).drop("kth__")
        done = written(sure, "ranked")
        found = done if found is None else found.unionByName(done)
        before, open_ = open_, written(open_.join(shuffled(done.where(F.col("rank") == k).select("qid")), "qid", "left_anti"), "queries")
        dropped(before)
        if open_.isEmpty():
            return found
        size = 2 * size


def nearest(queries: DataFrame, targets: DataFrame, k: int = 1, cell_size: float = 1.0, dims: int = 2) -> DataFrame:
    """The k nearest targets by distance in x and y, or in all three: score is the squared distance."""
    if k < 1:
        raise ValueError("k must be at least 1")
    far = F.pow(F.col("qx") - F.col("tx"), F.lit(2.0)) + F.pow(F.col("qy") - F.col("ty"), F.lit(2.0))
    if dims == 3:
        far = far + F.pow(F.col("qz") - F.col("tz"), F.lit(2.0))
    return ring_join(queries, targets, k, cell_size, far, lambda r: F.lit(r * r))


def height_above_ground(points: DataFrame, ground: DataFrame, cell_size: float = 1.0) -> DataFrame:
    """Points with ``height`` over the ground point nearest in x and y (ties: smallest id)."""
    queries = points.select(F.col("point_id").alias("qid"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    targets = ground.select(F.col("point_id").alias("tid"), F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("z").alias("tz"))
    found = nearest(queries, targets, 1, cell_size).select(F.col("qid").alias("point_id"), "tz")
    return points.join(shuffled(found), "point_id").withColumn("height", F.col("z") - F.col("tz")).drop("tz")


def box_mean(queries: DataFrame, ground: DataFrame, radius: float = 0.75) -> DataFrame:
    """Mean ground z within ``radius`` in x and in y (closed) of each query: qid, ground_z, n; queries without any are absent."""
    size = 2.0 ** math.floor(math.log2(radius) + 1)
    keyed = ground.select(F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("z").alias("tz")).withColumns({"gx": cell_double("tx", size), "gy": cell_double("ty", size)})
    around = spread(queries.withColumns({"gx": cell_double("qx", size), "gy": cell_double("qy", size)}), ("gx", "gy"))
    met = around.join(shuffled(keyed), ["gx", "gy"]).where((F.abs(F.col("qx") - F.col("tx")) <= radius) & (F.abs(F.col("qy") - F.col("ty")) <= radius))
    return met.groupBy("qid").agg(F.avg("tz").alias("ground_z"), F.count("*").alias("n"))


def upsampled(points: DataFrame, sample: DataFrame, label: str, size: float = 0.3) -> DataFrame:
    """Every point with the label of the sample point nearest in space (ties: smallest id)."""
    queries = points.select(F.col("point_id").alias("qid"), F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("z").alias("qz"))
    targets = sample.select(F.col("point_id").alias("tid"), F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("z").alias("tz"), label)
    found = nearest(queries, targets, 1, size, dims=3).select(F.col("qid").alias("point_id"), label)
    return points.join(shuffled(found), "point_id")
