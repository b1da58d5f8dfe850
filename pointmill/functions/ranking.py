"""Dense indices without a window over all rows."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.scratch import dropped, written


def dense_index(values: DataFrame, column: str, name: str = "index") -> DataFrame:
    """The different non-null values of a column with their rank from 0.

    The values are dealt out by range and ranked within each range; the ranges'
    sizes, one number per partition, give the offsets.
    """
    ranged = values.select(column).where(F.col(column).isNotNull()).distinct().repartitionByRange(F.col(column))
    placed = written(ranged.withColumn("part__", F.spark_partition_id()), "ranks")
    sizes = sorted(placed.groupBy("part__").count().collect())
    begun = [0, *accumulate(n for _, n in sizes)]
    offsets = values.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, begun)] or [(0, 0)], "part__ int, begun__ long")
    rank = F.row_number().over(Window.partitionBy("part__").orderBy(column)) - 1
    return placed.withColumn("rank__", rank).join(F.broadcast(offsets), "part__").select(column, (F.col("begun__") + F.col("rank__")).cast("long").alias(name))


def order_statistic(values: DataFrame, column: str, at: int) -> float:
    """The value at place ``at`` (from 0) of a column in ascending order.

    Equal values are counted first, the counts are dealt out by range, and one
    sum for each range tells which range holds the place; only its counts are
    added up in order.
    """
    counts = values.groupBy(column).agg(F.count("*").alias("n__")).repartitionByRange(F.col(column))
    placed = written(counts.withColumn("part__", F.spark_partition_id()), "counts")
    before = 0
    for part, n in sorted(placed.groupBy("part__").agg(F.sum("n__")).collect()):
        if before + n > at:
            break
        before += n
    upto = F.sum("n__").over(Window.orderBy(column))
    found = placed.where(F.col("part__") == part).withColumn("upto__", upto).where(F.col("upto__") > at - before)
    out = found.agg(F.min(column)).head()[0]
    dropped(placed)
    return out
