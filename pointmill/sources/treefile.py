"""Text files of branch cylinders: a tree per line, its segments one after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranking import dense_index

#: The fields that a header must begin with.
FIELDS = ("x", "y", "z", "radius", "parent_id", "section_id")


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    """Segments of all trees; comments and blank lines are skipped, further fields allowed."""
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.monotonically_increasing_id().alias("at")).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    first = lines.orderBy("at").head()
    names = [] if first is None else [x.strip() for x in first["line"].split(",")]
    if tuple(names[: len(FIELDS)]) != FIELDS:
        raise ValueError("tree header is not x,y,z,radius,parent_id,section_id,...")
    rows = lines.where(F.col("at") > first["at"])
    width = len(names)
    if rows.isEmpty():
        raise ValueError("no trees")
    values = F.transform(F.filter(F.split(F.regexp_replace("line", r"[,\s]+$", ""), r"[,\s]+"), lambda x: x != ""), lambda x: x.try_cast("double"))
    parsed = rows.select("at", values.alias("v"))
    bad = parsed.where((F.size("v") % width != 0) | F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    if not bad.isEmpty():
        raise ValueError("a tree's numbers are no whole, finite segments")
    number = dense_index(parsed, "at", "tree_no")
    per = F.transform(F.sequence(F.lit(0), (F.size("v") / width).cast("int") - 1), lambda i: F.slice("v", i * width + 1, width))
    out = parsed.join(number, "at").select(F.col("tree_no").cast("int").alias("tree_no"), F.posexplode(per).alias("seg_no", "s"))
    if not out.where(F.col("s")[4] != F.floor(F.col("s")[4])).isEmpty():
        raise ValueError("a parent is no whole number")
    return out.select("tree_no", "seg_no", *(F.col("s")[i].alias(n) for i, n in enumerate(FIELDS[:4])), F.col("s")[4].cast("int").alias("parent_id"), F.col("s")[5].cast("int").alias("section_id"))
