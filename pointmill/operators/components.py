"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.joins import shuffled
from ..plans.scratch import dropped, written


def _along(rows: DataFrame, name: str, to: DataFrame) -> DataFrame:
    """The column's ids replaced by those that ``to`` gives for them."""
    other = to.select(F.col("id").alias(name), F.col("label").alias("to__"))
    return rows.join(shuffled(other), name, "left").withColumn(name, F.coalesce("to__", name)).drop("to__")


def connected(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """The smallest id of each node's component: columns id, component.

    In every round each node moves to its smallest neighbour and on to where that
    one moves, by doubling steps until none can move, and the edges are drawn
    anew between the places where nodes ended; edges within one place go, so that
    the table shrinks fast, and a chain is one place after the first round.
    Edges and moves are written to the shared folder, which cuts the lineage, and
    deleted once they are used up.
    Null ends are ignored, an empty table gives no rows.
    """
    own = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
    own = written(own.select(F.least(src, dst).alias("u"), F.greatest(src, dst).alias("v")).distinct(), "edges")
    moves: list[DataFrame] = []
    while not moves or not own.isEmpty():
        ends = own.select("u", "v").unionByName(own.select(F.col("v").alias("u"), F.col("u").alias("v")))
        far = written(ends.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.first("u")).alias("label")), "moves")
        while True:
            onward = far.select(F.col("id").alias("label"), F.col("label").alias("onward"))
            further = written(far.join(shuffled(onward), "label").select("id", F.col("onward").alias("label"), (F.col("onward") < F.col("label")).alias("moved")), "moves")
            if further.where("moved").isEmpty():
                dropped(further)
                break
            dropped(far)
            far = further
        moves.append(far)
        moved = _along(_along(own, "u", far), "v", far).where(F.col("u") != F.col("v"))
        before, own = own, written(moved.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
        dropped(before)
    found = moves[0]
    for far in moves[1:]:
        found = _along(found, "label", far)
    out = written(found.select("id", F.col("label").alias("component")), "components")
    dropped(own, *moves)
    return out
