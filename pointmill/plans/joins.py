"""Joins with tables that hold a key once, where some keys may hold a large share of the other side's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot with more than this part of all rows; so there are at most as many hot keys.
HOT = 512


def shuffled(table: DataFrame) -> DataFrame:
    """The table, to be joined by a shuffle and never broadcast.

    Spark takes a written table for as large as its files are; compressed columns
    of ids and coordinates hold twenty times as much and more, which the driver
    would gather for a broadcast.  For joins of tables that grow with the rows.
    """
    return table.hint("merge")


def unique_join(rows: DataFrame, table: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Inner join with a table whose column ``size`` says how many of ``rows`` a key has.

    Keys with more than a ``HOT``-th of all rows are at most ``HOT``, whatever the
    data: they are broadcast, and their rows stay where they are.  All other rows
    meet their keys in a shuffle, in which no key is large.  Both tables are read
    twice, so they should be written ones.  Null keys join nothing.
    """
    total = table.agg(F.sum(size)).head()[0] or 0
    is_hot = F.col(size) > total / HOT
    hot = table.where(is_hot & (F.col(size) > 1))
    marks = F.broadcast(hot.select(*keys))
    with_hot = rows.join(F.broadcast(hot), keys)
    rest = rows.join(marks, keys, "left_anti").join(table.where(~is_hot | (F.col(size) <= 1)), keys)
    return with_hot.unionByName(rest)
