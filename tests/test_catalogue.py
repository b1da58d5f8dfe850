"""Every query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from pointmill.plans import catalogue

SF = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)]

    def plain(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return None
        return round(float(x), 6) if "float" in type(x).__name__ else x

    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_matches_sql(spark, duck, name):
    mine = catalogue.QUERIES[name](spark, SF).toPandas()
    other = duck.execute(catalogue.ORACLE[name]).fetchdf()
    assert sorted(mine.columns) == sorted(other.columns)
    assert rows(mine) == rows(other)


def test_queries_without_sql_are_known():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLE) == {"coarse_groups", "segment_summary"}


def test_shuffled_rows_and_partitions_change_nothing(spark):
    from pyspark.sql import functions as F

    from pointmill.operators import clusters
    from pointmill.plans import fixtures

    own = fixtures.of_class(spark, SF, 7)
    other = own.orderBy(F.rand(3)).repartition(7)
    one, two = (sorted(map(tuple, clusters.grid_components(d, 0.5).select("point_id", "cluster").collect())) for d in (own, other))
    assert one == two
