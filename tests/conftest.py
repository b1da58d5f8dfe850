"""One Spark session for all tests."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    import os

    os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "3g", "spark.sql.session.timeZone": "UTC"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def cloud(spark):
    """Builds a table of points from tuples (x, y, z) and further columns."""

    def build(xyz, **columns):
        names, schema = list(columns), "point_id long, x double, y double, z double"
        kinds = {int: "int", float: "double", bool: "boolean"}
        schema += "".join(f", {n} {kinds[type(columns[n][0])]}" for n in names)
        rows = [(i, float(x), float(y), float(z), *(columns[n][i] for n in names)) for i, (x, y, z) in enumerate(xyz)]
        return spark.createDataFrame(rows, schema)

    return build


@pytest.fixture(scope="session")
def column():
    """A column of a table as a list in the order of point ids."""
    return lambda df, name: [r[name] for r in df.select("point_id", name).orderBy("point_id").collect()]
