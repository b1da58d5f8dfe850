"""Tables that cut lineage, written where every executor can read them.

The folder is the one the session names in ``spark.checkpoint.dir``.  Only a
session without it (tests, notebooks in local mode) gets a temporary folder,
which goes when the process ends.  Tables in a named folder stay as long as
results may be read from them, which is lazily; ``dropped`` deletes those that
later tables replace.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors, as a URI or path."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = context.getCheckpointDir()
    if named:
        return re.sub(r"^file:/(?!/)", "file:///", named.rstrip("/"))
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = context.applicationId
    if key not in _LOCAL:
        folder = tempfile.mkdtemp(prefix="pointmill-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _LOCAL[key] = f"file://{folder}"
    return _LOCAL[key]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/pointmill-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back; with a folder for each value of ``by``."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Delete tables that ``written`` made and nothing reads any more; others are left alone."""
    for table in tables:
        path = None if table is None else table.__dict__.pop("_scratch_path", None)
        if path:
            removed(table.sparkSession, path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
