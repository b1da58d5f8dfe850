"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def shipped(spark: SparkSession, root: str) -> None:
    """Send the package to the executors, unless their Python path has it already."""
    context = spark.sparkContext
    if context.applicationId in _SENT or root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    _SENT.add(context.applicationId)
    archive = Path(tempfile.mkdtemp()) / "pointmill.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(Path(root, "pointmill").rglob("*.py")):
            out.write(path, path.relative_to(root))
    context.addPyFile(str(archive))
