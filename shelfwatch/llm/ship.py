"""Makes this package importable in the Python workers of a session that was started elsewhere."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the application's Python files, once; the driver serves the archive to the executors."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    stem = Path(tempfile.mkdtemp(prefix="spark-")) / package.name
    context.addPyFile(shutil.make_archive(str(stem), "zip", package.parent, package.name))
    _SHIPPED.add(context.applicationId)
