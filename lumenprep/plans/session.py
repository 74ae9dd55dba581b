"""Making the package known to the Python workers."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    target = str(Path(tempfile.mkdtemp(prefix="lumenprep-")) / package.name)
    context.addPyFile(shutil.make_archive(target, "zip", package.parent, package.name))
    _shipped.add(context.applicationId)
