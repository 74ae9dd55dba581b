"""Image and video files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenprep.operators.images import to_rgb


def read_images(spark: SparkSession, path: str, drop_invalid: bool = True) -> DataFrame:
    """``path`` and decoded three-channel ``image`` of each image file.

    Files that are not images are dropped, or kept with an empty image.
    """
    files = spark.read.format("image").option("dropInvalid", drop_invalid).load(path)
    return files.select(
        F.col("image.origin").alias("path"), to_rgb(F.col("image")).alias("image")
    )


def read_binary(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """``path``, ``modificationTime``, ``length`` and ``content`` of each file, such as videos.

    The content is read only where it is selected.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path)
