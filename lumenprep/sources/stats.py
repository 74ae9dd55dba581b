"""The profile of real images as a side input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

PROFILE = "idx bigint, blur double, height int, width int"


def write_profile(profile: DataFrame, path: str) -> None:
    """Keep a profile for later jobs, with the hashes of a sample, so that it can be merged."""
    hashes = [c for c in ("hash",) if c in profile.columns]
    profile.select("idx", "blur", "height", "width", *hashes).write.parquet(path)


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROFILE).parquet(path)


def read_sample(spark: SparkSession, path: str) -> DataFrame:
    """A kept sample with its hashes, for ``merge_profiles``."""
    return spark.read.schema(f"{PROFILE}, hash bigint").parquet(path)


def profile_from_arrays(
    spark: SparkSession, blur_vals: Sequence[float], res_vals: Sequence[Sequence[int]]
) -> DataFrame:
    """A profile from arrays at hand: blur values, and (height, width) pairs.

    The two may differ in length; each is numbered from 0.
    """
    n = max(len(blur_vals), len(res_vals))
    blurs = [float(b) for b in blur_vals] + [None] * (n - len(blur_vals))
    sizes = [(int(h), int(w)) for h, w in res_vals] + [(None, None)] * (n - len(res_vals))
    rows = [(i, b, *s) for i, (b, s) in enumerate(zip(blurs, sizes))]
    return spark.createDataFrame(rows, PROFILE)
