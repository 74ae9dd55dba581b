"""Sizes of a prepared set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenprep.functions.sizing import run_steps


def size_report(df: DataFrame, by: Sequence[str] = ("dataset", "split", "label")) -> DataFrame:
    """Row counts by ``by`` with all subtotals in one pass; ``level`` 0 is the finest.

    ``level`` tells a subtotal from a NULL value.
    """
    return df.rollup(*by).agg(
        F.count("*").alias("n_rows"), F.grouping_id().cast("bigint").alias("level")
    )


def run_size(
    df: DataFrame, per_device_batch: int, devices: int, accumulation: int = 1, epochs: int = 1,
    num_total_samples: int | None = None,
) -> DataFrame:
    """One row with the number of samples and the optimizer steps of a run.

    Samples are counted unless a number is given.
    """
    if num_total_samples is None:
        counted = df.agg(F.count("*").alias("n_samples"))
    else:
        counted = df.sparkSession.range(1).select(
            F.lit(num_total_samples).cast("bigint").alias("n_samples")
        )
    steps = run_steps(
        F.col("n_samples"), F.lit(per_device_batch), F.lit(devices), F.lit(accumulation), F.lit(epochs)
    )
    return counted.withColumn("n_steps", steps)
