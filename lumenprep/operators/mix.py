"""Putting datasets together: concatenate, interleave, shuffle, budget, batches."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenprep.operators.index import (
    attach_index,
    file_offsets,
    global_index,
    hash_index,
    require_unique,
    with_file_offset,
)
from lumenprep.operators.staging import stage

SHUFFLE_SALT = "shuffle"


def union_tagged(datasets: Sequence[DataFrame], tag: str = "ds_pos") -> DataFrame:
    """All datasets in one frame, each tagged with its place in the list."""
    if not datasets:
        raise ValueError("there is no dataset to put together")
    tagged = [df.withColumn(tag, F.lit(i)) for i, df in enumerate(datasets)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def concat(
    datasets: Sequence[DataFrame], order_by: Sequence[str], key: str | None = None
) -> DataFrame:
    """Datasets one after the other, with their position ``pos``.

    With ``key``, unique within each dataset, only the key columns are sorted, and wide
    rows join once. Datasets may share keys.
    """
    merged = union_tagged(datasets)
    order = ["ds_pos", *order_by]
    if key is None:
        return global_index(merged, order, "pos")
    return attach_index(merged, ["ds_pos", key], order, "pos")


def round_robin_position(
    rank: Column, place: Column, sizes: Sequence[int]
) -> Column:
    """Position of the ``rank``-th row (from 1) of dataset ``place`` in a round robin.

    Rounds before this one took min(size, rank-1) rows of every dataset; in this round
    the datasets before ``place`` that still had a row come first.
    """
    counts = F.array(*[F.lit(int(n)).cast("bigint") for n in sizes])
    zero = F.lit(0).cast("bigint")
    earlier = F.aggregate(counts, zero, lambda acc, n: acc + F.least(n, rank - 1))
    ahead = F.slice(counts, 1, place)
    same_round = F.aggregate(ahead, zero, lambda acc, n: acc + (n >= rank).cast("bigint"))
    return earlier + same_round


def interleave_position(
    merged: DataFrame, order_by: Sequence[str], n_datasets: int, place: str = "ds_pos"
) -> DataFrame:
    """Round-robin position ``pos`` of tagged rows.

    The rank of a row in its dataset follows from its global index, and the position
    from the rank in closed form: one range sort, however uneven the datasets are.
    """
    indexed = global_index(merged, [place, *order_by], "_idx")
    # One count per dataset of the list the caller gave.
    counts = {r[place]: r["n"] for r in indexed.groupBy(place).agg(F.count("*").alias("n")).collect()}
    sizes = [counts.get(i, 0) for i in range(n_datasets)]
    starts = [sum(sizes[:i]) for i in range(n_datasets)]
    start = F.get(F.array(*[F.lit(s).cast("bigint") for s in starts]), F.col(place))
    rank = F.col("_idx") - start + 1
    return (
        indexed.withColumn("_rank", rank)
        .withColumn("pos", round_robin_position(F.col("_rank"), F.col(place), sizes))
        .drop("_idx", "_rank")
    )


def interleave(
    datasets: Sequence[DataFrame], order_by: Sequence[str], key: str | None = None
) -> DataFrame:
    """One row of each dataset in turn, used-up datasets skipped, until all are used up.

    ``key`` is as in ``concat``.
    """
    merged = union_tagged(datasets)
    if key is None:
        return interleave_position(merged, order_by, len(datasets))
    narrow = stage(merged.select(*dict.fromkeys([key, "ds_pos", *order_by])), "keys")
    require_unique(narrow, ["ds_pos", key], "interleave")
    places = interleave_position(narrow, order_by, len(datasets)).select("ds_pos", key, "pos")
    return merged.join(places, ["ds_pos", key])


def _placed_files(datasets: Sequence[DataFrame], file: str, row: str) -> tuple[DataFrame, list[int]]:
    """Tagged rows with ``_place``, the position in their dataset, and the sizes of the datasets: from file footers."""
    placed, sizes = [], []
    for df in datasets:
        offsets = file_offsets(df, file)
        sizes.append(offsets.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0])
        with_offset = with_file_offset(df, offsets, file, row)
        placed.append(with_offset.withColumn("_place", F.col("_offset") + F.col(row)).drop("_offset"))
    return union_tagged(placed), sizes


def concat_files(datasets: Sequence[DataFrame], file: str = "src_file", row: str = "src_row") -> DataFrame:
    """``concat`` of whole Parquet files in the order of file and row, without a sort, and without a join for few files.

    ``file`` and ``row`` are the columns of ``source_rows``.
    """
    rows, sizes = _placed_files(datasets, file, row)
    starts = F.array(*[F.lit(sum(sizes[:i])).cast("bigint") for i in range(len(sizes))])
    return rows.withColumn("pos", F.get(starts, F.col("ds_pos")) + F.col("_place")).drop("_place")


def interleave_files(datasets: Sequence[DataFrame], file: str = "src_file", row: str = "src_row") -> DataFrame:
    """``interleave`` of whole Parquet files in the order of file and row, as ``concat_files``."""
    rows, sizes = _placed_files(datasets, file, row)
    return rows.withColumn("pos", round_robin_position(F.col("_place") + 1, F.col("ds_pos"), sizes)).drop("_place")


def source_rows(df: DataFrame, file: str = "src_file", row: str = "src_row") -> DataFrame:
    """``df``, read from Parquet files, with each row's file and its number there."""
    return df.withColumns({file: F.col("_metadata.file_path"), row: F.col("_metadata.row_index")})


def shuffle(df: DataFrame, key: str, seed: int, col: str = "pos", bits: int = 12) -> DataFrame:
    """Seeded shuffle: position of each row in the order of its hash, by 2^bits buckets."""
    return hash_index(df, key, seed, SHUFFLE_SALT, col, bits)


def sample_budget(df: DataFrame, n: int, pos: str = "pos") -> DataFrame:
    """The first ``n`` rows by position."""
    return df.where(F.col(pos) < F.lit(n))


def drop_last(df: DataFrame, n_rows: int, n: int = 1, pos: str = "pos") -> DataFrame:
    """All but the last ``n`` of ``n_rows`` positions."""
    return df.where(F.col(pos) < F.lit(n_rows - n))


def batches(
    df: DataFrame, batch_size: int, devices: int = 1, split_batches: bool = False, pos: str = "pos"
) -> DataFrame:
    """``batch_id`` and ``device`` of each row.

    Each device takes whole batches in turn; with ``split_batches`` a batch is divided
    among the devices, and its size must be a multiple of their number.
    """
    if batch_size < 1 or devices < 1:
        raise ValueError("batch size and number of devices must be positive")
    if split_batches and batch_size % devices:
        raise ValueError(f"a batch of {batch_size} cannot be divided among {devices} devices")
    batch = F.floor(F.col(pos) / batch_size).cast("bigint")
    if split_batches:
        device = F.floor(F.pmod(F.col(pos), F.lit(batch_size)) / (batch_size // devices))
    else:
        device = F.pmod(batch, F.lit(devices))
    return df.withColumn("batch_id", batch).withColumn("device", device.cast("int"))
