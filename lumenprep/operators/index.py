"""Global positions and ranks without a single-partition sort."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenprep.functions.draws import HASH_BITS, hash52
from lumenprep.operators.staging import join_staged, stage

LITERAL_FILES = 256  # offsets of so many files stand in an expression
_ROW_BITS = 33  # monotonically_increasing_id keeps the row within a partition in these bits


def require_unique(df: DataFrame, keys: Sequence[str], what: str) -> None:
    """Raise if a key is NULL or stands more than once.

    Looks at the key columns alone, and counts before it shuffles.
    """
    counted = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    row = counted.agg(
        F.sum(F.when(missing, F.col("_n")).otherwise(0)).alias("none"),
        F.sum(F.when(~missing & (F.col("_n") > 1), F.col("_n")).otherwise(0)).alias("repeated"),
    ).first()
    if row["none"] or row["repeated"]:
        raise ValueError(f"{what}: {row['none']} rows without a key, {row['repeated']} with one that others have")


def global_index(df: DataFrame, order_by: Sequence[str], col: str = "idx") -> DataFrame:
    """``df`` with a 0-based contiguous position in the order of ``order_by``.

    ``order_by`` must be unique per row. Rows are range-partitioned and sorted, so a hot
    leading key is spread over partitions by the keys after it. The sorted rows are
    staged once, because range bounds come from a sample and must not move; positions
    are then the row within the partition plus the rows of the partitions before it.
    """
    mark = f"_{col}_mark"
    ordered = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    staged = stage(ordered.withColumn(mark, F.monotonically_increasing_id()), "index")
    part = F.shiftrightunsigned(mark, _ROW_BITS)
    row = F.col(mark).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    # One row per shuffle partition: bounded by the number of tasks, not by the data.
    sizes = staged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("bigint").alias("_offset")
    )
    return (
        staged.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(col, F.col("_offset") + row)
        .select(*df.columns, col)
    )


def attach_index(
    df: DataFrame, key: str | Sequence[str], order_by: Sequence[str], col: str = "idx"
) -> DataFrame:
    """``global_index`` for wide rows: only the keys are sorted, one join brings them back.

    Keys that are NULL or repeated would lose or multiply rows and raise an error.
    """
    keys = [key] if isinstance(key, str) else list(key)
    narrow = stage(df.select(*dict.fromkeys([*keys, *order_by])), "keys")
    require_unique(narrow, keys, "positions")
    positions = global_index(narrow, order_by, col).select(*keys, col)
    return df.join(positions, keys)


def file_offsets(df: DataFrame, file: str = "src_file") -> DataFrame:
    """Staged ``file``, ``_offset``, ``_n``: rows before each file, and in it.

    For whole files only. The counts come from file footers, and there is one row per
    file, so the running total over all files is small.
    """
    sizes = df.groupBy(file).agg(F.count("*").alias("_n"))
    before = Window.orderBy(file).rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("bigint").alias("_offset")
    return stage(sizes.select(file, offset, "_n"), "files")


def with_file_offset(
    df: DataFrame, offsets: DataFrame, file: str = "src_file", row: str = "src_row", col: str = "_offset", literal_files: int = LITERAL_FILES
) -> DataFrame:
    """``df`` with the number of rows before its file.

    The offsets of a few files are part of the expression, so rows are neither joined nor moved; those of more files
    come by a join that moves the small side, or salts it where it is not small.
    """
    few = offsets.limit(literal_files + 1).collect()
    if len(few) > literal_files:
        named = offsets.select(F.col(file), F.col("_offset").alias(col))
        return join_staged(df, named, [file], spread=row)
    if not few:
        return df.withColumn(col, F.lit(0).cast("bigint"))
    by_file = F.create_map(*[F.lit(x) for r in few for x in (r[file], r["_offset"])])
    return df.withColumn(col, F.element_at(by_file, F.col(file)))


def file_index(
    df: DataFrame, file: str = "src_file", row: str = "src_row", col: str = "idx", literal_files: int = LITERAL_FILES
) -> DataFrame:
    """``global_index`` of whole files in the order (file, row), without any sort.

    ``row`` is the row number in the file, as Spark's Parquet scan gives it.
    """
    placed = with_file_offset(df, file_offsets(df, file), file, row, "_offset", literal_files)
    return placed.withColumn(col, F.col("_offset") + F.col(row)).select(*df.columns, col)


def rank_within(
    df: DataFrame, group: str, order_by: Sequence[str], col: str = "rank"
) -> DataFrame:
    """1-based rank of each row inside its group, for groups of any size.

    A large group is spread over range partitions, and its rows meet the start of the
    group in a join that a hot group does not slow down. Only the keys are sorted and
    written; other columns meet their rank in one join by the keys, unique per row.
    """
    keys = list(dict.fromkeys([group, *order_by]))
    indexed = stage(global_index(df.select(*keys), keys, "_idx"), "rank")
    starts = stage(indexed.groupBy(group).agg(F.min("_idx").alias("_start")), "starts")
    ranked = (
        join_staged(indexed, starts, [group], spread="_idx")
        .withColumn(col, F.col("_idx") - F.col("_start") + 1)
        .select(*keys, col)
    )
    if set(df.columns) <= set(keys):
        return ranked.select(*df.columns, col)
    refuse_repeated(indexed, keys, "ranks")
    return join_by_keys(df, ranked, keys).select(*df.columns, col)


def refuse_repeated(df: DataFrame, keys: Sequence[str], what: str) -> None:
    """Raise if two rows have the same keys; NULL counts as a value."""
    repeated = df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").agg(F.sum("_n").alias("n")).first()["n"]
    if repeated:
        raise ValueError(f"{what}: {repeated} rows share their order keys with others")


def join_by_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], right_keys: Sequence[str] | None = None) -> DataFrame:
    """Inner join on keys where NULL equals NULL; the keys of the right side vanish."""
    named = dict(zip(right_keys or keys, range(len(keys))))
    renamed = right.select(*[F.col(c).alias(f"_k{named[c]}") if c in named else F.col(c) for c in right.columns])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return left.join(renamed, on).drop(*[f"_k{i}" for i in range(len(keys))])


def hash_bucket(hashed: Column, bits: int) -> Column:
    """Leading bits of a 52-bit hash: buckets of equal size whatever the groups are."""
    return F.shiftright(hashed, HASH_BITS - bits)


def hash_index(
    df: DataFrame, key: str, seed: int, salt: str, col: str = "pos", bits: int = 12
) -> DataFrame:
    """0-based position of each row in the order of its seeded hash.

    The hash is uniform, so buckets of its leading bits are even and already in order:
    position is the row in the bucket plus the rows in the buckets before. Nothing is
    sampled and nothing has to be staged but the bucket sizes.
    """
    hashed = df.withColumn("_h", hash52(F.col(key), seed, salt)).withColumn(
        "_bucket", hash_bucket(F.col("_h"), bits)
    )
    sizes = hashed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # At most 2^bits rows.
    offsets = sizes.select(
        "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("bigint").alias("_offset")
    )
    in_bucket = Window.partitionBy("_bucket").orderBy("_h", key)
    return (
        hashed.join(F.broadcast(offsets), "_bucket")
        .withColumn(col, F.col("_offset") + F.row_number().over(in_bucket) - 1)
        .select(*df.columns, col)
    )
