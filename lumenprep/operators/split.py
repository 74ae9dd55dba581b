"""Exact, reproducible train/eval splits."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenprep.functions.draws import hash52, u01
from lumenprep.operators.index import hash_bucket
from lumenprep.operators.staging import join_staged, stage

SPLIT_SALT = "split"


def check_fraction(fraction: float) -> float:
    if not 0.0 < fraction < 1.0:
        raise ValueError(f"a split fraction lies between 0 and 1, not at {fraction}")
    return float(fraction)


def mark_smallest(
    df: DataFrame,
    key: str,
    groups: Sequence[str],
    quotas: Callable[[DataFrame], DataFrame],
    seed: int,
    salt: str,
    col: str,
    bits: int = 12,
) -> DataFrame:
    """Mark exactly the ``k`` rows with the smallest hash in each group, or of all rows.

    ``quotas`` adds ``k`` to group sizes (``groups``, ``n``). A histogram of hash buckets
    tells in which bucket the k-th smallest hash lies; only that bucket is sorted. Each
    group then has one threshold (hash, key), and marking is a comparison, so wide rows are
    neither shuffled nor sorted while the thresholds are few enough to broadcast, and no
    group is ever gathered in one task. A key that several rows share is an error where the
    cut would fall among them. There are 2^bits buckets: more of them make the
    sorted one smaller, at 2^bits histogram rows per group.
    """
    ungrouped = not groups
    if ungrouped:
        groups = ["_all"]
    h = hash52(F.col(key), seed, salt)
    narrow = (df.withColumn("_all", F.lit(0)) if ungrouped else df).select(
        *groups, F.col(key).alias("_key"), h.alias("_h"), hash_bucket(h, bits).alias("_bucket")
    )
    histogram = stage(narrow.groupBy(*groups, "_bucket").agg(F.count("*").alias("_c")), "histogram")
    totals = histogram.groupBy(*groups).agg(F.sum("_c").alias("n"))
    quota = quotas(totals).where("k > 0").select(*groups, "k")

    run = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    running = histogram.withColumn("_before", F.coalesce(F.sum("_c").over(run), F.lit(0)))
    edge = stage(
        _join_groups(running, quota, groups, "inner")
        .where("_before < k AND k <= _before + _c")
        .select(*groups, "_bucket", (F.col("k") - F.col("_before")).alias("_need")),
        "edge",
    )
    in_bucket = Window.partitionBy(*groups, "_bucket").orderBy("_h", "_key")
    cuts = stage(
        _join_groups(narrow, edge, [*groups, "_bucket"], "inner")
        .withColumn("_rn", F.row_number().over(in_bucket))
        .withColumn("_last", F.max("_rn").over(Window.partitionBy(*groups, "_bucket", "_h", "_key")))
        .where("_rn = _need")
        .select(*groups, F.col("_h").alias("_cut_h"), F.col("_key").alias("_cut_key"), (F.col("_last") > F.col("_rn")).alias("_torn")),
        "cuts",
    )
    torn = cuts.where("_torn OR _cut_key IS NULL").count()
    if torn:
        raise ValueError(f"the cut falls among rows that share a key, or have none, in {torn} groups")
    cuts = cuts.drop("_torn")

    def below(cut_h: Column, cut_key: Column) -> Column:
        return (h < cut_h) | ((h == cut_h) & (F.col(key) <= cut_key))

    if ungrouped:
        cut = cuts.first()
        marked = F.lit(False) if cut is None else below(F.lit(cut["_cut_h"]), F.lit(cut["_cut_key"]))
        return df.withColumn(col, marked)
    return (
        join_staged(df, cuts, groups, spread=key, how="left")
        .withColumn(col, F.coalesce(below(F.col("_cut_h"), F.col("_cut_key")), F.lit(False)))
        .select(*df.columns, col)
    )


def _join_groups(left: DataFrame, right: DataFrame, groups: Sequence[str], how: str) -> DataFrame:
    """Join on groups where NULL is a group of its own."""
    renamed = right.select(
        *[F.col(c).alias(f"_r_{c}") if c in groups else F.col(c) for c in right.columns]
    )
    on = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_r_{g}")) for g in groups])
    return left.join(renamed, on, how).drop(*[f"_r_{g}" for g in groups])


def held_out(n: Column, fraction: Column) -> Column:
    """Rows held out of ``n``: the fraction, rounded up."""
    return F.ceil(fraction * n.cast("double")).cast("bigint")


def largest_remainder(totals: DataFrame, by: Sequence[str], stratum: str, fraction: Column) -> DataFrame:
    """Quota per stratum: shares rounded down, what is left goes to the largest remainders."""
    whole = Window.partitionBy(*by)
    ranked = Window.partitionBy(*by).orderBy(F.desc("_rest"), F.asc_nulls_last(stratum))
    return (
        totals.withColumn("_total", F.sum("n").over(whole))
        .withColumn("_held", F.coalesce(held_out(F.col("_total"), fraction), F.lit(0)))
        .withColumn("_base", F.expr("_held * n div _total"))
        .withColumn("_rest", F.expr("_held * n % _total"))
        .withColumn("_open", F.col("_held") - F.sum("_base").over(whole))
        .withColumn("_extra", (F.row_number().over(ranked) <= F.col("_open")).cast("bigint"))
        .select(*by, stratum, (F.col("_base") + F.col("_extra")).alias("k"))
    )


def stratified_split(
    df: DataFrame,
    fraction: float | dict[str, float],
    key: str,
    seed: int,
    by: str = "dataset",
    stratum: str = "label",
    col: str = "split",
    bits: int = 12,
) -> DataFrame:
    """Tag rows ``eval`` or ``train``: exactly ceil(f*n) eval rows in every dataset.

    The eval rows of a dataset are shared among its classes by largest remainder and
    drawn by seeded hash. ``fraction`` may differ by dataset; a dataset that is not
    named there stays in train.
    """
    if isinstance(fraction, dict):
        lookup = F.lit(None).cast("double")
        for name, f in fraction.items():
            lookup = F.when(F.col(by) == name, check_fraction(f)).otherwise(lookup)
    else:
        lookup = F.lit(check_fraction(fraction))
    marked = mark_smallest(
        df,
        key,
        [by, stratum],
        lambda totals: largest_remainder(totals, [by], stratum, lookup),
        seed,
        SPLIT_SALT,
        "_eval",
        bits,
    )
    return _tag(marked, df.columns, col)


def random_split(
    df: DataFrame,
    fraction: float,
    key: str,
    seed: int,
    by: str | None = None,
    col: str = "split",
    bits: int = 12,
) -> DataFrame:
    """Tag rows ``eval`` or ``train``: exactly ceil(f*n) eval rows, whatever their class."""
    share = F.lit(check_fraction(fraction))
    marked = mark_smallest(
        df,
        key,
        [by] if by else [],
        lambda totals: totals.withColumn("k", held_out(F.col("n"), share)),
        seed,
        SPLIT_SALT,
        "_eval",
        bits,
    )
    return _tag(marked, df.columns, col)


def _tag(marked: DataFrame, columns: Sequence[str], col: str) -> DataFrame:
    tag = F.when(F.col("_eval"), F.lit("eval")).otherwise(F.lit("train"))
    return marked.select(*[c for c in columns if c != col], tag.alias(col))


def approximate_hash_split(
    df: DataFrame, fraction: float, key: str, seed: int, col: str = "split"
) -> DataFrame:
    """Tag rows by their own hash alone: needs no counts, so it also works on a stream.

    The eval share is only close to ``fraction``.
    """
    is_eval = u01(F.col(key), seed, SPLIT_SALT) < F.lit(check_fraction(fraction))
    return df.withColumn(col, F.when(is_eval, F.lit("eval")).otherwise(F.lit("train")))
