"""Mix sources to target weights, to the word.

Rows get hash-random keys. The leading bits of a key are a range of keys, and those ranges
hold equal shares of every source, so a source is sorted range by range however large it is.
Words before a row are the words of the ranges before, plus those before it in its range. A
source's budget is cut at the exact word; where it exceeds the source, whole epochs repeat.

Null ids and texts are ordinary values (a null text has no words). Equal rows are counted,
sorted once, and given their shares one after the other, so a row repeated many times is no
hot spot. The only steps in one task see a row per source, or per range of one source.
An empty table gives an empty plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenprep.llm.columns import number_of, numbered
from lumenprep.functions.draws import HASH_BITS, hash52
from lumenprep.llm.words import WORD_PATTERN

KEY_SALT = "mix"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], cap: float) -> DataFrame:
    """Target of each (source, source_size) row.

    Weights go round in code-point order, NULL last. All sources share the sum of the sizes by
    weight; no target exceeds ``cap`` times its source, and the excess goes to the others by
    weight. With sources in order of cap per weight, those before some point are full and
    the rest share one level of words per weight. A row per source, so one task is enough.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place + 1).cast("int"))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    full = F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    spent = F.coalesce(F.sum("_weight").over(before), F.lit(0))
    total = F.sum("source_size").over(everything).cast("double")
    levelled = (
        sizes.withColumn("_weight", weight)
        .withColumn("_cap", F.lit(float(cap)) * F.col("source_size"))
        .withColumn("_level", (total - full) / (F.sum("_weight").over(everything) - spent))
    )
    fits = F.when(F.col("_level") * F.col("_weight") <= F.col("_cap"), F.col("_level"))
    level = F.coalesce(F.max(fits).over(everything), F.lit(0.0))
    return levelled.select(
        "source", "source_size", F.least(F.col("_cap"), level * F.col("_weight")).alias("target")
    )


def plan_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: tuple[int, ...] = (1, 2, 3),
    cap: float = 3.0,
    seed: int = 42,
    range_bits: int = 10,
) -> DataFrame:
    """One row per input row: doc_id, source, text_hash, size, source_size, target, taken.

    ``taken`` counts the words that the mix takes of the row, repeats included. Rerunning gives
    the same plan: order depends on ``seed`` and the row alone.
    """
    groups = (
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            F.xxhash64(text_col).alias("text_hash"),
            word_count(F.col(text_col)).alias("size"),
        )
        .groupBy("doc_id", "source", "text_hash", "size")
        .agg(F.count("*").alias("_copies"))
        .withColumn("_words", F.col("size") * F.col("_copies"))
        .withColumn("_key", hash52(F.col("doc_id"), seed, KEY_SALT))
        .withColumn("_range", F.shiftright("_key", HASH_BITS - range_bits))
    )
    ranges = groups.groupBy("source", "_range").agg(F.sum("_words").alias("_in_range"))
    earlier = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_start", F.coalesce(F.sum("_in_range").over(earlier), F.lit(0)))
    targets = source_targets(
        ranges.groupBy("source").agg(F.sum("_in_range").alias("source_size")), weights, cap
    )
    starts = (
        ranges.alias("r")
        .join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")))
        .select(F.col("r.source").alias("_source"), F.col("_range").alias("_r"), "_start", "source_size", "target")
    )
    in_range = (
        Window.partitionBy(F.coalesce("source", F.lit("")), F.isnull("source"), "_range")
        .orderBy("_key", "doc_id", "text_hash", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = (
        groups.withColumn("_before", F.coalesce(F.sum("_words").over(in_range), F.lit(0)))
        .join(
            starts,
            (F.coalesce("source", F.lit("")) == F.coalesce("_source", F.lit("")))
            & (F.isnull("source") == F.isnull("_source"))
            & (F.col("_range") == F.col("_r")),
        )
        .withColumn("_before", F.col("_before") + F.col("_start"))
    )
    budget = F.floor(F.col("target") + 0.5).cast("bigint")
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target + 0.5) div source_size")).otherwise(0)
    copies = placed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    before = F.col("_before") + (F.col("_copy") - 1) * F.col("size")
    rest = budget - epochs * F.col("source_size") - before
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return copies.select(
        "doc_id", "source", "text_hash", "size", "source_size", "target", taken.cast("bigint").alias("taken")
    )


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The mixed rows themselves: every column of ``docs``, plus mix_epoch, mix_words, mix_target.

    A document stands once per epoch that takes it. ``mix_words`` is its size, or fewer where
    the budget of its source ends inside it. Input rows that the mix does not reach are left out.
    Columns of ``docs`` with those names give way to the new ones; all others, whatever their names, come through.
    """
    plan = plan_mix(docs, **options).where(F.col("taken") > 0)
    keys = plan.select(
        F.col("doc_id").alias("id"), F.col("source").alias("src"), F.col("text_hash").alias("hash"),
        "size", "target", "taken",
    )
    new = ("mix_epoch", "mix_words", "mix_target")
    kept = docs.drop(*new)
    own_id, own_source, own_text = (
        number_of(kept, options.get(k, v)) for k, v in (("id_col", "doc_id"), ("source_col", "source"), ("text_col", "text"))
    )
    rows = numbered(kept).withColumn("text_hash", F.xxhash64(own_text)).dropDuplicates([own_id, own_source, "text_hash"])
    # Where the hashes agree, equal ids and sources are asked of them, NULL included.
    joined = rows.join(
        keys,
        (F.col("text_hash") == F.col("hash"))
        & F.col(own_id).eqNullSafe(F.col("id"))
        & F.col(own_source).eqNullSafe(F.col("src")),
    )
    last = F.floor((F.col("taken") - 1) / F.col("size")).cast("int")
    out = joined.withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), last)))
    words = F.least(F.col("size"), F.col("taken") - F.col("mix_epoch") * F.col("size"))
    chosen = out.withColumn("mix_words", words).withColumn("mix_target", F.col("target"))
    return chosen.select(*numbered(kept).columns, *new).toDF(*kept.columns, *new)
