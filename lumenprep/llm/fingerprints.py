"""Fingerprints of documents: the k smallest hashes of their word shingles. DataFrame functions only.

The sketch of a union is the k smallest of both sketches, so parts merge. Of two sketches, the k
smallest of the union are a uniform sample of all shingles of both; the share of the sample that lies
in both estimates resemblance, and with the distinct counts it gives containment. A sketch with fewer
than k hashes holds all shingles, and its figures are exact.

A text of one to four words is one shingle; a text without words has an empty sketch. Two empty
sketches resemble each other fully, an empty and another one not at all. NULL texts are empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenprep.llm.words import WORD_PATTERN

K = 128
WORDS = 5


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    """Sorted array of the ``k`` smallest distinct shingle hashes."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN), F.lit(0))
    hashes = F.transform(tokens, lambda w: F.xxhash64(w))
    return sketch_of_hashes(hashes, k, words)


def sketch_of_hashes(hashes: Column, k: int = K, words: int = WORDS) -> Column:
    """The same from an array of word hashes."""

    def shingle(h: Column) -> Column:
        last = F.greatest(F.size(h) - words + 1, F.lit(1))
        starts = F.sequence(F.lit(1), last)
        return F.transform(starts, lambda i: F.xxhash64(*[F.try_element_at(h, i + j) for j in range(words)]))

    held = F.transform(F.array(hashes), shingle)
    every = F.when(F.size(hashes) > 0, F.element_at(held, 1)).otherwise(F.array().cast("array<bigint>"))
    return F.slice(F.sort_array(F.array_distinct(every)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of the shingle sets, 0 to 1."""
    union = merge(a, b, k)
    shared = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(shared / F.size(union).cast("double"))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles."""
    # The k-th smallest of n uniform hashes lies at about k / n of the range of 2^64.
    share = (F.element_at(a, k).cast("double") + float(1 << 63)) / float(1 << 64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has, 0 to 1."""
    likeness = resemblance(a, b, k)
    both = likeness / (1 + likeness) * (distinct_shingles(a, k) + distinct_shingles(b, k))
    share = F.least(F.lit(1.0), both / distinct_shingles(a, k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(share)


def as_text(a: Column) -> Column:
    """Fingerprint as a string: 16 hex digits per hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def merge_groups(sketches: DataFrame, keys: Sequence[str], column: str, k: int = K) -> DataFrame:
    """One merged sketch per group of ``keys``; groups may be of any size.

    Every task keeps the k smallest hashes of a group before the shuffle (a limit on the rank that
    Spark applies on both sides), so no group is gathered. Groups whose sketches are all empty or NULL
    have an empty sketch.
    """
    names = [F.col(c) for c in keys]
    hashes = sketches.select(*names, F.explode(column).alias("_h")).distinct()
    ranked = hashes.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("_h")))
    merged = ranked.where(F.col("_rank") <= k).groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias("_s"))
    groups = sketches.select(*keys).distinct().alias("g")
    same = F.lit(True)
    for c in keys:
        same = same & F.col(f"g.{c}").eqNullSafe(F.col(f"m.{c}"))
    found = groups.join(merged.alias("m"), same, "left")
    empty = F.array().cast("array<bigint>")
    return found.select(*[F.col(f"g.{c}").alias(c) for c in keys], F.coalesce("m._s", empty).alias(column))


def with_next(docs: DataFrame, rows_per_range: int = 500, max_ranges: int = 10_000) -> DataFrame:
    """``doc_id``, ``text``, ``sketch``, ``next_text``, ``next_sketch``: each row with the one after it.

    Order is by doc_id (NULL first), then hash of the text; the first row follows the last. Ids are cut
    into ranges at their approximate quantiles. A range is sorted in one task, and takes along a copy of
    the first row of the range after it, so no row has to look past its own range.
    """
    rows = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = rows.count()
    ranges = max(1, min(max_ranges, n // rows_per_range))
    probs = [i / ranges for i in range(1, ranges)]
    cuts: list[int] = []
    if probs:
        found = rows.agg(F.percentile_approx("doc_id", probs, 10_000).alias("q")).first()["q"]
        cuts = sorted(set(found or []))
    ranged = rows.withColumn("_range", _range_of(F.col("doc_id"), cuts)).withColumn("_th", F.xxhash64("text"))
    # First row of each range: at most max_ranges + 1 rows.
    firsts = ranged.groupBy("_range").agg(F.min(F.struct(F.col("doc_id"), F.col("_th"))).alias("_first"))
    heads = firsts.select(
        F.col("_first.doc_id").alias("_id"),
        F.col("_first._th").alias("_hash"),
        F.coalesce(
            F.lag("_range").over(Window.orderBy("_range")), F.max("_range").over(Window.partitionBy())
        ).alias("_before"),
    )
    head_rows = (
        ranged.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("_hash")))
        .dropDuplicates(["_before"])
        .select("doc_id", "text", F.col("_before").alias("_range"), "_th", F.lit(1).alias("_head"))
    )
    both = ranged.withColumn("_head", F.lit(0)).unionByName(head_rows).repartition("_range")
    order = Window.partitionBy("_range").orderBy("_head", F.col("doc_id").asc_nulls_first(), "_th")
    return (
        both.withColumn("sketch", sketch(F.col("text")))
        .withColumn("_next", F.lead(F.struct("text", "sketch")).over(order))
        .where(F.col("_head") == 0)
        .select("doc_id", "text", "sketch", F.col("_next.text").alias("next_text"), F.col("_next.sketch").alias("next_sketch"))
    )


def _range_of(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` are at most ``value``, looking at two short lists of them."""
    if not cuts:
        return F.lit(0)
    width = max(1, int(len(cuts) ** 0.5))
    parts = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    heads = F.array(*[F.lit(p[0]) for p in parts])
    part = F.size(F.filter(heads, lambda c: c <= value))
    lists = F.array(*[F.array(*[F.lit(c) for c in p]) for p in parts])
    inside = F.size(F.filter(F.element_at(lists, F.greatest(part, F.lit(1))), lambda c: c <= value))
    return F.when(value.isNull() | (part == 0), F.lit(0)).otherwise((part - 1) * width + inside)


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last quarter replaced by the beginning of ``following``."""
    quarter = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - quarter), F.substr(following, F.lit(1), quarter))


def fingerprint_documents(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprint of every text and of its edited form, and their likeness (columns of the query)."""
    rows = with_next(docs).withColumn("_edited", edited(F.col("text"), F.col("next_text")))
    rows = rows.withColumn("_sketch", sketch(F.col("_edited"), k))
    return rows.select(
        "doc_id",
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2("_edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_shingles(F.col("sketch"), k).alias("shingles"),
        containment(F.col("sketch"), F.col("_sketch"), k).alias("contained"),
    )
