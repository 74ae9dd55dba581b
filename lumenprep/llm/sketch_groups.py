"""Groups of near copies from fingerprints, with DataFrame functions alone.

A text's sketch (the k smallest hashes of its word shingles) is cut into bands by hash, and the smallest hashes of a band are
its key. Texts that share a key are each compared with the first of them: the sketches estimate the resemblance, and
those that reach the threshold are linked. Groups are the connected components. So a text takes part in at
most ``bands`` comparisons however many share its keys. This is an estimate for counting texts; ``near_dup`` finds near copies
by their exact overlap.

Texts without words are in no group. A frequent key, or a first text of many, is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenprep.llm.components import connected_components
from lumenprep.llm.fingerprints import resemblance, sketch
from lumenprep.operators.staging import join_staged, stage

K = 64
BANDS, ROWS = 8, 3
LIKENESS = 0.7  # lower than what a pair must have, as an estimate from 64 hashes may be 0.1 too low


def sketch_groups(texts: DataFrame, k: int = K, bands: int = BANDS, rows: int = ROWS, likeness: float = LIKENESS) -> DataFrame:
    """Staged (tid, root) of the texts of ``texts`` (tid, text; copies may be repeated) that resemble others."""
    sketched = texts.select("tid", sketch(F.col("text"), k).alias("sketch")).dropDuplicates(["tid"])
    # The condition is asked of the written table: before, a sketch would be computed for it as well.
    sketches = stage(sketched, "sketches").where(F.size("sketch") > 0)

    def band(b):
        return F.slice(F.filter("sketch", lambda h: F.pmod(h, F.lit(bands)) == b), 1, rows)

    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.when(F.size(band(b)) > 0, F.xxhash64(b, band(b))))
    keyed = stage(sketches.select("tid", F.explode(F.array_compact(keys)).alias("key")), "sketch_keys")
    firsts = keyed.groupBy("key").agg(F.min("tid").alias("b"), F.count("*").alias("_n")).where(F.col("_n") > 1).drop("_n")
    met = join_staged(keyed, stage(firsts, "firsts"), ["key"], spread="tid")
    pairs = stage(met.where(F.col("tid") != F.col("b")).select(F.col("tid").alias("a"), "b").distinct(), "sketch_pairs")
    others = sketches.select(F.col("tid").alias("b"), F.col("sketch").alias("other"))
    others = stage(others.join(pairs.select("b").distinct(), "b", "left_semi"), "first_sketches")
    compared = join_staged(pairs.join(sketches.withColumnRenamed("tid", "a"), "a"), others, ["b"], spread="a")
    links = stage(compared.where(resemblance(F.col("sketch"), F.col("other"), k) >= likeness).select("a", "b"), "sketch_links")
    return connected_components(links)
