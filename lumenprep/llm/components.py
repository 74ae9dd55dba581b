"""Connected components of links between keys, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenprep.operators.staging import stage, unstage


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """Link the neighbours of each node to the smallest of them and itself.

    With ``larger``, those above the node; else those below it and itself.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    if not larger:
        both = both.where(F.col("v") < F.col("u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = both.join(least, "u")
    if larger:
        linked = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        linked = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
    return linked.where(F.col("a") != F.col("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """Staged (tid, root) of every node of ``edges`` (a, b); ``root`` is the smallest node of its component.

    Rounds of large and small stars (Kiveris and others, 2014): each keeps the components, and after some
    rounds, logarithmic in practice, every node is linked to its root alone. Each round is staged.
    """
    oriented = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b"))
    current = stage(oriented.distinct(), "edges")
    before = None
    while (mark := _mark(current)) != before:
        before, last = mark, current
        current = stage(_stars(_stars(last, True), False), "edges")
        unstage(last)
    roots = current.select(F.col("a").alias("tid"), F.col("b").alias("root"))
    components = stage(roots.union(current.select("b", "b").distinct()), "components")
    unstage(current)
    return components
