"""From raw documents to a training mix, stage by stage, each written and read again.

Every stage takes the documents that the one before it kept. All but the last return the columns of ``documents``
(``n_chars`` is brought up to date where a text changes). A machine that is lost costs at most the stage that runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenprep.llm import decontaminate, line_dedup, mixing, near_dup, quality
from lumenprep.llm.sketch_groups import sketch_groups
from lumenprep.operators.staging import join_staged, stage, staged_path, staging_scope
from lumenprep.plans.session import ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
# A source has thousands of documents, so its lines recur in a smaller share of them than those of a site's pages.
SOURCE_RATIO = 0.05
SOURCE_TEXTS = 10  # that have the line, at least


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents that the quality classifier scores under 0.3."""
    ship_package(spark)
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score_quality(docs, model, out="_quality")
    return scored.where(F.col("_quality") >= 0.3).drop("_quality")


def one_of_each(docs: DataFrame) -> DataFrame:
    """host, text: of each source one text of every group of near copies, and every other text once.

    The groups are those that fingerprints show, which takes DataFrame functions alone; the stage after this one searches exactly.
    """
    texts = docs.select(F.coalesce("source", F.lit("")).alias("host"), near_dup.text_id(F.col("text")).alias("tid"), F.coalesce("text", F.lit("")).alias("text"))
    groups = sketch_groups(texts.select("tid", "text"))
    members = stage(join_staged(texts.select("host", "tid").distinct(), groups, ["tid"], spread="host"), "members")
    first = members.groupBy("host", "root").agg(F.min("tid").alias("tid")).select("host", "tid")
    more = stage(members.join(first, ["host", "tid"], "left_anti").select("host", "tid", F.lit(True).alias("more")), "more_copies")
    others = join_staged(texts, more, ["host", "tid"], spread="host", how="left").where(F.col("more").isNull())
    return others.dropDuplicates(["host", "tid"]).select("host", "text")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that recur over the texts of a source, near copies counted as one text; no document goes.

    More than 30 % of a source's texts must have the line (of 5 texts or more), or more than 5 % and 10 texts at least.
    """
    ship_package(spark)
    out = line_dedup.drop_boilerplate(
        docs, F.col("source"), F.col("text"), "text", large=(SOURCE_RATIO, SOURCE_TEXTS), counted=one_of_each(docs)
    ).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    ship_package(spark)
    return near_dup.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    ship_package(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their weights; a row per document and epoch."""
    return mixing.mix_sources(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", keep_quality),
    ("line_dedup", drop_lines),
    ("near_dedup", keep_one_copy),
    ("decontamination", drop_leaks),
    ("mixing", mix),
]

# Learned scores and hashed signatures have no SQL; the tests hold every stage against a brute-force form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES:
        path = staged_path(spark, name)
        with staging_scope(spark):  # what a stage puts aside is deleted with it
            out = apply(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
