"""The given tables in the shape the library expects."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenprep.functions.messages import message
from lumenprep.sources.schema import IMAGE

SEED = 42
LANGUAGES = ("en", "fr", "de", "es")


def in_language(lang: str) -> Column:
    """Rows of a language; the last one takes all others too, so that none is lost."""
    if lang != LANGUAGES[-1]:
        return F.col("lang") == lang
    return ~F.coalesce(F.col("lang").isin(*LANGUAGES[:-1]), F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have a label: language as dataset, ``toxic`` as label."""
    docs = table(spark, sf_dir, "documents")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").withColumns(
        {"dataset": F.col("lang"), "label": F.col("toxic")}
    )


def next_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn with the turn after it. The join key is unique, so no conversation is hot."""
    turns = table(spark, sf_dir, "conversations")
    after = turns.select(
        "conv_id",
        (F.col("turn") - 1).alias("turn"),
        F.col("role").alias("next_role"),
        F.col("text").alias("next_text"),
    )
    return turns.join(after, ["conv_id", "turn"])


def exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn and the answer to it, as prompt and completion messages."""
    pairs = next_turns(spark, sf_dir).where("role = 'user' AND next_role = 'assistant'")
    return pairs.select(
        "conv_id",
        "turn",
        "text",
        "next_text",
        message("user", F.col("text")).alias("prompt"),
        message("assistant", F.col("next_text")).alias("completion"),
    )


def dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation whole: a last answer is its completion, all before it the prompt."""
    turns = table(spark, sf_dir, "conversations")
    listed = turns.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    )
    answered = (F.element_at("turns", -1)["role"] == "assistant").cast("int")
    whole = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    n = F.size("turns") - answered
    return listed.select(
        "conv_id", F.slice(whole, 1, n).alias("prompt"), F.slice(whole, n + 1, answered).alias("completion")
    )


def gray_image(embedding: Column) -> Column:
    """64 numbers in [-1, 1] as an 8x8 gray image."""
    level = F.transform(
        embedding,
        lambda x: F.floor(F.greatest(F.least((x.cast("double") + 1) / 2, F.lit(1.0)), F.lit(0.0)) * 255),
    )
    digits = F.array_join(F.transform(level, lambda v: F.lpad(F.hex(v), 2, "0")), "")
    return F.struct(
        F.lit("").alias("origin"),
        F.lit(8).alias("height"),
        F.lit(8).alias("width"),
        F.lit(1).alias("nChannels"),
        F.lit(0).alias("mode"),
        F.unhex(digits).alias("data"),
    ).cast(IMAGE)


def text_image(text: Column) -> Column:
    """All bytes of a text, in rows of 16 pixels, as a colour image (BGR)."""
    data = text.cast("binary")
    rows = F.ceil(F.octet_length(data) / 48).cast("int")
    padded = F.rpad(data, rows * 48, F.lit(b"\x00"))
    return F.struct(
        F.lit("").alias("origin"),
        rows.alias("height"),
        F.lit(16).alias("width"),
        F.lit(3).alias("nChannels"),
        F.lit(16).alias("mode"),
        padded.alias("data"),
    ).cast(IMAGE)


def coarse_levels(stack: np.ndarray, quality: np.ndarray) -> np.ndarray:
    """A codec for images of one shape: the lower the quality, the fewer levels; three channels come out."""
    step = (101 - quality.astype(np.int64))[:, None, None, None]
    coarse = (stack // step * step).astype(np.uint8)
    return np.repeat(coarse, 3, axis=-1) if stack.shape[-1] == 1 else coarse[..., :3]


def gray_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One gray image per embedding; odd labels are fake."""
    vectors = table(spark, sf_dir, "embeddings")
    return vectors.select(
        "vec_id",
        F.pmod(F.col("label"), F.lit(2)).alias("label"),
        gray_image(F.col("embedding")).alias("image"),
    )


def frame_size(key: Column, line: Column) -> tuple[Column, Column]:
    """A height and a width in 20..5000 from two keys."""
    height = F.pmod(key * 7919 + line * 104729, F.lit(4981)) + 20
    width = F.pmod(key * 15485863 + line * 1299709, F.lit(4981)) + 20
    return height.cast("int"), width.cast("int")


def joined(ids: Column) -> Column:
    """Numbers of a list as text."""
    return F.array_join(ids.cast("array<string>"), ",")


def or_minus_one(value: Column) -> Column:
    """A number with -1 for NULL, so that all engines keep it a whole number."""
    return F.coalesce(value.cast("bigint"), F.lit(-1).cast("bigint"))


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files; a pattern, as it may be one file or a folder."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")
