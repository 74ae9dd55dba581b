"""Token batches: concatenate, truncate, pad to the batch, mask the loss."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenprep.functions import messages as M
from lumenprep.functions.template import (
    CHATML,
    ChatTemplate,
    completion_suffix,
    render_normalised,
    word_ids,
)

IDS = "array<int>"
IGNORE = -100


def fill(value: int, n: Column) -> Column:
    """``n`` times the same value; none for a negative ``n``."""
    return F.array_repeat(F.lit(value), F.greatest(n, F.lit(0)).cast("int"))


def pad_right(ids: Column, length: Column, value: int) -> Column:
    return F.concat(ids, fill(value, length - F.size(ids)))


def pad_left(ids: Column, length: Column, value: int) -> Column:
    return F.concat(fill(value, length - F.size(ids)), ids)


def truncate(ids: Column, max_length: int | None) -> Column:
    """The first ``max_length`` entries; all where it is None."""
    return ids if max_length is None else F.slice(ids, 1, max_length)


def multiple_of(length: Column, multiple: int | None) -> Column:
    if multiple is None:
        return length
    return (F.ceil(length / multiple) * multiple).cast("int")


def keep_masked(values: Column, mask: Column) -> Column:
    """Entries where the mask is 1."""
    pairs = F.arrays_zip(values.alias("v"), mask.alias("m"))
    return F.transform(F.filter(pairs, lambda p: p["m"] == 1), lambda p: p["v"])


def batch_max(length: Column, batch_id: str = "batch_id") -> Column:
    """Longest row of the batch. Batches have a fixed size, so no window grows with the data."""
    return F.max(length).over(Window.partitionBy(batch_id))


def flush_left(
    df: DataFrame, mask: str, padded: dict[str, int], batch_id: str = "batch_id"
) -> DataFrame:
    """Move padding to the right and cut the batch to its longest row.

    ``padded`` names the array columns and the value each is padded with.
    """
    ones = F.aggregate(F.col(mask), F.lit(0), lambda acc, m: acc + m.cast("int"))
    sized = df.withColumn("_len", ones).withColumn("_max", batch_max(F.col("_len"), batch_id))
    moved = {
        c: pad_right(keep_masked(F.col(c), F.col(mask)), F.col("_max"), value)
        for c, value in padded.items()
    }
    moved[mask] = F.concat(fill(1, F.col("_len")), fill(0, F.col("_max") - F.col("_len")))
    return sized.withColumns(moved).drop("_len", "_max")


def collate(
    df: DataFrame,
    prompt_ids: str = "prompt_ids",
    completion_ids: str = "completion_ids",
    batch_id: str = "batch_id",
    pad_id: int = 0,
    max_length: int | None = None,
    completion_only: bool = True,
    pad_to_multiple_of: int | None = None,
    token_types: tuple[str, str] | None = None,
) -> DataFrame:
    """``input_ids``, ``attention_mask`` and ``labels`` per row, equally long in a batch.

    Prompt and completion are joined, cut to ``max_length`` and padded on the right to the
    longest row of the batch. Labels are the ids, and -100 on padding and, with
    ``completion_only``, on the prompt. ``n_loss_tokens`` counts what is left to learn.
    """
    empty = F.array().cast(IDS)
    prompt = F.coalesce(F.col(prompt_ids).cast(IDS), empty)
    completion = F.coalesce(F.col(completion_ids).cast(IDS), empty)
    ids = df.withColumn("_ids", truncate(F.concat(prompt, completion), max_length)).withColumn(
        "_skip", F.least(F.size(prompt), F.size("_ids")) if completion_only else F.lit(0)
    )
    sized = ids.withColumn("_len", F.size("_ids")).withColumn(
        "_to", multiple_of(batch_max(F.col("_len"), batch_id), pad_to_multiple_of)
    )
    learned = F.slice(F.col("_ids"), F.col("_skip") + 1, F.col("_len") - F.col("_skip"))
    out = {
        "input_ids": pad_right(F.col("_ids"), F.col("_to"), pad_id),
        "attention_mask": pad_right(fill(1, F.col("_len")), F.col("_to"), 0),
        "labels": pad_right(F.concat(fill(IGNORE, F.col("_skip")), learned), F.col("_to"), IGNORE),
        "n_loss_tokens": F.col("_len") - F.col("_skip"),
    }
    if token_types is not None:
        both = F.concat(*[F.coalesce(F.col(c).cast(IDS), empty) for c in token_types])
        out["token_type_ids"] = pad_right(truncate(both, max_length), F.col("_to"), 0)
    return sized.withColumns(out).drop("_ids", "_skip", "_len", "_to")


def batch_media_flags(
    df: DataFrame, n_images: Column, batch_id: str = "batch_id"
) -> DataFrame:
    """Per batch: number of rows and images, and whether it has no image at all."""
    return df.groupBy(batch_id).agg(
        F.count("*").alias("n_rows"),
        F.sum(n_images.cast("bigint")).alias("n_images"),
        F.bool_and(n_images == 0).alias("no_images"),
    )


def tokenise(df: DataFrame, columns: dict[str, str], tokenizer) -> DataFrame:
    """Add id columns: ``columns`` maps text column to id column.

    ``tokenizer`` maps a text column to a column of ids, such as ``word_ids`` or a
    ``pandas_udf`` that loads its model once per worker.
    """
    return df.withColumns({out: tokenizer(F.col(text)) for text, out in columns.items()})


def render_prepared(df: DataFrame, template: ChatTemplate = CHATML) -> DataFrame:
    """``prompt_text`` and ``completion_text`` of prepared rows (prompt, completion, images, video).

    Prompts are whole conversations; their first user message takes the media. The
    completion is what the rendered whole has after the prompt with the answer's header.
    """
    none = F.array()
    plain = lambda c: F.coalesce(F.col(c), none.cast(df.schema[c].dataType))
    n_images = F.coalesce(M.media_count(F.col("images")), F.lit(0))
    prompt = M.normalise_messages(plain("prompt"), n_images, F.col("video").isNotNull())
    answer = M.normalise_messages(plain("completion"), F.lit(0), F.lit(False))
    rendered = df.withColumns(
        {
            "prompt_text": render_normalised(prompt, template, add_answer_header=True),
            "_full": render_normalised(F.concat(prompt, answer), template),
        }
    )
    return rendered.withColumn(
        "completion_text", completion_suffix(F.col("_full"), F.col("prompt_text"))
    ).drop("_full")


def collate_prepared(
    df: DataFrame,
    tokenizer: Callable[[Column], Column] = word_ids,
    template: ChatTemplate = CHATML,
    **options,
) -> DataFrame:
    """Prepared rows with a ``batch_id`` to padded and masked batches, in one plan.

    ``options`` are those of ``collate``.
    """
    columns = {"prompt_text": "prompt_ids", "completion_text": "completion_ids"}
    return collate(tokenise(render_prepared(df, template), columns, tokenizer), **options)
