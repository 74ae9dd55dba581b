"""Scoring: arg-max, decoding, answer comparison, batch prediction."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenprep.functions.template import word_id, words
from lumenprep.operators.blocks import BLOCK_ITEMS, code_blocks, fill_blocks, list_lengths, places_of
from lumenprep.operators.collate import IDS, IGNORE
from lumenprep.operators.index import require_unique
from lumenprep.operators.staging import stage

# Vocabularies up to this many bytes (tokens and ids) travel to the tasks.
BROADCAST_VOCABULARY = 32 << 20
_NO_ID = -(1 << 31)  # for numbers that no vocabulary of ints can have


def argmax(scores: Column) -> Column:
    """0-based place of the largest score, the first of equal ones."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def replace_ignored(ids: Column, pad_id: int) -> Column:
    """The ignore value as padding, so that ids can be decoded."""
    return F.transform(ids, lambda x: F.when(x == IGNORE, F.lit(pad_id)).otherwise(x))


def generated_suffix(output_ids: Column, input_ids: Column) -> Column:
    """What a model put after its input."""
    return F.slice(output_ids, F.size(input_ids) + 1, F.greatest(F.size(output_ids), F.lit(1)))


def strip(text: Column) -> Column:
    """Text without leading and trailing blanks, tabs and line ends."""
    return F.regexp_replace(F.regexp_replace(text, r"^[ \t\r\n\f\x0b]+", ""), r"[ \t\r\n\f\x0b]+$", "")


def vocabulary(text: DataFrame, column: str) -> DataFrame:
    """``id`` and ``token`` of every word in a text column, for the default word ids."""
    tokens = text.select(F.explode(words(F.col(column))).alias("token")).distinct()
    return tokens.groupBy(word_id(F.col("token")).alias("id")).agg(F.min("token").alias("token"))


def decode_ids(
    df: DataFrame,
    key: str,
    ids: str,
    vocab: DataFrame,
    special_ids: Sequence[int] = (0,),
    joiner: str = " ",
    unknown: str = "",
    col: str = "text",
    broadcast_bytes: int = BROADCAST_VOCABULARY,
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """``df`` with the text of ``ids``, special ids left out.

    A vocabulary of bounded size goes to the tasks and nothing is shuffled. A larger one
    is joined to the distinct ids of blocks of rows (``blocks``). The result is the same: an id that stands twice in the
    vocabulary, and a ``key`` that is NULL or repeated, are errors either way.
    """
    vocab = stage(vocab.select(F.col("id").cast("int"), "token"), "vocabulary")
    require_unique(vocab, ["id"], "vocabulary")
    size = vocab.agg(F.coalesce(F.sum(F.octet_length("token") + 8), F.lit(0)).alias("bytes")).first()["bytes"]
    if size <= broadcast_bytes:
        require_unique(df, [key], "rows to decode")
        kept = F.filter(F.col(ids), lambda x: ~x.isin(*special_ids)) if special_ids else F.col(ids)
        return df.withColumn(col, _lookup_udf(df, vocab, joiner, unknown)(kept))
    # Ids come back from the blocks, so that nothing else of a table of keys and ids has to be joined.
    plain = df.schema[ids].dataType.simpleString() == IDS
    fits = F.transform(ids, lambda x: F.when(x.isNotNull(), F.coalesce(x.try_cast("int"), F.lit(_NO_ID))))
    coded = code_blocks(df.select(key, (F.col(ids) if plain else fits).alias("_ids")), key, ["_ids"], "int", _code_ids, block_items)
    require_unique(coded.where(F.col("_code").isNull()), [key], "rows to decode")
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, `_ids` {IDS}, `_text` string"
    table = vocab.select(F.col("id").alias("_item"), F.col("token").alias("_value"))
    texts = fill_blocks(coded, key, ["_ids"], table, unknown, _join_tokens(special_ids, joiner, unknown), schema)
    others = [c for c in df.columns if c not in (key, ids, col)]
    if others or not plain:
        return df.drop(col).join(texts.select(key, F.col("_text").alias(col)), key)
    return texts.select(*[F.col("_ids").alias(c) if c == ids else F.col(c) for c in df.columns if c != col], F.col("_text").alias(col))


def _code_ids(ids: pa.Array, seen: dict) -> tuple[np.ndarray, np.ndarray]:
    """Ids are their own codes."""
    values = ids.to_numpy(zero_copy_only=False).astype(np.int32)
    before = seen.get("ids", np.zeros(0, np.int32))
    new = np.flatnonzero(~places_of(values, before)[1])
    seen["ids"] = np.union1d(before, values[new])
    return values, new


def _join_tokens(special_ids: Sequence[int], joiner: str, unknown: str):
    def run(name: str, coded: pa.Array, codes: np.ndarray, values: pa.Array) -> dict[str, pa.Array]:
        flat, lengths = coded.flatten(), list_lengths(coded)
        row = np.repeat(np.arange(len(lengths)), lengths)
        if special_ids:
            kept = pc.and_(flat.is_valid(), pc.invert(pc.is_in(flat, pa.array(list(special_ids), pa.int32()))))
            flat, row = flat.filter(kept), row[kept.to_numpy(zero_copy_only=False)]
        place, there = places_of(flat.fill_null(0).to_numpy(zero_copy_only=False), codes)
        there &= flat.is_valid().to_numpy(zero_copy_only=False)
        tokens = values.take(pa.array(place, mask=~there)).fill_null(unknown)
        ends = np.searchsorted(row, np.arange(len(lengths) + 1))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tokens, mask=coded.is_null())
        return {name: coded, "_text": pc.binary_join(lists, pa.scalar(joiner, pa.large_string())).cast(pa.string())}

    return run


def _lookup_udf(df: DataFrame, vocab: DataFrame, joiner: str, unknown: str):
    entries = vocab.orderBy("id").toArrow()
    shared = df.sparkSession.sparkContext.broadcast(
        (entries["id"].to_numpy(), entries["token"].combine_chunks())
    )

    @F.arrow_udf("string")
    def look_up(ids: pa.Array) -> pa.Array:
        known, tokens = shared.value
        flat = ids.flatten().to_numpy(zero_copy_only=False)
        place = np.searchsorted(known, flat).clip(max=max(len(known) - 1, 0))
        missing = known[place] != flat if len(known) else np.ones(len(flat), bool)
        names = tokens.take(pa.array(place, mask=missing)).fill_null(unknown)
        ends = np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
        lists = pa.ListArray.from_arrays(offsets, names.cast(pa.string()), mask=ids.is_null())
        return pc.binary_join(lists, joiner)

    return look_up


def correct(prediction: Column, label: Column) -> Column:
    """True where the stripped answer equals the stripped label; a missing one is wrong."""
    return F.coalesce(strip(prediction) == strip(label), F.lit(False))


def accuracy(prediction: Column, label: Column) -> Column:
    """Share of correct answers as an aggregate, 0.0 without rows."""
    hits = F.sum(correct(prediction, label).cast("bigint"))
    return F.coalesce(F.try_divide(hits.cast("double"), F.count(F.lit(1))), F.lit(0.0))


def evaluate(df: DataFrame, metrics: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Any aggregate columns as metrics, in total or by group."""
    return df.groupBy(*by).agg(*[m.alias(name) for name, m in metrics.items()])


def answer_metrics(prediction: Column, label: Column) -> dict[str, Column]:
    """Number of rows, correct ones and accuracy."""
    return {
        "n_rows": F.count(F.lit(1)),
        "n_correct": F.coalesce(F.sum(correct(prediction, label).cast("bigint")), F.lit(0)),
        "accuracy": accuracy(prediction, label),
    }


def score(
    df: DataFrame,
    inputs: Sequence[str],
    load_model: Callable[[], object],
    predict: Callable[[object, pd.DataFrame], Sequence[str]],
    keep: Sequence[str] = (),
    col: str = "prediction",
) -> DataFrame:
    """Answers of a model for a table.

    The model is loaded once per task and called per Arrow batch with the ``inputs``
    columns. Columns in neither ``inputs`` nor ``keep`` are not sent to Python.
    """
    columns = list(dict.fromkeys([*keep, *inputs]))
    narrow = df.select(*columns)
    out = narrow.select(*keep).schema.add(col, "string")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for part in parts:
            model = load_model() if model is None else model
            answers = part[list(keep)].copy()
            answers[col] = list(predict(model, part[list(inputs)]))
            yield answers

    return narrow.mapInPandas(run, schema=out)
