"""Dense token ids: every distinct word of a corpus has a number of its own, the most frequent ones the smallest.

Ids of a hash may coincide; these cannot, and they run without gaps, as embedding tables need them. The words are counted
with partial sums, then numbered by one range sort of the distinct ones. To encode, the most frequent words go to the
tasks, as many as ``hot_bytes`` hold, and are looked up once per distinct word of a batch. Other words meet the rest of the
dictionary in a join, once for each block of rows that has them (``blocks``), so neither a frequent word nor one that the
dictionary does not have is hot.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenprep.functions.template import FIRST_TOKEN_ID, words
from lumenprep.operators.blocks import BLOCK_ITEMS, Coder, code_blocks, fill_blocks, list_lengths, places_of, relist
from lumenprep.operators.evaluate import decode_ids
from lumenprep.operators.index import global_index, require_unique
from lumenprep.operators.staging import BROADCAST_ROWS, stage

UNKNOWN_ID = 1
HOT_BYTES = 16 << 20  # of words in every task; a Python dictionary of them takes several times as much
_STEP = 4096

Split = Callable[[Column], Column]


def build_dictionary(
    texts: DataFrame, columns: Sequence[str], split: Split = words, first_id: int = FIRST_TOKEN_ID, min_count: int = 1
) -> DataFrame:
    """Staged ``token``, ``n`` (how often it stands in ``columns``) and ``id``, from ``first_id`` by falling ``n``, then by token.

    Words of fewer than ``min_count`` places are left out, and encoded as unknown.
    """
    tokens = reduce(DataFrame.union, [texts.select(F.explode(split(F.col(c))).alias("token")) for c in columns])
    counted = tokens.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    placed = global_index(counted.withColumn("_less", -F.col("n")), ["_less", "token"], "_idx")
    return stage(placed.select("token", "n", (F.col("_idx") + first_id).cast("int").alias("id")), "dictionary")


def hot_words(dictionary: DataFrame, hot_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """The most frequent words that ``hot_bytes`` hold, and the rest (None if there is none).

    They are cut at a multiple of 4,096 ids, from a running total with one row for each.
    """
    size = F.octet_length("token") + 8
    steps = dictionary.groupBy(F.floor(F.col("id") / _STEP).alias("_step")).agg(F.sum(size).alias("_bytes"))
    upto = Window.orderBy("_step")
    over = steps.withColumn("_upto", F.sum("_bytes").over(upto)).where(F.col("_upto") > hot_bytes)
    first = over.agg(F.min("_step")).first()[0]
    if first is None:
        return dictionary, None
    cut = F.lit(int(first) * _STEP)
    return dictionary.where(F.col("id") < cut), dictionary.where(F.col("id") >= cut)


def _shared(hot: DataFrame) -> Broadcast:
    """Words and ids as a Python dictionary in every task. Bounded by the caller."""
    held = hot.select("token", "id").toArrow()
    return hot.sparkSession.sparkContext.broadcast(dict(zip(held["token"].to_pylist(), held["id"].to_pylist(), strict=True)))


def _look_up(hot: DataFrame, missing: int) -> Callable[[Column], Column]:
    """A function from a column of words to their ids; ``missing`` for words that are not there."""
    shared = _shared(hot)

    @F.arrow_udf("array<int>")
    def run(lists: pa.Array) -> pa.Array:
        known = shared.value
        distinct = lists.flatten().dictionary_encode()
        ids = np.array([known.get(w, missing) for w in distinct.dictionary.to_pylist()], dtype=np.int32)
        values = ids[distinct.indices.to_numpy(zero_copy_only=False)] if len(ids) else ids
        lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()), mask=lists.is_null())

    return run


def tokenizer(
    dictionary: DataFrame, split: Split = words, unknown_id: int = UNKNOWN_ID, hot_bytes: int = HOT_BYTES
) -> Callable[[Column], Column]:
    """A tokenizer (text column to ids) for a dictionary that the tasks can hold; ``encode`` takes larger ones."""
    hot, rest = hot_words(dictionary, hot_bytes)
    if rest is not None:
        raise ValueError(f"the dictionary is over {hot_bytes} bytes: use encode")
    look_up = _look_up(hot, unknown_id)
    return lambda text: look_up(split(text))


def encode(
    df: DataFrame,
    key: str,
    columns: dict[str, str],
    dictionary: DataFrame,
    split: Split = words,
    unknown_id: int = UNKNOWN_ID,
    hot_bytes: int = HOT_BYTES,
    broadcast_rows: int = BROADCAST_ROWS,
    block_items: int = BLOCK_ITEMS,
    whole: bool = True,
) -> DataFrame:
    """``df`` with id columns: ``columns`` maps text column to id column. NULL texts have NULL ids.

    Without ``whole`` only the key and the ids come back, and ids need not be joined to the other columns.

    Rows are only joined, by ``key`` (unique, not NULL), where the tasks cannot hold the dictionary; the result is the same.
    """
    hot, rest = hot_words(dictionary, hot_bytes)
    if rest is None:
        look_up = _look_up(hot, unknown_id)
        coded = df.withColumns({out: look_up(split(F.col(text))) for text, out in columns.items()})
        return coded if whole else coded.select(key, *columns.values())
    lists = {f"_words{i}": out for i, out in enumerate(columns.values())}
    worded = df.select(key, *[split(F.col(text)).alias(c) for text, c in zip(columns, lists, strict=True)])
    coded = code_blocks(worded, key, list(lists), "string", _coder(_shared(hot)), block_items)
    require_unique(coded.where(F.col("_code").isNull()), [key], "rows to encode")
    schema = ", ".join([f"`{key}` {df.schema[key].dataType.simpleString()}", *[f"`{out}` array<int>" for out in lists.values()]])
    size = rest.agg(F.count("*").alias("rows"), F.sum(F.octet_length("token") + 8).alias("bytes")).first()
    small = size["rows"] <= broadcast_rows and size["bytes"] <= HOT_BYTES
    table = rest.select(F.col("token").alias("_item"), F.col("id").alias("_value"))
    found = fill_blocks(coded, key, list(lists), table, unknown_id, _fill(lists), schema, small)
    return df.drop(*lists.values()).join(found, key) if whole else found


def _coder(shared: Broadcast) -> Coder:
    """The ids of words in the tasks' dictionary, and numbers below zero for the others of a block."""

    def run(tokens: pa.Array, seen: dict) -> tuple[np.ndarray, np.ndarray]:
        known, before = shared.value, len(seen)
        names = tokens.to_pylist()
        codes = np.array([known[w] if w in known else seen.setdefault(w, ~len(seen)) for w in names], dtype=np.int32)
        return codes, np.flatnonzero(codes <= ~before)

    return run


def _fill(lists: dict[str, str]) -> Callable[[str, pa.Array, np.ndarray, pa.Array], dict[str, pa.Array]]:
    def run(name: str, coded: pa.Array, codes: np.ndarray, values: pa.Array) -> dict[str, pa.Array]:
        flat = coded.flatten().to_numpy(zero_copy_only=False)
        place, there = places_of(flat, codes)
        ids = np.where(there, values.to_numpy(zero_copy_only=False)[place], flat) if len(codes) else flat
        return {lists[name]: relist(pa.array(ids, pa.int32()), list_lengths(coded), coded.is_null())}

    return run


def decode(df: DataFrame, key: str, ids: str, dictionary: DataFrame, **options) -> DataFrame:
    """``df`` with the words of ``ids``, by ``evaluate.decode_ids``, whose ``options`` it takes."""
    return decode_ids(df, key, ids, dictionary.select("id", "token"), **options)
