"""Lists of items against a table of any size: an item meets the table once for each block of rows that has it, however often it stands there.

A block is a stretch of rows of one task, cut by the number of items. A task writes its rows with codes in place of items, and
each distinct item of a block with its code. These pairs meet the table in a join, where an item has at most one row per block, so
no item is hot; the values come back to the rows of their block. Rows move once, and nothing has a row per occurrence.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenprep.operators.staging import stage

BLOCK_ITEMS = 4 << 20  # 16 MiB of codes; a longer list is a block of its own
_SLICE_ITEMS = 1 << 18
_PARTITION_SHIFT = 33

# Codes of distinct items, and which of them are to be looked up and new to the block; the dict is the block's own.
Coder = Callable[[pa.Array, dict], tuple[np.ndarray, np.ndarray]]


def list_lengths(lists: pa.Array) -> np.ndarray:
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def relist(values: pa.Array, lengths: np.ndarray, missing: pa.Array) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=missing)


def pieces(lengths: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Stretches of whole rows of about ``limit`` items."""
    number = (np.cumsum(lengths) - lengths) // limit
    cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(lengths)]
    return ((a, b) for a, b in zip(cuts, cuts[1:]) if b > a)


def places_of(flat: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each code stands among the sorted ``codes``, and whether it does."""
    if not len(codes):
        return np.zeros(len(flat), np.int64), np.zeros(len(flat), bool)
    place = np.searchsorted(codes, flat).clip(max=len(codes) - 1)
    return place, codes[place] == flat


def _batch(rows: int, columns: dict[str, pa.Array], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    arrays = [columns[name].cast(t) if name in columns else pa.nulls(rows, t) for name, t in types.items()]
    return pa.RecordBatch.from_arrays(arrays, names=list(types))


def code_blocks(df: DataFrame, key: str, lists: Sequence[str], item: str, coder: Coder, block_items: int) -> DataFrame:
    """Staged rows (``_block``, ``key``, ``lists`` as codes) and, where ``_code`` is not NULL, items (``_block``, ``_code``, ``_item``)."""
    key_type = df.schema[key].dataType.simpleString()
    schema = ", ".join(["_block bigint", f"`{key}` {key_type}", *[f"`{c}` array<int>" for c in lists], "_code int", f"_item {item}"])
    item_type = {"int": pa.int32(), "string": pa.string()}[item]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, seen = TaskContext.get().partitionId() << _PARTITION_SHIFT, 0, {}
        for part in parts:
            types = {"_block": pa.int64(), key: part.column(key).type, **{c: pa.list_(pa.int32()) for c in lists}, "_code": pa.int32(), "_item": item_type}
            per_row = sum(list_lengths(part.column(c)) for c in lists)
            for start, end in pieces(per_row, block_items):
                some = part.slice(start, end - start)
                coded = {"_block": pa.array(np.full(end - start, block)), key: some.column(key)}
                for name in lists:
                    lengths, distinct = list_lengths(some.column(name)), some.column(name).flatten().dictionary_encode()
                    codes, new = coder(distinct.dictionary, seen)
                    values = pa.array(codes, pa.int32()).take(distinct.indices)
                    coded[name] = relist(values, lengths, some.column(name).is_null())
                    found = {"_block": pa.array(np.full(len(new), block)), "_code": pa.array(codes[new]), "_item": distinct.dictionary.take(pa.array(new))}
                    yield _batch(len(new), found, types)
                yield _batch(end - start, coded, types)
                held += int(per_row[start:end].sum())
                if held >= block_items:
                    block, held, seen = block + 1, 0, {}

    return stage(df.select(key, *lists).mapInArrow(run, schema=schema), "blocks")


def fill_blocks(
    coded: DataFrame,
    key: str,
    lists: Sequence[str],
    table: DataFrame,
    missing: object,
    finish: Callable[[str, pa.Array, np.ndarray, pa.Array], dict[str, pa.Array]],
    schema: str,
    broadcast: bool = False,
) -> DataFrame:
    """``key`` and what ``finish`` makes of each list from its codes, the block's sorted codes and their values.

    ``table`` has ``_item``, unique, and ``_value``, and goes to all tasks with ``broadcast``; items that it does not have get ``missing``.
    """
    items = coded.where(F.col("_code").isNotNull()).select("_block", "_code", "_item")
    # Spark would go by the size of a compressed file, which says little about a table of words in memory.
    met = items.join(table.hint("broadcast" if broadcast else "merge"), "_item", "left").select("_block", "_code", F.coalesce("_value", F.lit(missing)).alias("_value"))
    rows = coded.where(F.col("_code").isNull()).select(F.col("_block").alias("_of"), key, *lists)

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        codes = found["_code"].to_numpy()
        order = np.argsort(codes)
        # Words of a block may be longer than the offsets of plain strings reach.
        values = found["_value"].cast(pa.large_string()) if pa.types.is_string(found["_value"].type) else found["_value"]
        codes, values = codes[order], values.combine_chunks().take(pa.array(order))
        out = []
        for part in rows.to_batches():
            for start, end in pieces(sum(list_lengths(part.column(c)) for c in lists), _SLICE_ITEMS):
                some = part.slice(start, end - start)
                columns = {key: some.column(key)}
                for name in lists:
                    columns |= finish(name, some.column(name), codes, values)
                out.append(pa.RecordBatch.from_pydict(columns))
        return pa.Table.from_batches(out)

    return rows.groupBy("_of").cogroup(met.groupBy("_block")).applyInArrow(run, schema)
