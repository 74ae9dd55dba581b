"""User functions on rows, and columns matched by position."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenprep.operators.index import global_index, join_by_keys, refuse_repeated
from lumenprep.operators.staging import stage


def map_rows(
    df: DataFrame,
    function: Callable[[dict], dict],
    schema: str,
    inputs: Sequence[str] | None = None,
    remove_columns: Sequence[str] = (),
) -> DataFrame:
    """Apply a Python function to each row, for code that columns cannot express.

    The function gets a row as a dict and returns the new or changed columns; ``schema``
    is that of the result. Name the ``inputs`` to keep other columns out of Python.
    """
    columns = [c for c in (inputs or df.columns)]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            done = [{**row, **function(row)} for row in part.to_dict("records")]
            kept = [{k: v for k, v in row.items() if k not in remove_columns} for row in done]
            yield pd.DataFrame(kept)

    return df.select(*columns).mapInPandas(run, schema=schema)


def add_column(
    df: DataFrame, values: DataFrame, order_by: Sequence[str], values_order: Sequence[str]
) -> DataFrame:
    """Columns of ``values`` beside the rows of ``df`` at the same place.

    Both are numbered in their own order, by keys that are unique in it; they must have
    equally many rows. Keys alone are sorted, written and paired by number; wide rows are read
    once, and meet the pairs of keys in a join on each side.
    """
    sides = []
    for side, keys, tag in ((df, order_by, "l"), (values, values_order, "r")):
        named = side.select(*[F.col(c).alias(f"_{tag}{i}") for i, c in enumerate(keys)])
        names = named.columns
        sides.append((stage(global_index(named, names, "_row"), "rows"), names))
    (left, left_names), (right, right_names) = sides
    n_left, n_right = left.count(), right.count()
    if n_left != n_right:
        raise ValueError(f"{n_right} values for {n_left} rows")
    refuse_repeated(left, left_names, "rows")
    refuse_repeated(right, right_names, "values")
    pairs = left.join(right, "_row").drop("_row")
    new = [c for c in values.columns if c not in df.columns]
    added = values.select(*[F.col(c).alias(f"_v{i}") for i, c in enumerate(values_order)], *[F.col(c).alias(f"_new_{c}") for c in new])
    placed = join_by_keys(pairs, added, right_names, [f"_v{i}" for i in range(len(values_order))]).drop(*right_names)
    joined = join_by_keys(df, placed, order_by, left_names)
    return joined.select(*df.columns, *[F.col(f"_new_{c}").alias(c) for c in new])
