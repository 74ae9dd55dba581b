"""Numbering the columns of an input, so that no name of the user's can clash with one of an operator's own."""

from __future__ import annotations

from pyspark.sql import DataFrame


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns named ``_0``, ``_1``, ...; ``toDF(*df.columns)`` gives them their names back."""
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))])


def number_of(df: DataFrame, name: str) -> str:
    """Name after ``numbered`` of a column; a name in another case is accepted where there is none in the same."""
    names = df.columns
    if name not in names:
        names, name = [c.lower() for c in names], name.lower()
    return f"_{names.index(name)}"
