"""Class labels: 0 Real, 1 Fake."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

LABEL_NAMES = ("Real", "Fake")


def cast_label(
    label: Column, names: Sequence[str] = LABEL_NAMES, integral: bool = False
) -> Column:
    """Label as the class index; a name, an index or an index in text is accepted.

    Anything else fails the query, NULL stays NULL. Which classes occur in the data
    does not matter. ``integral`` is a promise that the column holds whole numbers.
    """
    if integral:
        index = label
    else:
        known = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)])
        text = label.cast("string")
        index = F.coalesce(F.try_element_at(known, text), text.try_cast("int"))
    message = F.concat(F.lit("not a class label: "), label.cast("string"))
    return F.when(
        label.isNull() | F.coalesce(index.between(0, len(names) - 1), F.lit(False)),
        index.cast("int"),
    ).otherwise(F.raise_error(message).cast("int"))


def label_metadata(names: Sequence[str] = LABEL_NAMES) -> dict:
    return {"names": list(names)}


def label_name(label: Column, names: dict[int, str] | Sequence[str] = LABEL_NAMES) -> Column:
    """Class name of an index, NULL for NULL or an index outside the map."""
    pairs = names.items() if isinstance(names, dict) else enumerate(names)
    lookup = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    return F.try_element_at(lookup, label.cast("int"))
