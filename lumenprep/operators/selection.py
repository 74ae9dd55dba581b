"""Keys at given places of an order, found by counting instead of sorting.

A first pass gives the number of rows and the range of the leading key; a second counts rows in buckets of it. A bucket
that holds a wanted place is counted again, in narrower buckets or by the next key, until it is small enough
to be sorted. So what is shuffled are counts, and at the end a bucket of bounded size for each place.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from os.path import commonprefix

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 4096
SORT_ROWS = 100_000
_CHARACTERS = 2  # of a text, beyond what all texts of a cell share


@dataclass
class _Cell:
    """Rows whose first keys equal ``equal`` and whose next one lies between ``low`` and ``high``."""

    equal: tuple
    low: object
    high: object
    before: int
    n: int
    wanted: list[int] = field(default_factory=list)

    def inside(self, order_by: Sequence[str]) -> Column:
        here = F.col(order_by[len(self.equal)]).between(F.lit(self.low), F.lit(self.high))
        return reduce(Column.__and__, [F.col(c) == F.lit(v) for c, v in zip(order_by, self.equal)], here)

    def bucket(self, order_by: Sequence[str], buckets: int) -> Column:
        """A number or a text that grows with the key."""
        key = F.col(order_by[len(self.equal)])
        if isinstance(self.low, str):
            return F.substring(key, len(commonprefix([self.low, self.high])) + 1, _CHARACTERS)
        wide = "decimal(38,0)"
        step = (self.high - self.low) // buckets + 1
        return F.floor((key.cast(wide) - F.lit(str(self.low)).cast(wide)) / F.lit(str(step)).cast(wide)).cast("string")


def selectable(df: DataFrame, order_by: Sequence[str]) -> bool:
    """Whether the keys are whole numbers or texts."""
    return all(isinstance(df.schema[c].dataType, T.IntegralType | T.StringType) for c in order_by)


def _in_order(value: object) -> object:
    return value.encode() if isinstance(value, str) else value


def _number(cells: Sequence[_Cell], order_by: Sequence[str], value) -> Column:
    """``value`` of the cell a row lies in."""
    out = F.lit(None)
    for i, cell in enumerate(cells):
        out = F.when(cell.inside(order_by), value(i, cell)).otherwise(out)
    return out


def _refine(df: DataFrame, cells: list[_Cell], order_by: Sequence[str], buckets: int) -> list[_Cell]:
    """One counting pass over the rows of ``cells``, all of one key column; the buckets that hold wanted places."""
    depth = len(cells[0].equal)
    key = F.col(order_by[depth])
    counted = (
        df.select(*order_by, _number(cells, order_by, lambda i, c: F.lit(i)).alias("_cell"), _number(cells, order_by, lambda i, c: c.bucket(order_by, buckets)).alias("_bucket"))
        .where(F.col("_cell").isNotNull())
        .groupBy("_cell", "_bucket")
        .agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))
        .collect()
    )
    out = []
    for i, cell in enumerate(cells):
        before = cell.before
        for r in sorted((r for r in counted if r["_cell"] == i), key=lambda r: _in_order(r["low"])):
            wanted = [w for w in cell.wanted if before <= w < before + r["n"]]
            if wanted:
                out.append(_Cell(cell.equal, r["low"], r["high"], before, r["n"], wanted))
            before += r["n"]
    return out


def _next_key(df: DataFrame, cells: list[_Cell], order_by: Sequence[str]) -> list[_Cell]:
    """Cells of a single value, by the range of the key after it."""
    depth = len(cells[0].equal) + 1
    key = F.col(order_by[depth])
    ranges = df.select(*order_by, _number(cells, order_by, lambda i, c: F.lit(i)).alias("_cell")).where(F.col("_cell").isNotNull())
    found = {r["_cell"]: r for r in ranges.groupBy("_cell").agg(F.min(key).alias("low"), F.max(key).alias("high")).collect()}
    return [_Cell((*c.equal, c.low), found[i]["low"], found[i]["high"], c.before, c.n, c.wanted) for i, c in enumerate(cells)]


def keys_at(
    df: DataFrame, order_by: Sequence[str], wanted: Sequence[int], bounds: tuple, buckets: int = BUCKETS, sort_rows: int = SORT_ROWS
) -> dict[int, list]:
    """Keys at the ``wanted`` places (from 0). ``bounds``: number of rows, least and greatest leading key."""
    n, low, high = bounds
    waiting = [_Cell((), low, high, 0, n, sorted(wanted))] if wanted else []
    found: dict[int, list] = {}
    small: list[_Cell] = []
    while waiting:
        single = [c for c in waiting if c.n > sort_rows and c.low == c.high]
        whole = [c for c in single if len(c.equal) + 1 == len(order_by)]
        found.update({w: [*c.equal, c.low] for c in whole for w in c.wanted})
        small += [c for c in waiting if c.n <= sort_rows]
        wide = [c for c in waiting if c.n > sort_rows and c.low != c.high]
        waiting = []
        for depth in range(len(order_by)):
            here = [c for c in wide if len(c.equal) == depth]
            waiting += _refine(df, here, order_by, buckets) if here else []
            here = [c for c in single if len(c.equal) == depth and c not in whole]
            waiting += _next_key(df, here, order_by) if here else []
    if small:
        place = Window.partitionBy("_cell").orderBy(*order_by)
        rows = df.select(*order_by, _number(small, order_by, lambda i, c: F.lit(i)).alias("_cell")).where(F.col("_cell").isNotNull())
        before = F.element_at(F.array(*[F.lit(c.before) for c in small]), F.col("_cell") + 1)
        placed = rows.withColumn("_place", F.row_number().over(place) - 1 + before)
        chosen = placed.where(F.col("_place").isin([w for c in small for w in c.wanted])).collect()
        found.update({r["_place"]: [r[c] for c in order_by] for r in chosen})
    return found
