"""Head, tail and range slices of a split, such as ``train[:2%]+train[-2%:]``."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenprep.operators.index import file_offsets, global_index
from lumenprep.operators.selection import keys_at, selectable
from lumenprep.operators.staging import stage

_TERM = re.compile(
    r"^\s*(?P<name>[^\[\]+]*?)\s*(?:\[\s*(?P<lo>-?\d+%?)?\s*:\s*(?P<hi>-?\d+%?)?\s*\]"
    r"(?:\((?P<rounding>closest|pct1_dropremainder)\))?)?\s*$"
)


@dataclass(frozen=True)
class Slice:
    """One term: a split name and bounds in rows or percent, open where None."""

    name: str
    lo: int | None = None
    hi: int | None = None
    percent: bool = False
    rounding: str = "closest"

    def bounds(self, n: int) -> tuple[int, int]:
        """Rows [lo, hi) of ``n``; percentages go to the nearest row, halves to even."""
        lo, hi = self._rows(self.lo, 0, n), self._rows(self.hi, n, n)
        return lo, max(lo, hi)

    def _rows(self, bound: int | None, default: int, n: int) -> int:
        if bound is None:
            return default
        if self.percent:
            if self.rounding == "pct1_dropremainder":
                if n < 100:
                    raise ValueError("pct1_dropremainder needs at least 100 rows")
                bound *= n // 100
            else:
                bound = round(bound * n / 100.0)
        return min(max(n + bound, 0) if bound < 0 else bound, n)


def parse_slices(text: str) -> list[Slice]:
    """Terms of ``text``; raises on bounds that mix rows and percent or exceed 100 %."""
    terms = []
    for piece in text.split("+"):
        match = _TERM.match(piece)
        if match is None or not (match["name"] or "[" in piece):
            raise ValueError(f"not a split or slice: {piece!r}")
        given = [b for b in (match["lo"], match["hi"]) if b is not None]
        units = {b.endswith("%") for b in given}
        if len(units) > 1:
            raise ValueError(f"rows and percent in one slice: {piece!r}")
        percent = units == {True}
        lo, hi = (None if b is None else int(b.rstrip("%")) for b in (match["lo"], match["hi"]))
        if percent and any(abs(b) > 100 for b in (lo, hi) if b is not None):
            raise ValueError(f"percent beyond 100: {piece!r}")
        terms.append(Slice(match["name"], lo, hi, percent, match["rounding"] or "closest"))
    return terms


def _between(keys: Sequence[str], first: Sequence, last: Sequence) -> Column:
    """Row keys from ``first`` to ``last``, compared column by column.

    The condition on the leading column alone is implied; it is stated because that is
    what a scan can use to skip files and row groups.
    """
    leading = F.col(keys[0]).between(F.lit(first[0]), F.lit(last[0]))
    if len(keys) == 1:
        return leading
    return leading & _beyond(keys, first, Column.__gt__) & _beyond(keys, last, Column.__lt__)


def _beyond(keys: Sequence[str], bound: Sequence, compare) -> Column:
    """Equal to the bound, or on its far side in the first column that differs."""
    condition = F.lit(True)
    for name, value in reversed(list(zip(keys, bound))):
        here, edge = F.col(name), F.lit(value)
        condition = compare(here, edge) | ((here == edge) & condition)
    return condition


def ends_by_sort(df: DataFrame, order_by: Sequence[str]):
    """Row count of ``df``, and a function from positions to their order keys."""
    index = stage(global_index(df.select(*order_by), order_by, "_idx"), "slices")
    missing = index.where(reduce(Column.__or__, [F.col(c).isNull() for c in order_by])).count()
    if missing:
        raise ValueError(f"{missing} rows have no order key, so they cannot be sliced")

    def keys(wanted: Sequence[int]) -> dict[int, list]:
        rows = index.where(F.col("_idx").isin(list(wanted))).collect()
        return {r["_idx"]: [r[c] for c in order_by] for r in rows}

    return index.count(), keys


def ends_by_counting(df: DataFrame, order_by: Sequence[str], **options):
    """The same by counting passes over the order columns: nothing but small buckets is sorted.

    For whole numbers and texts; other keys are sorted. ``options`` are those of ``selection.keys_at``.
    """
    if not selectable(df, order_by):
        return ends_by_sort(df, order_by)
    missing = reduce(Column.__or__, [F.col(c).isNull() for c in order_by])
    leading = F.col(order_by[0])
    first = df.agg(F.count("*").alias("n"), F.count_if(missing).alias("none"), F.min(leading).alias("low"), F.max(leading).alias("high")).first()
    if first["none"]:
        raise ValueError(f"{first['none']} rows have no order key, so they cannot be sliced")
    bounds = first["n"], first["low"], first["high"]
    return first["n"], lambda wanted: keys_at(df.select(*order_by), order_by, wanted, bounds, **options)


def ends_by_files(df: DataFrame, order_by: Sequence[str], offsets: DataFrame | None = None):
    """The same for whole files ordered by (file, row): from the rows per file alone."""
    file, _ = order_by
    offsets = file_offsets(df, file) if offsets is None else offsets

    def keys(wanted: Sequence[int]) -> dict[int, list]:
        found = {}
        for w in wanted:
            inside = (F.col("_offset") <= w) & (F.col("_offset") + F.col("_n") > w)
            hit = offsets.where(inside).first()
            found[w] = [hit[file], w - hit["_offset"]]
        return found

    return offsets.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0], keys


def slice_rows(
    df: DataFrame,
    text: str,
    order_by: Sequence[str],
    term_col: str = "slice_term",
    ends=ends_by_counting,
) -> DataFrame:
    """Rows of ``df`` in the slices of ``text``, each tagged with its place in the list.

    The keys (unique, not NULL) at the slice ends, two rows per term, become ordinary range
    filters on ``df``, which reach the scan; the rows themselves are not shuffled.
    Overlapping terms repeat rows. ``ends`` finds those keys: by counting or sorting the order columns,
    or from the sizes of whole files.
    """
    terms = parse_slices(text)
    if all(t.lo is None and t.hi is None for t in terms):
        parts = [df.withColumn(term_col, F.lit(i)) for i in range(len(terms))]
        return reduce(DataFrame.unionByName, parts)
    n, keys_at = ends(df, order_by)
    ranges = [t.bounds(n) for t in terms]
    keys = keys_at(sorted({e for lo, hi in ranges if lo < hi for e in (lo, hi - 1)}))
    parts = []
    for i, (lo, hi) in enumerate(ranges):
        if lo < hi:
            inside = _between(order_by, keys[lo], keys[hi - 1])
        else:
            inside = F.lit(False)
        parts.append(df.where(inside).withColumn(term_col, F.lit(i)))
    return reduce(DataFrame.unionByName, parts)
