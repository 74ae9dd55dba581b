"""Runs of words: stretches that repeat with a period, found through Lyndon roots.

Every run contains a Lyndon word of the length of its period, and that word is the longest Lyndon
word that begins at its place, under some order of the words or under the opposite one. The first
phase of Baier's suffix sorter groups suffixes by just that: it takes the groups from the highest to
the lowest, and appends the prefix of the group at hand to the nearest lower suffix on the left. When
a group's turn comes, its prefix is the longest Lyndon word at its members. So the phase is run twice,
and the second, which would sort the suffixes, is not needed. Longest common extensions of a Lyndon
word and the place after it, to both sides, give the run around it. They compare ranks of stretches
of 1, 2, 4, ... words, which are exact.

Only stretches in which a run can lie are grouped. In a run every gram of ``gram_words`` words stands
twice, so all of them are marked; a text's stretches of marked grams are joined, with separators that
are lower than every word under both orders, to one sequence for a block of texts. A separator cannot
be within a Lyndon word that begins before it, nor within an extension, since no two are equal.

Texts stay in the task that reads them: there is no shuffle, and memory is bounded by about 1 MiB of
texts, or by a single longer one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenprep.llm.words import Block, PrefixHash, blocks, mix64

MIN_WORDS = 24
MIN_PERIODS = 3
RUN = T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")])


def gram_words(min_words: int, min_periods: int) -> int:
    """Size of a gram of which every occurrence in a run has another one in it.

    A run of ``n`` words has ``n - size + 1`` grams; if those are at least two periods, one lies a period before or after.
    """
    return max(1, min_words * (min_periods - 2) // min_periods)


def repeated_grams(words: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Marks the grams of ``size`` words, by their first word, that occur twice in their text."""
    n = len(words) - size + 1
    marked = np.zeros(len(words), dtype=bool)
    if n <= 0:
        return marked
    text_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    total = np.zeros(n, dtype=np.uint64)
    for j, factor in enumerate(mix64(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)):
        total += words[j : j + n] * factor
    fits = np.flatnonzero(np.arange(n) + size <= first[1:][text_of[:n]])
    keys = mix64(total[fits]) ^ mix64(text_of[fits].astype(np.uint64))
    order = np.argsort(keys)
    same = np.zeros(len(order) + 1, dtype=bool)
    same[1:-1] = keys[order[1:]] == keys[order[:-1]]
    marked[fits[order[same[1:] | same[:-1]]]] = True
    return marked


def stretches(marked: np.ndarray, first: np.ndarray, least: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of each stretch of at least ``least`` marked grams of one text."""
    begins, ends = np.zeros(len(marked) + 1, dtype=bool), np.zeros(len(marked) + 1, dtype=bool)
    begins[first] = ends[first] = True
    begins[1:-1] |= ~marked[:-1]
    ends[1:-1] |= ~marked[1:]
    start, end = np.flatnonzero(begins[:-1] & marked), np.flatnonzero(ends[1:] & marked) + 1
    long = end - start >= least
    return start[long], end[long] + size - 1


def lyndon_lengths(ranks: list[int]) -> list[int]:
    """Length of the longest Lyndon word that begins at each position: the first phase of Baier's sorter.

    ``ranks`` are whole numbers from 0; what lies behind the end is lower than all of them.
    """
    n = len(ranks)
    groups = max(ranks, default=-1) + 1
    members: list[list[int]] = [[] for _ in range(groups)]
    for i, r in enumerate(ranks):
        members[r].append(i)
    group = list(ranks)
    prefix = [1] * groups  # length of the prefix that the members of a group share
    below = list(range(-1, groups - 1))
    above = [*range(1, groups), -1]
    length = [0] * n
    left = list(range(n + 1))  # position + 1 -> itself, or on the way to the nearest one not yet taken; 0: none
    at = groups - 1
    while at >= 0:
        taken = [i for i in members[at] if group[i] == at]
        size = prefix[at]
        for i in taken:
            length[i] = size
            left[i + 1] = i
        times: dict[int, int] = defaultdict(int)
        for i in taken:
            j = left[i]
            while left[j] != j:
                left[j] = left[left[j]]
                j = left[j]
            left[i + 1] = j
            if j:
                times[j - 1] += 1
        moved: dict[tuple[int, int], list[int]] = defaultdict(list)
        for j, count in times.items():
            moved[count, group[j]].append(j)
        for count, old in sorted(moved, reverse=True):
            new = len(members)
            members.append(moved[count, old])
            prefix.append(prefix[old] + count * size)
            over = above[old]
            below.append(old)
            above.append(over)
            above[old] = new
            below[over] = new
            for j in members[new]:
                group[j] = new
        members[at] = []
        at = below[at]
    return length


class Extensions:
    """Longest common extensions in a sequence, by the ranks of its stretches of 1, 2, 4, ... places.

    The levels end where no two stretches are equal, so an extension is a sum of different levels.
    """

    def __init__(self, symbols: np.ndarray):
        self.levels = [symbols.astype(np.int64)]
        while True:
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            if len(last) <= half:
                break
            pairs = last[:-half] * (int(last.max()) + 1) + last[half:]
            values, ranks = np.unique(pairs, return_inverse=True)
            if len(values) == len(pairs):
                break
            self.levels.append(ranks.astype(np.int64))

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many places agree from ``a`` and from ``b`` on (``a < b``)."""
        a, b, count = a.copy(), b.copy(), np.zeros(len(a), dtype=np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            count += self._step(k, a, b, 1 << k)
        return count

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many places agree before ``a`` and before ``b`` (``a < b``)."""
        a, b, count = a.copy(), b.copy(), np.zeros(len(a), dtype=np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            count += self._step(k, a, b, -(1 << k))
        return count

    def _step(self, k: int, a: np.ndarray, b: np.ndarray, by: int) -> np.ndarray:
        ranks = self.levels[k]
        low, high = (a, b) if by > 0 else (a + by, b + by)
        fits = np.flatnonzero((low >= 0) & (high < len(ranks)))
        same = fits[ranks[low[fits]] == ranks[high[fits]]]
        a[same] += by
        b[same] += by
        out = np.zeros(len(a), dtype=np.int64)
        out[same] = abs(by)
        return out


def block_runs(words: np.ndarray, first: np.ndarray, min_words: int, min_periods: int) -> np.ndarray:
    """Rows of (first word in the block, length, period) of the runs of all texts, by first word and period."""
    size = gram_words(min_words, min_periods)
    begin, end = stretches(repeated_grams(words, first, size), first, min_words - size + 1, size)
    if not len(begin):
        return np.zeros((0, 3), dtype=np.int64)
    sizes = end - begin + 1  # with a separator
    origin = np.repeat(begin - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    separator = np.cumsum(sizes) - 1
    inside = np.ones(len(origin), dtype=bool)
    inside[separator] = False
    values, ranks = np.unique(words[origin[inside]], return_inverse=True)
    extensions = np.empty(len(origin), dtype=np.int64)
    extensions[inside] = ranks
    extensions[separator] = len(values) + np.arange(len(separator))
    extend = Extensions(extensions)
    place = np.flatnonzero(inside)
    found = []
    for order in (ranks + 1, len(values) - ranks):
        symbols = np.zeros(len(origin), dtype=np.int64)
        symbols[inside] = order
        period = np.array(lyndon_lengths(symbols.tolist()), dtype=np.int64)[place]
        after, before = extend.forward(place, place + period), extend.backward(place, place + period)
        length = before + period + after
        long = length >= np.maximum(min_words, min_periods * period)
        found.append(np.stack([origin[place[long] - before[long]], length[long], period[long]], axis=1))
    runs = np.unique(np.concatenate(found), axis=0)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def collapsed(block: Block, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    kept = np.flatnonzero(keep)
    text = np.searchsorted(first, kept, side="right") - 1
    more = np.zeros(len(kept), dtype=bool)  # a kept word of the same text follows
    more[:-1] = text[1:] == text[:-1]
    edges = np.zeros(len(block.data) + 1, dtype=np.int8)
    edges[starts[kept]] += 1
    np.add.at(edges, ends[kept] + more, -1)
    chosen = np.cumsum(edges[:-1]).astype(bool)
    data = block.data.copy()
    data[ends[kept[more]]] = 0x20
    counts = np.concatenate([[0], np.cumsum(chosen)])
    offsets = counts[block.offsets].astype(np.int64)
    buffers = [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[chosen].tobytes())]
    return pa.Array.from_buffers(pa.large_string(), len(block.offsets) - 1, buffers).cast(pa.string())


def find_runs(
    docs: DataFrame,
    text_col: str = "text",
    min_words: int = MIN_WORDS,
    min_periods: int = MIN_PERIODS,
) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` and ``collapsed``.

    ``runs`` are the stretches of at least ``min_words`` words and ``min_periods`` (2 or more) times their smallest
    period that no neighbouring word extends: start (the first word is 0), length and period, by start and period.
    ``collapsed`` are the words left, joined by one space, when each run keeps its first period; a word goes
    if it lies behind the first period of any run.

    A NULL or empty text has no words, no runs and an empty ``collapsed``. Rows are treated one by one, so repeated ones stay.
    Input columns named like one of the three results (in any case) are replaced; all others pass unchanged.
    Words are compared by 64-bit hashes.
    """
    if min_periods < 2 or min_words < 2:
        raise ValueError("a run has at least two words and two periods")
    results = ("n_words", "runs", "collapsed")
    rest = [c for c in docs.columns if c.lower() not in results]
    schema = T.StructType(
        [
            *docs.select(*[F.col(f"`{c}`") for c in rest]).schema.fields,
            T.StructField("n_words", T.LongType(), False),
            T.StructField("runs", T.ArrayType(RUN, False), False),
            T.StructField("collapsed", T.StringType(), False),
        ]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "_runs_text"):
            starts, ends, first = block.words()
            words = PrefixHash(block.data).ranges(starts, ends)
            found = block_runs(words, first, min_words, min_periods)
            begin, length, period = found.T
            edges = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(edges, begin + period, 1)
            np.add.at(edges, begin + length, -1)
            keep = np.cumsum(edges[:-1]) == 0
            text = np.searchsorted(first, begin, side="right") - 1
            bounds = np.searchsorted(text, np.arange(len(first)))
            parts = [pa.array(x) for x in (begin - first[text], length, period)]
            runs = pa.StructArray.from_arrays(parts, fields=[pa.field(c, pa.int64(), False) for c in ("start", "length", "period")])
            columns = [block.rows.column(i) for i in range(len(rest))]
            yield pa.RecordBatch.from_arrays(
                [
                    *columns,
                    pa.array(np.diff(first).astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), runs),
                    collapsed(block, starts, ends, first, keep),
                ],
                names=schema.names,
            )

    numbered = [F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(rest)]  # no name can clash, nor hold a dot
    return docs.select(*numbered, F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_runs_text")).mapInArrow(run, schema)
