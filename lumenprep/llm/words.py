"""Words and their hashes for blocks of whole texts, with numpy inside Arrow batches.

A word is a run of bytes outside space and tab to carriage return. Its 64-bit hash comes
from prefix sums of a polynomial over the bytes of the block, so that no Python object is
made per word. The hash is fixed: the same word gives the same value in every process.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
BLOCK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def byte_values(lower: bool) -> np.ndarray:
    """A random odd value for each byte; A-Z share those of a-z if ``lower``."""
    values = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
    if lower:
        values[65:91] = values[97:123]
    return values


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, up to the n-th."""
    if len(_powers.get("up", ())) < n:
        size = max(n, BLOCK_BYTES + 1)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


class PrefixHash:
    """Hashes of any byte ranges of one block."""

    def __init__(self, data: np.ndarray, lower: bool = False):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(byte_values(lower)[data] * up[: len(data)], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, k: int) -> np.ndarray:
        """Hash of every range of ``k`` bytes, by its start."""
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        return mix64((self.sums[k:] - self.sums[:n]) * self.down[:n])


@dataclass
class Block:
    """Consecutive texts: their bytes, and where each begins (one more entry than texts)."""

    rows: pa.RecordBatch
    data: np.ndarray
    offsets: np.ndarray

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte of each word, and the first word of each text."""
        n = len(self.data)
        full = ~_SPACE[self.data]
        first = np.zeros(n + 1, dtype=bool)
        first[self.offsets] = True
        begins = full.copy()
        ends = full.copy()
        if n:
            begins[1:] &= ~full[:-1] | first[1:n]
            ends[:-1] &= ~full[1:] | first[1:n]
        starts = np.flatnonzero(begins)
        return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, self.offsets)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of texts; NULL counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def blocks(batches: Iterable[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut batches into blocks of whole texts of about ``limit`` bytes; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
        row = 0
        while row < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
            last = min(max(last, row + 1), batch.num_rows)
            part = offsets[row : last + 1]
            yield Block(batch.slice(row, last - row), data[part[0] : part[-1]], part - part[0])
            row = last
