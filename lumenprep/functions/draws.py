"""Seeded draws per row.

A draw depends only on (seed, key, salt), never on partitioning, so it is the same
after a retry, a repartition or in another engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 52  # 13 hex digits of the md5: exact in a double


def hash52(key: Column, seed: int, salt: str) -> Column:
    """Integer in [0, 2^52), uniform over keys."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), F.lit(salt)))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("bigint")


def u01(key: Column, seed: int, salt: str) -> Column:
    """Uniform double in [0, 1)."""
    return hash52(key, seed, salt) / F.lit(float(1 << HASH_BITS))


def gate(key: Column, seed: int, salt: str, probability: float) -> Column:
    """True for a share ``probability`` of the keys."""
    return u01(key, seed, salt) < F.lit(float(probability))


def pick(key: Column, seed: int, salt: str, n: Column | int) -> Column:
    """Uniform position in [0, n)."""
    size = n if isinstance(n, Column) else F.lit(n)
    return F.floor(u01(key, seed, salt) * size.cast("double")).cast("bigint")
