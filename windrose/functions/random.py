"""Seeded, partition-independent pseudo-randomness from hashes of keys.

``rand()`` depends on partitioning and task retries; a hash of (seed, key) does not, so a lost executor or another
cluster size never changes a draw.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_hash(seed: int, *parts: Column) -> Column:
    """Hex digest of the seed and the parts; sorting by it is a random order."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def seeded_int(seed: int, *parts: Column) -> Column:
    """Uniform integer in [0, 2^32)."""
    return F.conv(F.substring(seeded_hash(seed, *parts), 1, 8), 16, 10).cast("long")


def seeded_uniform(seed: int, *parts: Column) -> Column:
    """Uniform double in [0, 1)."""
    return seeded_int(seed, *parts) / F.lit(4294967296.0)
