"""Seeded, engine-independent pseudo-random values from row keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_md5(seed: int, *keys: Column) -> Column:
    """``md5("<seed>:<key>:...")`` in hex: the same for a key wherever its row lies."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def uniform(seed: int, *keys: Column) -> Column:
    """A double in [0, 1) from the leading 52 bits of the seeded md5."""
    bits = F.conv(F.substring(seeded_md5(seed, *keys), 1, 13), 16, 10).cast("bigint")
    return bits.cast("double") / F.lit(float(2**52))
