"""A blocked Bloom filter of 64-bit keys for numpy: its size is bounded, so it can go to every task.

It only thins out what is exchanged. What it passes is decided exactly afterwards, so a
filter that fills up costs work and never changes a result."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 4
#: Blocks of 8 bytes: 32 MB at most, good for some 16 million keys.
MOST = 1 << 22


def sized(keys: int) -> int:
    """Blocks for so many keys at 16 bits each, a power of two, at most ``MOST``."""
    return min(MOST, 1 << max(10, (max(1, keys) // 4).bit_length()))


def build(keys: DataFrame, column: str, blocks: int) -> np.ndarray:
    """The filter of a column of longs; at most ``blocks`` rows come to the driver."""
    key = F.col(column)
    mask = F.lit(0).cast("long")
    for k in range(BITS):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.call_function("shiftrightunsigned", key, F.lit(6 * k)).bitwiseAND(63).cast("int")))
    block = F.call_function("shiftrightunsigned", key, F.lit(64 - (blocks.bit_length() - 1)))
    got = keys.select(block.cast("int").alias("block"), mask.alias("mask")).groupBy("block").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(blocks, np.uint64)
    out[got["block"].to_numpy()] = got["mask"].to_numpy().view(np.uint64)
    return out


def holds(sieve: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be in the filter."""
    keys = keys.view(np.uint64)
    mask = np.zeros(len(keys), np.uint64)
    for k in range(BITS):
        mask |= np.uint64(1) << ((keys >> np.uint64(6 * k)) & np.uint64(63))
    return (sieve[(keys >> np.uint64(64 - (len(sieve).bit_length() - 1))).astype(np.int64)] & mask) == mask
