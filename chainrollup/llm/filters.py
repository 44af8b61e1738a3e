"""Sets of 64-bit hashes that every task can hold: bitmaps whose size follows the number of hashes up to a bound, and
exact lists of the few that are frequent. Beyond the bound there is no bitmap, and the caller joins by hash instead."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW_BITS = 32768  # of one row of bitmap_construct_agg
BITS = 30  # log2 of the largest bitmap: 128 MB


def bitmap(hashes: DataFrame, n: int, most: int = BITS, column: str = "h") -> np.ndarray | None:
    """A bitmap of the low bits of `n` hashes, at least eight bits for each; None if it would have over 2 ** most bits."""
    bits = max(15, (8 * n).bit_length())
    if bits > most:
        return None
    slot = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    rows = hashes.select(slot.alias("slot")).groupBy(F.expr(f"slot div {ROW_BITS}").alias("part")).agg(F.expr(f"bitmap_construct_agg(slot % {ROW_BITS})").alias("bits")).collect()
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in rows:
        out[r["part"] * (ROW_BITS // 8) : (r["part"] + 1) * (ROW_BITS // 8)] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def holds(bits: np.ndarray | None, h: np.ndarray) -> np.ndarray:
    """Which hashes may be in the set (all, without a bitmap)."""
    if bits is None:
        return np.ones(len(h), bool)
    slot = (h & np.uint64(8 * len(bits) - 1)).astype(np.int64)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0


def frequent(counted: DataFrame, over: int, most: int = 1 << 20) -> np.ndarray:
    """counted: h, n. The sorted hashes with n > over, or over the smallest over * 2 ** k that at most `most` exceed."""
    levels = {r["k"]: r["rows"] for r in counted.where(F.col("n") > over).groupBy(F.floor(F.log2((F.col("n") - 1) / over)).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("rows")).collect()}  # 64 rows at most
    k = 0
    while sum(v for level, v in levels.items() if level >= k) > most:
        k += 1
    got = counted.where(F.col("n") > over << k).select("h").toArrow().column("h").to_numpy() if levels else np.empty(0, np.int64)
    return np.sort(got.view(np.uint64))


def among(listed: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes are in a sorted list."""
    if not len(listed):
        return np.zeros(len(h), bool)
    return listed[np.minimum(np.searchsorted(listed, h), len(listed) - 1)] == h
