"""Bitmaps of hashed keys, of one fixed size whatever the number of keys.

A bitmap keeps rows that cannot matter out of a shuffle. It may pass rows it need not, and passes all
of them when it is full, so whatever uses it is exact without it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap, as a power of two (4 MB).
MAP_BITS = 25


def bitmap(keys: DataFrame, key: str) -> np.ndarray:
    """A bit for each hashed key (a long column)."""
    place = F.pmod(F.col(key), F.lit(1 << MAP_BITS))
    numbered = keys.select(F.shiftright(place, 15).cast("int").alias("b"), (place.bitwiseAND(F.lit(32767))).alias("p"))
    out = np.zeros((1 << MAP_BITS) // 8, np.uint8)
    for r in numbered.groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits")).collect():  # 1,024 rows of 4 KB at most
        out[r["b"] * 4096 : (r["b"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys.view(np.int64) & ((1 << MAP_BITS) - 1)
    return ((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1).astype(bool)


def maybe(bits: np.ndarray):
    """A column function: whether a key may be in the bitmap."""

    @F.arrow_udf("boolean")
    def found(keys: pa.Array) -> pa.Array:
        return pa.array(in_bitmap(bits, keys.to_numpy(zero_copy_only=False)))

    return found
