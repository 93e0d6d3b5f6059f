"""Bitmaps of bounded size over a table of long keys, for early filtering on the workers.

A key that is in the table always passes; another passes with a small chance, so
an exact join has to follow wherever that matters.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: log2 of the bits of each of the two bitmaps: about 32 bits a key, at most 32 MB.
LEAST_BITS, MOST_BITS = 18, 28
BLOCK = 4096  # bytes that Spark's bitmap functions put in a row


class KeyBitmaps:
    """Two bitmaps, over different bits of the keys; built by the executors."""

    def __init__(self, keys: DataFrame, column: str, n_keys: int):
        self.bits = min(MOST_BITS, max(LEAST_BITS, (n_keys * 32).bit_length()))
        mask = F.lit((1 << self.bits) - 1)
        self.held = []
        for place in (F.col(column).bitwiseAND(mask), F.shiftright(column, 30).bitwiseAND(mask)):
            at = keys.select((place + 1).alias("at"))
            rows = at.groupBy(F.bitmap_bucket_number("at").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("m")).collect()
            held = np.zeros(max(BLOCK, (1 << self.bits) // 8), np.uint8)
            for r in rows:
                held[(r["b"] - 1) * BLOCK : r["b"] * BLOCK] = np.frombuffer(r["m"], np.uint8)
            self.held.append(held)

    def passes(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.view(np.int64)
        mask = (1 << self.bits) - 1
        out = np.ones(len(keys), bool)
        for held, at in zip(self.held, (keys & mask, (keys >> 30) & mask)):
            out &= ((held[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
        return out
