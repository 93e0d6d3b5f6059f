"""Seeded hashes. Unsigned 64-bit arithmetic needs numpy, so these are Arrow-batched UDFs."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The constants of splitmix64, and the salts of the draws.
GOLDEN, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
SALT_OFFSET, SALT_RANK, SALT_ZERO, SALT_X, SALT_Y, SHIFT_SEED = 101, 1000003, 2000003, 3000003, 3000004, 0xA24BAED4963EE407
MASK = (1 << 64) - 1


def scramble(v: np.ndarray) -> np.ndarray:
    v = (v ^ (v >> np.uint64(30))) * np.uint64(MIX_A)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(MIX_B)
    return v ^ (v >> np.uint64(31))


def unit(seed: int, salt: np.ndarray, extra_step: bool = False) -> np.ndarray:
    """Numbers in [0, 1); ``extra_step`` is the variant that adds the golden constant once more."""
    steps = salt.astype(np.uint64) + np.uint64(2 if extra_step else 1)
    return (scramble(np.uint64(seed & MASK) + np.uint64(GOLDEN) * steps) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def unit_hash(seed: int | Column, salt: Column, extra_step: bool = False) -> Column:
    """A number in [0, 1) for each salt, of one seed or of the row's own; null for a null salt."""

    @F.pandas_udf("double")
    def draw(seeds: pd.Series, s: pd.Series) -> pd.Series:
        held = s.fillna(0).to_numpy(np.int64)
        steps = held.astype(np.uint64) + np.uint64(2 if extra_step else 1)
        start = seeds.to_numpy(np.int64).astype(np.uint64)
        drawn = (scramble(start + np.uint64(GOLDEN) * steps) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        return pd.Series(drawn).where(s.notna().to_numpy())

    return draw(F.lit(seed).cast("long") if isinstance(seed, int) else seed.cast("long"), salt.cast("long"))


def tile_shifts(seed: int, tile: int) -> tuple[int, int]:
    """The shift of the tile grid in y and x."""
    state, out = (seed & MASK) ^ SHIFT_SEED, []
    for _ in range(2):
        state = (state + GOLDEN) & MASK
        out.append(int(scramble(np.array([state], np.uint64))[0]) % tile)
    return out[0], out[1]


def key_seed(base: int, key: Column) -> Column:
    """A 31-bit seed for a key."""

    @F.pandas_udf("long")
    def seeds(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: None if k is None else int.from_bytes(hashlib.blake2b(f"{base}\0{k}".encode(), digest_size=8, person=b"gaussify").digest(), "little") & 0x7FFFFFFF)

    return seeds(key)


def content_seed(shape: tuple[int, ...], values: np.ndarray, base: int = 0) -> int:
    """A 31-bit seed from an image's shape and its values, rounded to bytes."""
    rounded = np.round(np.clip(values.astype(np.float32), 0, 1) * np.float32(255)).astype(np.uint8)
    parts = (str(base).encode(), str(tuple(int(v) for v in shape)).encode(), rounded.tobytes())
    return int.from_bytes(hashlib.blake2b(b"\0".join(parts), digest_size=8, person=b"gaussify").digest(), "little") & 0x7FFFFFFF


def content_seeds(pixels, width: int, height: int, base: int = 0):
    """(image_id, seed): the content seed of each image of ``pixels`` (image_id, pix, r, g, b) as a [3, height, width] array."""

    def seed(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf.sort_values("pix")[["r", "g", "b"]].to_numpy(np.float32).T.reshape(3, height, width)
        return pd.DataFrame({"image_id": [pdf["image_id"].iloc[0]], "seed": [content_seed(values.shape, values, base)]})

    return pixels.select("image_id", "pix", "r", "g", "b").groupBy("image_id").applyInPandas(seed, "image_id long, seed long")
