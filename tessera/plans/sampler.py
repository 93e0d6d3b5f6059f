"""The whole pipeline from map tables to splats, renders and scores. ``image_id`` is a key: one call serves a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import aggregates as A
from tessera.operators import merge as M
from tessera.operators import render as R
from tessera.operators.nearest import scratch

MAPS = ("lc_xx", "lc_xy", "lc_yy", "map_r", "map_g", "map_b")


def initial_splats(maps: DataFrame, counts: DataFrame, width: int, height: int) -> DataFrame:
    """The splats of each image: placed by equal mass, with attributes looked up in the maps. ``counts`` has image_id, n, n_auto and seed; splats are smaller where n is more than n_auto."""
    asked = maps.join(counts.select("image_id", F.col("n").alias("__n")), "image_id")
    density = A.sampling_density(asked, F.col("__n")).withColumn("density", F.col("sampling"))
    placed = M.equal_mass_voronoi(density, counts.select("image_id", "n", "seed"), width, height)
    held = R.bilinear(placed.select("image_id", "idx", "x", "y", "weight"), maps, list(MAPS), width, height).join(counts.select("image_id", F.col("n").alias("__n"), "n_auto"), "image_id")
    shift = S.count_shift(F.col("n_auto").cast("double"), F.col("__n").cast("double"))
    return held.select("image_id", "idx", "x", "y", (F.col("lc_xx") + shift).alias("lc_xx"), "lc_xy", (F.col("lc_yy") + shift).alias("lc_yy"), *[S.clamp(F.col(f"map_{c}"), 0.0, 1.0).alias(c) for c in "rgb"], "weight")


def counts_of(maps: DataFrame, width: int, height: int, count: int | DataFrame | None = None, count_scale: float = 1.0, seed: int = 12345) -> DataFrame:
    """(image_id, n, n_auto, seed) of each image: its own rates' count times ``count_scale``, one ``count`` for all, or those of a table (image_id, n and, if wanted, seed)."""
    images = maps.select("image_id").distinct()
    if count is None:
        held = A.auto_counts(maps, width, height).select("image_id", F.greatest(F.lit(1), F.floor(F.col("rate_sum") * count_scale)).cast("long").alias("n"))
    elif isinstance(count, int):
        held = images.withColumn("n", F.lit(count).cast("long"))
    else:
        held = images.join(count, "image_id")
    own = F.col("seed").cast("long") if "seed" in held.columns else F.lit(seed).cast("long")
    return scratch(held.select("image_id", F.col("n").cast("long").alias("n"), F.col("n").cast("long").alias("n_auto"), own.alias("seed")), "counts")


def sample(maps: DataFrame, image: DataFrame, width: int, height: int, deltas: DataFrame | Callable, count: int | DataFrame | None = None, count_scale: float = 1.0, seed: int = 12345, states: int = 7, renderer=None, target_psnr: float | None = None, least_gain: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(splats of every state, scores of every state).

    ``maps`` has image_id, pix, x, y, density, the six of ``MAPS`` and, unless
    ``count`` is given, logit, whose rates sum to the count. Images of a call may
    have counts and seeds of their own, see :func:`counts_of`. Networks are not part
    of this: what they would give is ``maps`` and ``deltas``.
    """
    counts = counts_of(maps, width, height, count, count_scale, seed)
    splats = scratch(initial_splats(maps, counts, width, height), "splats")
    return R.correction_rounds(splats, image, deltas, states, width, height, target_psnr, least_gain, renderer)


def label_states(states: DataFrame) -> DataFrame:
    """``states`` with the name of each: initializer, then refinement 1, 2, ..."""
    return states.withColumn("label", F.when(F.col("k") == 0, "initializer").otherwise(F.concat(F.lit("refinement "), F.col("k"))))
