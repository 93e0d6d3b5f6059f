"""Seeded weighted sampling of points from a density: tile masses, systematic rounding, a race within each tile."""

from __future__ import annotations

from collections.abc import Iterator
from math import floor, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import hashing as H
from tessera.functions import scalars as S
from tessera.operators.grid import tile_of
from tessera.operators.scan import running
from tessera.operators.select import mark_least
from tessera.session import scratch

# Steps of the low-discrepancy offsets.
STEP_X, STEP_Y = 0.7548776662466927, 0.5698402909980532
ROUNDING = 1e-12
#: Tiles of an image, unless its size says how many: how deep the prefix sums go.
MOST_TILES = 1 << 20


def half_up(v: float) -> int:
    return floor(v + 0.5)


def tile_size(width: int, height: int, n: int, most: int | None = 32) -> int:
    spacing = sqrt(width * height / max(1.0, n))
    size = max(4, min(min(width, height), half_up(4 * spacing)))
    return size if most is None else max(4, min(size, most))


def offset_of(seed: int) -> float:
    return float(H.unit(seed, np.array([H.SALT_OFFSET]))[0])


def draws(plan: DataFrame, width: int, height: int, tile: int | None = None) -> DataFrame:
    """``plan`` (image_id, n, seed) with what the draws of an image need: tile size, shifts of the tile grid, offset of the rounding."""

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes = [tile or tile_size(width, height, n) for n in pdf["n"]]
            shifts = [H.tile_shifts(int(s), t) for s, t in zip(pdf["seed"], sizes)]
            yield pdf.assign(size=sizes, shift_y=[y for y, _ in shifts], shift_x=[x for _, x in shifts], offset=[offset_of(int(s)) for s in pdf["seed"]])

    return plan.select("image_id", F.col("n").cast("long").alias("n"), F.col("seed").cast("long").alias("seed")).mapInPandas(drawn, "image_id long, n long, seed long, size int, shift_y int, shift_x int, offset double")


def tile_counts(tiles: DataFrame, n: int | Column, offset: float | Column, most: int = MOST_TILES) -> DataFrame:
    """Points for each tile (image_id, tile, mass), ``n`` in all: differences of rounded prefix sums, then single repairs.

    A repair goes to the tiles with the largest residuals (or the smallest, to
    take points away), one each, ties to the lower tile. Images without mass deal
    evenly. Prefix sums go by blocks of tiles, of which an image has up to ``most``;
    the tiles for repairs are selected by radix, and only if there are any.
    """
    n, offset = (F.lit(v) if isinstance(v, (int, float)) else v for v in (n, offset))
    dealt = scratch(tiles.select("image_id", "tile", "mass", n.cast("long").alias("goal"), offset.cast("double").alias("offset")), "tiles")
    totals = dealt.groupBy("image_id").agg(F.sum("mass").alias("total"), F.count(F.lit(1)).alias("n_tiles"))
    t = running(dealt, ["image_id"], "tile", {"cum": (F.sum, F.col("mass")), "i": (F.sum, F.lit(1))}, most).join(totals, "image_id")
    goal = F.col("goal").cast("double")
    scale = F.when(F.col("total") > 0, goal / F.when(F.col("total") > 0, F.col("total")))
    even = goal / F.col("n_tiles")
    t = t.withColumn("edge", F.floor(F.coalesce(F.col("cum") * scale, even * F.col("i")) + F.col("offset") + ROUNDING))
    share = F.coalesce(F.col("mass") * scale, even)
    t = running(t.withColumn("residual", share - F.floor(share)), ["image_id"], "tile", {"before": (F.max, F.col("edge"))}, most, exclusive=True)
    t = scratch(t.withColumn("base", F.greatest(F.lit(0), F.col("edge") - F.coalesce("before", F.floor("offset")))).select("image_id", "tile", "mass", "goal", "base", "residual"), "edges")
    missing = t.groupBy("image_id").agg((F.first("goal") - F.sum("base")).alias("missing")).where("missing <> 0")
    fixed = F.lit(0)
    if not missing.isEmpty():
        ranks = {"__up": -F.col("residual"), "__down": F.when(F.col("base") > 0, F.col("residual")).otherwise(2.0)}  # residuals are under 1: what can't lose comes last
        t = scratch(t.withColumns(ranks), "residuals")
        for name, need in (("__up", F.col("missing")), ("__down", -F.col("missing"))):
            t = mark_least(t, ["image_id"], name, "tile", missing.select("image_id", need.alias("need")), f"{name}_taken")
        fixed = F.when(F.col("__up_taken"), 1).when(F.col("__down_taken") & (F.col("base") > 0), -1).otherwise(0)
    return t.select("image_id", "tile", "mass", (F.col("base") + fixed).cast("int").alias("n_points"))


def sample_points(pixels: DataFrame, n: int | DataFrame, width: int, height: int, seed: int = 12345, tile: int | None = None, extra_step: bool = False, skip_blank: bool = False) -> DataFrame:
    """``n`` points (image_id, idx, x, y) of each image from ``pixels`` (image_id, pix, x, y, density).

    ``n`` is a number for all images, drawn with ``seed``, or a table (image_id, n,
    seed). Within a tile the pixels with the highest ln(u) / density are taken, as
    many as the tile has points; pixels without density come last, or with
    ``skip_blank`` only in tiles that have nothing else. Points lie inside
    their pixel at a seeded place; a tile with more points than pixels uses its
    pixels again, at other places.
    """
    plan = n if isinstance(n, DataFrame) else pixels.select("image_id").distinct().select("image_id", F.lit(n).alias("n"), F.lit(seed).cast("long").alias("seed"))
    plan = draws(plan, width, height, tile)
    pixels = pixels.select("image_id", "pix", "x", "y", S.positive_or_zero(F.col("density")).alias("density")).join(plan.withColumnRenamed("n", "__n"), "image_id")
    tiled = pixels.withColumn("tile", tile_of(F.col("x"), F.col("y"), width, height, F.col("size"), F.col("shift_y"), F.col("shift_x")))
    masses = tiled.groupBy("image_id", "tile").agg(F.sum("density").alias("mass"), F.first("__n").alias("__n"), F.first("offset").alias("offset"))
    counts = tile_counts(masses, F.col("__n"), F.col("offset"), width * height)
    blank_images = counts.groupBy("image_id").agg((F.sum("mass") <= 0).alias("even"))
    counts = running(counts, ["image_id"], "tile", {"first": (F.sum, F.col("n_points"))}, width * height).withColumn("first", F.col("first") - F.col("n_points")).join(blank_images, "image_id")
    u = H.unit_hash(F.col("seed"), F.col("pix") + H.SALT_RANK, extra_step)
    w = F.when(F.col("even"), 1.0).otherwise(F.col("density"))
    blank = H.unit_hash(F.col("seed"), F.col("pix") + H.SALT_ZERO, extra_step) - 1.0
    priority = F.when(w > 0, F.log(F.greatest(u, F.lit(1e-300))) / F.when(w > 0, w)).otherwise(blank)
    raced = tiled.join(counts.select("image_id", "tile", "n_points", "even", "first"), ["image_id", "tile"]).where("n_points > 0").withColumn("priority", priority)
    in_tile = W.partitionBy("image_id", "tile")
    if skip_blank:
        some = F.col("even") | (F.col("density") > 0)
        raced = raced.withColumn("__some", F.max(some).over(in_tile)).where(some | ~F.col("__some")).drop("__some")
    ranked = raced.withColumns({"rank": F.row_number().over(in_tile.orderBy(F.desc("priority"), "pix")) - 1, "cells": F.count(F.lit(1)).over(in_tile)})
    taken = ranked.where(F.col("rank") < F.col("n_points"))
    take = F.least("cells", "n_points")
    again = F.floor((F.col("n_points") - 1 - F.col("rank")) / take).cast("int")  # how often the pixel is used once more
    again = F.when(F.col("n_points") > F.col("cells"), again).otherwise(0)
    spots = taken.withColumn("take", take).select("*", F.explode(F.sequence(F.lit(0), again)).alias("use"))
    ox = 0.25 + 0.5 * H.unit_hash(F.col("seed"), F.col("pix").cast("long") * 2 + H.SALT_X, extra_step)
    oy = 0.25 + 0.5 * H.unit_hash(F.col("seed"), F.col("pix").cast("long") * 2 + H.SALT_Y, extra_step)
    spots = spots.withColumns({"ox": ox, "oy": oy, "slot": F.col("rank") + (F.col("use") - 1) * F.col("take") + 1})
    fract = lambda v: v - F.floor(v)
    place = lambda o, step: F.when(F.col("use") == 0, F.col(o)).otherwise(0.1 + 0.8 * fract(F.col(o) + F.col("slot") * step))
    idx = F.col("first") + F.when(F.col("use") == 0, F.col("rank")).otherwise(F.col("take") + F.col("slot") - 1)
    return spots.select("image_id", idx.cast("int").alias("idx"), ((F.col("x") + place("ox", STEP_X)) / width).alias("x"), ((F.col("y") + place("oy", STEP_Y)) / height).alias("y"))
