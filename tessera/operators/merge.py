"""Greedy merging of light cells into neighbours, polishing, and the equal-mass placement built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import aggregates as A
from tessera.operators import nearest as N
from tessera.operators import sampling as P
from tessera.operators.scan import running
from tessera.operators.select import mark_least
from tessera.session import settled

FRACTION, ROUNDS, OVERSAMPLE, NEIGHBOURS, POLISH = 1 / 3, 2, 1.5, 8, 3
#: Points of an image, unless it is known how many: how deep running counts go.
MOST = 1 << 20


def merge_plan(n_now: int, n: int, rounds: int = ROUNDS, fraction: float = FRACTION, last_takes_all: bool = True) -> list[int]:
    """How many points each round removes."""
    out = []
    for k in range(rounds):
        excess = max(0, n_now - n)
        remove = min(excess, max(1, int(n_now * fraction)))
        if last_takes_all and k == rounds - 1:
            remove = excess
        out.append(remove)
        n_now -= remove
    return out


def oversample_count(n: int, profile: str = "fused") -> int:
    """Points to start from: half away from zero (fused), half to even (reference), or rounded up (web)."""
    if profile == "web":
        return max(n, int(-(-n * 3 // 2)))
    return max(n + 1, P.half_up(n * OVERSAMPLE) if profile == "fused" else round(n * OVERSAMPLE))


def oversampled(n: Column, profile: str = "fused") -> Column:
    """:func:`oversample_count` of a column."""
    if profile == "web":
        return F.greatest(n, F.ceil(n * OVERSAMPLE)).cast("long")
    return F.greatest(n + 1, F.floor(n * OVERSAMPLE + 0.5) if profile == "fused" else F.rint(n * OVERSAMPLE)).cast("long")


def removal(n_now: Column, n: Column, last: bool) -> Column:
    """How many points a round removes, as :func:`merge_plan` counts them."""
    excess = F.greatest(F.lit(0), n_now - n)
    return (excess if last else F.least(excess, F.greatest(F.lit(1), F.floor(n_now * FRACTION + 1e-9)))).cast("long")


def match_round(cells: DataFrame, table: DataFrame, remove: DataFrame | int) -> DataFrame:
    """(image_id, idx, target) of the cells that merge. ``remove`` is a number, or a table (image_id, remove).

    The ``remove`` lightest cells of an image (ties to the least idx) propose to
    their neighbours in ``table`` in turn, one rank a round; of the proposals to one cell the
    lightest wins, and the others try their next neighbour. A cell that has merged
    takes no more proposals.
    """
    need = cells.select("image_id").distinct().withColumn("need", F.lit(remove)) if isinstance(remove, int) else remove.select("image_id", F.col("remove").alias("need"))
    free = mark_least(cells.select("image_id", "idx", "mass"), ["image_id"], "mass", "idx", need).where("taken")
    asks = settled(table.join(free.select("image_id", F.col("idx").alias("src"), "mass"), ["image_id", "src"]).select("image_id", "src", "dst", "rank", "mass"), "asks")
    merged = None
    for rank in range(NEIGHBOURS):
        now = asks.where(F.col("rank") == rank)
        if merged is not None:
            for end in ("src", "dst"):
                now = now.join(merged.select("image_id", F.col("idx").alias(end)), ["image_id", end], "left_anti")
        won = now.groupBy("image_id", "dst").agg(F.min(F.struct("mass", "src")).alias("best"))
        won = settled(won.select("image_id", F.col("best.src").alias("idx"), F.col("dst").alias("target")), "won")
        merged = won if merged is None else merged.unionByName(won)
    return merged


def merge_into(cells: DataFrame, merged: DataFrame, most: int = MOST) -> DataFrame:
    """Survivors at the mass-weighted mean of themselves and what merged into them, numbered anew in order."""
    root = cells.join(merged, ["image_id", "idx"], "left").withColumn("to", F.coalesce("target", "idx"))
    sums = root.groupBy("image_id", "to").agg(F.sum("mass").alias("m"), F.sum(F.col("mass") * F.col("x")).alias("mx"), F.sum(F.col("mass") * F.col("y")).alias("my"))
    alive = cells.join(merged.select("image_id", "idx"), ["image_id", "idx"], "left_anti").join(sums.withColumnRenamed("to", "idx"), ["image_id", "idx"])
    some = F.col("m") > A.EMPTY
    mean = lambda s, c: F.when(some, F.col(s) / F.when(some, F.col("m"))).otherwise(F.col(c))
    return renumber(settled(alive.select("image_id", "idx", mean("mx", "x").alias("x"), mean("my", "y").alias("y")), "alive"), most)


def renumber(points: DataFrame, most: int = MOST) -> DataFrame:
    """``points`` with idx from 0 without gaps, in the old order."""
    return running(points, ["image_id"], "idx", {"__i": (F.sum, F.lit(1))}, most).withColumn("idx", (F.col("__i") - 1).cast("int")).drop("__i")


def drop_empty(cells: DataFrame, most: Column | int, most_idx: int = MOST) -> DataFrame:
    """Without up to ``most`` cells of no mass, in order of idx; at least one cell of an image stays."""
    empty = F.col("mass") <= A.EMPTY
    sizes = cells.groupBy("image_id").agg(F.count(F.lit(1)).alias("__n"))
    placed = running(cells, ["image_id"], "idx", {"__rank": (F.sum, empty.cast("int"))}, most_idx).join(sizes, "image_id")
    most = F.lit(most) if isinstance(most, int) else most
    return placed.where(~(empty & (F.col("__rank") <= F.least(most, F.col("__n") - 1)))).drop("__rank", "__n")


def _cells(pixels: DataFrame, points: DataFrame, width: int, height: int, n: int) -> tuple[DataFrame, DataFrame]:
    owned = settled(N.assign_nearest(pixels, points, width, height, n), "owned")
    return owned, A.cell_mass(points.select("image_id", "idx", "x", "y"), owned)


def _excess(points: DataFrame, goals: DataFrame) -> DataFrame:
    """(image_id, remove) of the images that still have more points than their goal."""
    left = points.groupBy("image_id").agg(F.count(F.lit(1)).alias("__left")).join(goals, "image_id")
    return settled(left.select("image_id", (F.col("__left") - F.col("goal")).cast("long").alias("remove")).where("remove > 0"), "excess")


def merge_round(pixels: DataFrame, points: DataFrame, remove: int | DataFrame, n_now: int, width: int, height: int) -> DataFrame:
    """Remove exactly ``remove`` points of each image and keep the mass: empty cells first, then matches, then forced merges.

    ``remove`` is a number, or a table (image_id, goal) of how many points are to be
    left; ``n_now``, the points of an image, only sizes the search. Every image goes
    through the steps it needs, whatever the others need.
    """
    if isinstance(remove, int):
        goals = points.groupBy("image_id").agg((F.count(F.lit(1)) - remove).alias("goal"))
    else:
        goals = remove.select("image_id", "goal")
    over = _excess(points, goals)
    if over.isEmpty():
        return points
    owned, cells = _cells(pixels, points, width, height, n_now)
    excess = settled(cells.join(over, "image_id", "left").fillna(0, ["remove"]), "excess")
    kept = settled(renumber(drop_empty(excess, F.col("remove"), n_now).select("image_id", "idx", "x", "y"), n_now), "kept")
    left = _excess(kept, goals)
    if left.isEmpty():
        return kept
    owned, cells = _cells(pixels, kept, width, height, n_now)
    table = N.lightest_neighbours(N.adjacency(owned), cells, NEIGHBOURS)
    cells = settled(cells, "cells")
    matched = match_round(cells, table, left)
    points = settled(merge_into(cells, matched, n_now), "merged")
    left = _excess(points, goals)
    if left.isEmpty():
        return points
    owned, cells = _cells(pixels, points, width, height, n_now)
    state = mark_least(cells, ["image_id"], "mass", "idx", left.select("image_id", F.col("remove").alias("need"))).withColumn("alive", ~F.col("taken"))
    sources = state.where("not alive")
    table = N.lightest_neighbours(N.adjacency(owned), cells, NEIGHBOURS)
    alive = state.where("alive").select("image_id", F.col("idx").alias("dst"))
    beside = table.join(alive, ["image_id", "dst"]).groupBy("image_id", F.col("src").alias("idx")).agg(F.min(F.struct("rank", F.col("dst").alias("target"))).alias("b")).select("image_id", "idx", F.col("b.target").alias("target"))
    beside = sources.select("image_id", "idx").join(beside, ["image_id", "idx"])
    stuck = sources.join(beside, ["image_id", "idx"], "left_anti")
    forced = beside if stuck.isEmpty() else beside.unionByName(N.nearest_alive(stuck, state, n_now))
    return settled(merge_into(cells, forced, n_now), "forced")


def polish(pixels: DataFrame, points: DataFrame, n: int, width: int, height: int, steps: int = POLISH) -> DataFrame:
    """Move every point to its cell's centroid, ``steps`` times."""
    for _ in range(steps):
        owned = N.assign_nearest(pixels, points, width, height, n)
        points = settled(A.lloyd_centroids(points.select("image_id", "idx", "x", "y"), owned, width, height), "polished")
    return points


def equal_mass_voronoi(pixels: DataFrame, n: int | DataFrame, width: int, height: int, seed: int = 12345, rounds: int = ROUNDS) -> DataFrame:
    """``n`` points of each image (image_id, idx, x, y, mass, n_pixels, weight) whose nearest-point cells have nearly equal mass.

    ``pixels`` has image_id, pix, x, y and density. ``n`` is one count for all
    images, or a table (image_id, n and, if wanted, seed). Each image comes out as
    it would alone. The count is exact or an error.
    """
    pixels = settled(pixels.select("image_id", "pix", "x", "y", "density"), "pixels")
    if isinstance(n, int):
        plan = pixels.select("image_id").distinct().withColumn("n", F.lit(n).cast("long"))
    else:
        plan = n.select("image_id", F.col("n").cast("long").alias("n"), *([F.col("seed").cast("long").alias("seed")] if "seed" in n.columns else []))
    plan = plan if "seed" in plan.columns else plan.withColumn("seed", F.lit(seed).cast("long"))
    plan = settled(plan.withColumn("now", oversampled(F.col("n"))), "plan")
    hint = int(plan.agg(F.avg("now")).first()[0] or 1)  # sizes the cells of the search, and nothing else
    points = settled(P.sample_points(pixels, plan.select("image_id", F.col("now").alias("n"), "seed"), width, height), "points")
    for k in range(rounds):
        plan = plan.withColumn("now", F.col("now") - removal(F.col("now"), F.col("n"), k == rounds - 1))
        points = merge_round(pixels, points, plan.select("image_id", F.col("now").alias("goal")), hint, width, height)
    points = polish(pixels, points, hint, width, height)
    _, cells = _cells(pixels, points, width, height, hint)
    out = A.normalised_weights(cells)
    counts = plan.select("image_id", "n").join(out.groupBy("image_id").agg(F.count(F.lit(1)).alias("found")), "image_id", "left").where("n <> coalesce(found, 0)")
    if wrong := counts.first():
        raise ValueError(f"placement has {wrong['found'] or 0} points, not {wrong['n']}")
    return out
