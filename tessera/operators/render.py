"""Attributes by bilinear look-up, additive splat rendering, and rounds of correction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators.aggregates import hard_counts, image_error
from tessera.operators.grid import pixel_of
from tessera.operators.nearest import scratch

CHANNELS = ("r", "g", "b")
#: Least number of parts into which the footprints of a tile are dealt, and how many a part may hold.
PARTS, FULL = 8, 50_000
#: Footprints of more tiles are met from the pixels' side, the pixels of a square being dealt into SHARES.
LARGE, SHARES = 32, 16
#: A covariance whose determinant is less than this share of its diagonal's product has no extent to rely on.
SOUND, INFINITE = 1e-9, float("inf")


def bilinear(points: DataFrame, maps: DataFrame, columns: list[str], width: int, height: int) -> DataFrame:
    """``points`` with the columns of ``maps`` (image_id, pix, ...) between the four pixels around each point; what lies outside counts 0."""
    xp, yp = F.col("x") * width - 0.5, F.col("y") * height - 0.5
    base = points.select("image_id", "idx", F.floor(xp).alias("x0"), F.floor(yp).alias("y0"), (xp - F.floor(xp)).alias("fx"), (yp - F.floor(yp)).alias("fy"))
    corner = lambda dx, dy: F.struct((F.col("x0") + dx).alias("px"), (F.col("y0") + dy).alias("py"), ((F.col("fx") if dx else 1 - F.col("fx")) * (F.col("fy") if dy else 1 - F.col("fy"))).alias("w"))
    taps = base.select("image_id", "idx", F.explode(F.array(*[corner(dx, dy) for dy in (0, 1) for dx in (0, 1)])).alias("t"))
    inside = (F.col("t.px") >= 0) & (F.col("t.px") < width) & (F.col("t.py") >= 0) & (F.col("t.py") < height)
    taps = taps.where(inside).select("image_id", "idx", (F.col("t.py") * width + F.col("t.px")).cast("int").alias("pix"), F.col("t.w").alias("w"))
    found = taps.join(maps.select("image_id", "pix", *columns), ["image_id", "pix"]).groupBy("image_id", "idx").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in columns])
    keep = [c for c in points.columns if c not in columns]
    return points.select(*keep).join(found, ["image_id", "idx"], "left").fillna(0.0, columns)


def project(splats: DataFrame, width: int, height: int) -> DataFrame:
    """Footprints of splats (image_id, idx, x, y, lc_xx, lc_xy, lc_yy, ...): centre, conic, radius and tile box. Splats without an inverse have a null conic and meet no tile."""
    shape = S.scale_rotation(F.col("lc_xx"), F.col("lc_xy"), F.col("lc_yy"), eps=1e-6, reset=False)
    named = splats.withColumns({"__s1": shape["s_major"], "__s2": shape["s_minor"], "__t": shape["theta"]})
    out = named.withColumns(S.conic(F.col("__s1"), F.col("__s2"), F.col("__t")))
    out = out.withColumns({"cx": F.col("x") * width, "cy": F.col("y") * height})
    for axis, size in (("x", width), ("y", height)):
        low, high = S.tile_range(F.col(f"c{axis}"), F.col("radius"), size)
        out = out.withColumns({f"t{axis}0": low, f"t{axis}1": high})
    return out.drop("__s1", "__s2", "__t")


def footprint_tiles() -> Column:
    """How many tiles a footprint touches."""
    return F.greatest(F.lit(0), F.col("tx1") - F.col("tx0")) * F.greatest(F.lit(0), F.col("ty1") - F.col("ty0"))


def tile_pairs(projected: DataFrame, width: int) -> DataFrame:
    """A row for each tile that a footprint touches."""
    tiles = -(-width // S.TILE)
    rows = projected.where("q_xx is not null and tx1 > tx0 and ty1 > ty0").withColumn("ty", F.explode(F.sequence("ty0", F.col("ty1") - 1)))
    return rows.withColumn("tx", F.explode(F.sequence("tx0", F.col("tx1") - 1))).withColumn("tile", F.col("ty") * tiles + F.col("tx"))


def reach_in_tile(axis: str, size: int) -> tuple[Column, Column]:
    """First and last pixel of the tile along one axis that the footprint can reach before it is cut off; all of the tile where the covariance hardly has an inverse."""
    tile, var, det = F.col(f"t{axis}"), F.col(f"s_{axis}{axis}"), F.col("s_xx") * F.col("s_yy") - F.col("s_xy") * F.col("s_xy")
    sound = (F.col("s_xx") < INFINITE) & (F.col("s_yy") < INFINITE) & (det < INFINITE) & (det > SOUND * F.col("s_xx") * F.col("s_yy"))
    reach = S.cutoff_extent(F.when(sound, var)) + 1.0
    first, last = tile * S.TILE, F.least(tile * S.TILE + S.TILE, F.lit(size)) - 1
    return F.greatest(first, F.ceil(F.col(f"c{axis}") - reach)).cast("int"), F.least(last, F.floor(F.col(f"c{axis}") + reach)).cast("int")


def _small_sums(footprints: DataFrame, width: int, height: int, parts: int) -> DataFrame:
    """What footprints of few tiles give each pixel: dealt by tile and part of a tile, and there spread over the pixels they reach."""
    (x0, x1), (y0, y1) = reach_in_tile("x", width), reach_in_tile("y", height)
    pairs = tile_pairs(footprints, width).withColumns({"__x0": x0, "__x1": x1, "__y0": y0, "__y1": y1, "__part": F.pmod("idx", F.lit(parts))}).where("__x1 >= __x0 and __y1 >= __y0")
    held = pairs.select("image_id", "tile", "__part", "cx", "cy", "q_xx", "q_xy", "q_yy", "__x0", "__x1", "__y0", "__y1", *[f"__{c}" for c in CHANNELS]).repartition("image_id", "tile", "__part")
    return held.withColumn("__y", F.explode(F.sequence("__y0", "__y1"))).withColumn("__x", F.explode(F.sequence("__x0", "__x1"))).withColumn("pix", (F.col("__y") * width + F.col("__x")).cast("int"))


def large_copies(footprints: DataFrame, parts: int) -> DataFrame:
    """Footprints by level, square, share and part. A footprint lies in at most 2 x 2 of the squares of 2^level tiles that are as wide as it is; it is copied once for each of these and for each share into which the squares' pixels are dealt, whatever its size."""
    across = F.greatest(F.col("tx1") - F.col("tx0"), F.col("ty1") - F.col("ty0"))
    held = footprints.where("q_xx is not null and tx1 > tx0 and ty1 > ty0").withColumn("__level", F.ceil(F.log2(across.cast("double"))).cast("int"))
    square = lambda c: F.expr(f"shiftright({c}, __level)")
    held = held.withColumn("__sy", F.explode(F.sequence(square("ty0"), square("ty1 - 1")))).withColumn("__sx", F.explode(F.sequence(square("tx0"), square("tx1 - 1"))))
    return held.withColumn("__share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))).withColumn("__part", F.pmod("idx", F.lit(parts)))


def _large_sums(footprints: DataFrame, grid: DataFrame, width: int, parts: int) -> DataFrame:
    """What footprints of many tiles give each pixel, from the pixels' side: pixels meet them by level, square and share."""
    names = ["cx", "cy", "q_xx", "q_xy", "q_yy", "tx0", "tx1", "ty0", "ty1", *[f"__{c}" for c in CHANNELS]]
    held = large_copies(footprints, parts).select(F.col("image_id").alias("__im"), "__level", "__sx", "__sy", "__share", "__part", *names)
    keys = held.select("__im", F.col("__level").alias("__lv"), F.col("__part").alias("__pt")).distinct()  # few a picture
    tx, ty = F.expr(f"x div {S.TILE}").cast("int"), F.expr(f"y div {S.TILE}").cast("int")
    rows = grid.select("image_id", "pix", F.col("x").alias("__x"), F.col("y").alias("__y"), tx.alias("__tx"), ty.alias("__ty")).join(keys, F.col("image_id") == F.col("__im")).drop("__im")
    share = F.pmod(F.xxhash64("pix"), F.lit(SHARES)).cast("int")
    rows = rows.withColumns({"__px": F.expr("shiftright(__tx, __lv)"), "__py": F.expr("shiftright(__ty, __lv)"), "__ps": share})
    on = (F.col("image_id") == F.col("__im")) & (F.col("__lv") == F.col("__level")) & (F.col("__pt") == F.col("__part")) & (F.col("__px") == F.col("__sx")) & (F.col("__py") == F.col("__sy")) & (F.col("__ps") == F.col("__share"))
    inside = (F.col("__tx") >= F.col("tx0")) & (F.col("__tx") < F.col("tx1")) & (F.col("__ty") >= F.col("ty0")) & (F.col("__ty") < F.col("ty1"))
    # the copies are many more than what their size is judged by, so they must not be broadcast
    return rows.join(held.hint("shuffle_hash"), on & inside).select("image_id", "pix", "__x", "__y", *names)


def _shown_by(met: DataFrame) -> DataFrame:
    """What the footprints of ``met``, a row for each pixel and footprint, give each pixel together."""
    a = S.alpha(F.col("cx") - F.col("__x"), F.col("cy") - F.col("__y"), F.col("q_xx"), F.col("q_xy"), F.col("q_yy"))
    met = met.select("image_id", "pix", a.alias("__a"), *[f"__{c}" for c in CHANNELS]).where("__a > 0")
    return met.groupBy("image_id", "pix").agg(*[F.sum(F.col("__a") * F.col(f"__{c}")).alias(c) for c in CHANNELS])


def render(splats: DataFrame, grid: DataFrame, width: int, height: int) -> DataFrame:
    """``grid`` (image_id, pix, x, y) with r, g, b: at each pixel the sum of colour times weight times alpha, held in [0, 1].

    Footprints of up to LARGE tiles are dealt by tile and spread over the pixels that
    they reach; larger ones are met by the pixels. As a tile can hold any number of
    footprints, they are dealt into PARTS, or as many parts as leave FULL of them in
    each; the sums of a part are one row a pixel. Pixels are sampled at whole
    coordinates. ``splats`` needs r, g, b and weight besides the shape; the weight is
    applied here and only here.
    """
    colour = {f"__{c}": S.clamp(F.col(c) * F.col("weight"), 0.0, 1.0) for c in CHANNELS}
    # written, as filters on footprints would else be expanded down to the log-covariances, beyond what can be compiled
    footprints = scratch(project(splats, width, height).withColumns(colour), "footprints")
    large = footprint_tiles() > LARGE
    seen = footprints.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(large, 1)).alias("large")).first()
    parts = max(PARTS, -(-seen["n"] // FULL))
    sums = _shown_by(_small_sums(footprints.where(~large), width, height, parts))
    if seen["large"]:  # each kind is summed for itself: rows of a pixel and a footprint go through no union
        both = sums.unionByName(_shown_by(_large_sums(footprints.where(large), grid, width, max(1, -(-seen["large"] // FULL)))))
        sums = both.groupBy("image_id", "pix").agg(*[F.sum(c).alias(c) for c in CHANNELS])
    out = grid.select("image_id", "pix", "x", "y").join(sums, ["image_id", "pix"], "left").fillna(0.0, list(CHANNELS))
    return out.withColumns({c: S.clamp(F.col(c), 0.0, 1.0) for c in CHANNELS})


def features(pixels: DataFrame, rendered: DataFrame, counts: DataFrame) -> DataFrame:
    """The 17 inputs of a correction: image, render, difference, maps and point counts of every pixel."""
    shown = rendered.select("image_id", "pix", *[F.col(c).alias(f"render_{c}") for c in CHANNELS])
    joined = pixels.join(shown, ["image_id", "pix"]).join(counts.select("image_id", "pix", "n_points"), ["image_id", "pix"], "left").fillna(0, ["n_points"])
    return joined.select("image_id", "pix", *CHANNELS, *[f"render_{c}" for c in CHANNELS], *[(F.col(c) - F.col(f"render_{c}")).alias(f"diff_{c}") for c in CHANNELS], "density", "lc_xx", "lc_xy", "lc_yy", "map_r", "map_g", "map_b", F.col("n_points").cast("double").alias("n_points"))


def update(splats: DataFrame, delta: DataFrame, width: int, height: int) -> DataFrame:
    """Splats moved by a correction map (image_id, pix, d0..d7), looked up at each point."""
    names = [f"d{i}" for i in range(8)]
    found = bilinear(splats, delta, names, width, height)
    step = S.XY_STEP / max(width, height)
    new = {c: F.col(c) + F.col(d) for c, d in zip(("lc_xx", "lc_xy", "lc_yy"), names)}
    new |= {c: S.clamp(F.col(c) + F.col(d), 0.0, 1.0) for c, d in zip(CHANNELS, names[3:])}
    new |= {c: S.clamp(F.col(c) + F.col(d) * step, 0.0, 1.0) for c, d in zip(("x", "y"), names[6:])}
    return found.withColumns(new).drop(*names)


def correction_rounds(splats: DataFrame, image: DataFrame, deltas: Callable[[int, DataFrame], DataFrame] | DataFrame, k: int, width: int, height: int, target: float | None = None, least_gain: float | None = None, renderer=None) -> tuple[DataFrame, DataFrame]:
    """``k`` renders and up to k - 1 updates: the splats of every state (column k) and the score of every state.

    ``deltas`` is a table with a column k, or a function of the round and its
    render, which also has n_points, how many splats lie in each pixel now. With
    ``target`` or ``least_gain`` each image stops for itself once it is good enough,
    or from the second render on gains too little.
    """
    renderer = renderer or render
    states, scores, before = None, None, None
    for at in range(k):
        shown = renderer(splats, image.select("image_id", "pix", "x", "y"), width, height)
        score = scratch(image_error(shown, image).withColumn("k", F.lit(at)), "score")
        state = splats.withColumn("k", F.lit(at))
        states = state if states is None else states.unionByName(state)
        scores = score if scores is None else scores.unionByName(score)
        if at == k - 1:
            break
        if target is not None or least_gain is not None:
            now = score.select("image_id", "psnr")
            more = F.lit(True) if target is None else F.col("psnr") < target
            if least_gain is not None and before is not None:
                now = now.join(before.select("image_id", F.col("psnr").alias("was")), "image_id")
                more = more & (F.col("psnr") - F.col("was") >= least_gain)
            before = score.select("image_id", "psnr")
            going = scratch(now.where(more).select("image_id"), "going")
            if going.isEmpty():
                break
            splats, image, shown = (df.join(going, "image_id", "left_semi") for df in (splats, image, shown))
        delta = deltas(at, hard_counts(splats, shown, pixel_of(F.col("x"), F.col("y"), width, height))) if callable(deltas) else deltas.where(F.col("k") == at).drop("k")
        splats = scratch(update(splats, delta, width, height), "splats")
    return states, scores


def replay_latent(first: DataFrame, deltas: DataFrame) -> DataFrame:
    """Latent colours of every state from the first ones and the colour deltas looked up for each point (image_id, idx, k, d3, d4, d5).

    The clamp makes each state depend on the last: a fold over a point's few rounds.
    """
    steps = deltas.groupBy("image_id", "idx").agg(F.sort_array(F.collect_list(F.struct("k", "d3", "d4", "d5"))).alias("steps"))
    joined = first.select("image_id", "idx", *CHANNELS).join(steps, ["image_id", "idx"], "left")
    out = joined
    for c, d in zip(CHANNELS, ("d3", "d4", "d5")):
        start = F.array(F.col(c).cast("double"))
        fold = F.aggregate(F.coalesce("steps", F.array().cast("array<struct<k:int,d3:double,d4:double,d5:double>>")), start, lambda acc, s: F.concat(acc, F.array(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.element_at(acc, -1) + s[d])))))
        out = out.withColumn(f"all_{c}", fold)
    zipped = F.arrays_zip(*[f"all_{c}" for c in CHANNELS])
    return out.select("image_id", "idx", F.posexplode(zipped).alias("k", "v")).select("image_id", "idx", "k", *[F.col(f"v.all_{c}").alias(c) for c in CHANNELS])
