"""Scans, ranks, recurrences and selection by blocks, against sequential versions; jump flooding and large footprints."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import aggregates as A
from tessera.operators import flooding, grid, nearest, render, sampling, scan, select
from tessera.streaming import tracks


def test_running_totals_over_three_levels_of_blocks(spark):
    r = random.Random(1)
    rows = [(g, i * 7, float(r.randrange(100))) for g in range(2) for i in range(600)]
    df = spark.createDataFrame(rows, "g long, o long, v double").repartition(5)
    sums = scan.running(df, ["g"], "o", {"s": (F.sum, F.col("v")), "m": (F.max, F.col("v"))}, 4200, block=16)
    got = {(x["g"], x["o"]): (x["s"], x["m"], x["e"]) for x in scan.running(sums, ["g"], "o", {"e": (F.max, F.col("v"))}, 4200, exclusive=True, block=16).collect()}
    for g in range(2):
        total, top = 0.0, None
        for _, o, v in [x for x in rows if x[0] == g]:
            before, total, top = top, total + v, v if top is None else max(top, v)
            assert got[g, o] == (total, top, before)


def test_no_window_holds_a_whole_image(spark):
    """Windows are by block, whatever the level."""
    df = spark.range(10_000).select(F.lit(0).alias("image_id"), F.col("id").alias("o"))
    plan = scan.running(df, ["image_id"], "o", {"s": (F.sum, F.lit(1))}, 10_000, block=10)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if line.strip(" +-:").startswith("Window")]
    assert len(windows) == 5 and all("_block" in line.split("windowspecdefinition")[1] for line in windows)


def test_ranks_by_ranges(spark):
    r = random.Random(2)
    rows = [(r.choice((None, 1, 2)), float(r.randrange(20)), i) for i in range(2000)]
    got = scan.ranked(spark.createDataFrame(rows, "g long, v double, i long"), ["g"], ["v", "i"]).collect()
    for g in (None, 1, 2):
        held = sorted((x["v"], x["i"], x["rank"]) for x in got if x["g"] == g)
        assert [x[2] for x in held] == list(range(len(held))) and len(held) == sum(x[0] == g for x in rows)


@pytest.mark.parametrize("fold", (4, 256))
def test_recurrence_by_blocks(spark, fold):
    n = 700
    df = spark.createDataFrame([(g, i, 0.0 if i == 0 else 0.9, float(i * g % 13)) for g in range(2) for i in range(n)], "g long, i long, a double, b double")
    got = {(x["g"], x["i"]): x["s"] for x in scan.recurrence(df.repartition(3), ["g"], "i", n, fold=fold).collect()}
    for g in range(2):
        s = 0.0
        for i in range(n):
            s = (0.0 if i == 0 else 0.9) * s + i * g % 13
            assert got[g, i] == pytest.approx(s)


def test_keys_order_like_doubles(spark):
    r = random.Random(3)
    values = [0.0, -0.0, 5e-324, 1e-310, -1e-310, float("inf"), -float("inf"), 1.7976931348623157e308, 2.0**-1022] + [r.uniform(-1, 1) * 10.0 ** r.randrange(-320, 308) for _ in range(500)]
    values += [v for k in range(-1074, 1024, 3) for v in (2.0**k, -math.nextafter(2.0**k, 0))]
    got = select.with_double_key(spark.createDataFrame([(v,) for v in values], "v double"), F.col("v"), "k").collect()
    for x in got:
        bits = struct.unpack("<q", struct.pack("<d", abs(x["v"])))[0]
        assert x["k"] == (-bits if x["v"] < 0 else bits)


@pytest.mark.parametrize("few", (0, 4096))
def test_selection_with_ties_and_null_groups(spark, monkeypatch, few):
    """Whether the last bins are ranked or refined to the last bit."""
    monkeypatch.setattr(select, "FEW", few)
    r = random.Random(4)
    rows = [(r.choice((None, "a", "b")), r.choice((1.0, 2.0, -3.5, r.gauss(0, 1), r.gauss(0, 1) * 1e-5)), i) for i in range(1500)] + [("c", None, -1)]
    df = spark.createDataFrame(rows, "g string, v double, i long").repartition(3)
    got = {x["g"]: (x["p1"], x["p5"], x["p99"]) for x in select.quantiles(df, ["g"], "v", {"p1": 0.1, "p5": 0.5, "p99": 0.99}).collect()}
    for g in (None, "a", "b"):
        values = [v for h, v, _ in rows if h == g and v is not None]
        assert np.allclose(got[g], np.quantile(values, [0.1, 0.5, 0.99]), rtol=1e-12, atol=0)
    assert got["c"] == (None, None, None)
    marked = select.mark_least(df.where("g is not null and v is not null"), ["g"], "v", "i", spark.createDataFrame([("a", 100), ("b", 10**6), ("c", 0)], "g string, need long")).collect()
    held = sorted((x["v"], x["i"], x["taken"]) for x in marked if x["g"] == "a")
    assert [x[2] for x in held] == [True] * 100 + [False] * (len(held) - 100)
    assert all(x["taken"] for x in marked if x["g"] == "b")


def test_statistics_of_one_group_of_all_rows(spark):
    values = np.random.default_rng(5).lognormal(size=5000)
    got = A.latency_stats(spark.createDataFrame([(1, float(v)) for v in values], "g long, v double"), "v", ["g"]).first()
    assert got["median"] == pytest.approx(np.median(values)) and got["p10"] == pytest.approx(np.quantile(values, 0.1))
    assert got["p99"] == np.sort(values)[math.ceil(5000 * 0.99) - 1]


def test_counts_of_tiles_need_repairs(spark):
    """Two images whose rounded shares don't add up by themselves: counts are exact, and each tile is off its share by less than two."""
    r = np.random.default_rng(6)
    mass = {g: r.random(300) ** 4 for g in (0, 1)}
    tiles = spark.createDataFrame([(g, int(t), float(m)) for g, ms in mass.items() for t, m in enumerate(ms)], "image_id long, tile int, mass double")
    got = sampling.tile_counts(tiles, 777, 0.999999).collect()
    for g, ms in mass.items():
        n = {x["tile"]: x["n_points"] for x in got if x["image_id"] == g}
        assert sum(n.values()) == 777 and min(n.values()) >= 0
        assert max(abs(n[t] - 777 * m / ms.sum()) for t, m in enumerate(ms)) < 2


def test_smoothed_counts_of_streams(spark):
    r = random.Random(7)
    rows = [(s, 3 * k, r.randrange(1, 90)) for s in (1, 2) for k in range(400)]
    got = {(x["stream_id"], x["frame"]): x["smoothed"] for x in tracks.smooth_counts(spark.createDataFrame(rows, "stream_id long, frame long, n long")).collect()}
    for s in (1, 2):
        smoothed = None
        for _, frame, n in [x for x in rows if x[0] == s]:
            smoothed = float(n) if smoothed is None else 0.9 * smoothed + (1 - 0.9) * n
            assert got[s, frame] == pytest.approx(smoothed)


def crowd(spark, n, seed, corner=1.0):
    r = np.random.default_rng(seed)
    return [(g, i, float(x), float(y)) for g in range(2) for i, (x, y) in enumerate(r.random((n, 2)) * corner)]


@pytest.mark.parametrize("n,corner", ((40, 1.0), (300, 0.3)))
def test_jump_flooding_with_recovery(spark, n, corner):
    """Every point that some pixel is nearest to has pixels again, and few pixels are off; points that share pixels are lost first."""
    rows = crowd(spark, n, 11, corner)
    points = spark.createDataFrame(rows, "image_id long, idx int, x double, y double")
    pixels = grid.pixel_grid(spark.createDataFrame([(0,), (1,), (2,)], "image_id long"), 24, 24)
    flooded = flooding.flood(points, 24, 24)
    found = flooding.jump_flood(pixels, points, 24, 24, n)
    exact = nearest.assign_nearest(pixels, points, 24, 24, n).select("image_id", "pix", F.col("owner").alias("best"), F.col("d2").alias("least"))
    both = found.join(exact, ["image_id", "pix"]).collect()
    assert len(both) == 3 * 576 and {x["owner"] for x in both if x["image_id"] == 2} == {-1}
    held = [x for x in both if x["image_id"] < 2]
    assert all(x["d2"] >= x["least"] - 1e-12 for x in held)
    assert sum(x["d2"] > x["least"] + 1e-9 for x in held) <= 0.01 * len(held)
    for x in held:
        _, _, px, py = rows[x["image_id"] * n + x["owner"]]
        assert x["d2"] == pytest.approx((x["x"] + 0.5 - px * 24) ** 2 + (x["y"] + 0.5 - py * 24) ** 2)
    if corner < 1:
        before, after = ({(x["image_id"], x["owner"]) for x in df.select("image_id", "owner").distinct().collect()} for df in (flooded, found.where("image_id < 2")))
        assert len(after) >= len(before)


def test_large_footprints_give_the_same_sums(spark, monkeypatch):
    r = np.random.default_rng(12)
    rows = [(g, i, *map(float, r.random(2)), float(r.uniform(-1, 7)), float(r.uniform(-1, 1)), float(r.uniform(-1, 7)), *map(float, r.random(3)), 0.05) for g in range(2) for i in range(60)]
    splats = spark.createDataFrame(rows, "image_id long, idx int, x double, y double, lc_xx double, lc_xy double, lc_yy double, r double, g double, b double, weight double")
    pixels = grid.pixel_grid(spark.createDataFrame([(0,), (1,)], "image_id long"), 130, 90)
    images = []
    for large in (10**9, 4, 0):
        monkeypatch.setattr(render, "LARGE", large)
        images.append({(x["image_id"], x["pix"]): (x["r"], x["g"], x["b"]) for x in render.render(splats, pixels, 130, 90).collect()})
    assert len(images[0]) == 2 * 130 * 90 and max(v[0] for v in images[0].values()) > 0.05
    for other in images[1:]:
        assert all(np.allclose(v, other[k], atol=1e-12) for k, v in images[0].items())


def test_a_footprint_over_everything_is_copied_a_few_times(spark):
    splats = spark.createDataFrame([(0, 0, 0.5, 0.5, 13.0, 0.0, 13.0, 0.5, 0.5, 0.5, 1.0)], "image_id long, idx int, x double, y double, lc_xx double, lc_xy double, lc_yy double, r double, g double, b double, weight double")
    held = render.project(splats, 1024, 1024).withColumns({f"__{c}": F.col(c) for c in "rgb"})
    assert held.select(render.footprint_tiles()).first()[0] == 64 * 64
    pixels = grid.pixel_grid(spark.createDataFrame([(0,)], "image_id long"), 1024, 1024)
    met = render._large_sums(held, pixels, 1024, 1)
    assert met.count() == 1024 * 1024
    assert render.large_copies(held, 1).count() <= 4 * render.SHARES
