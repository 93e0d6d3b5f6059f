"""Spatial operators: worked values, invariants, and numpy versions."""

import math
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import hashing as H
from tessera.functions import scalars as S
from tessera.operators import aggregates as A
from tessera.operators import grid as G
from tessera.operators import merge as M
from tessera.operators import nearest as N
from tessera.operators import render as R
from tessera.operators import sampling as P
from tessera.streaming import tracks as T


def image(spark, density: np.ndarray):
    h, w = density.shape
    rows = [(0, y * w + x, x, y, float(density[y, x])) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "image_id long, pix int, x int, y int, density double")


def points(spark, xy):
    return spark.createDataFrame([(0, i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "image_id long, idx int, x double, y double")


def test_merge_plan_and_oversampling():
    assert M.merge_plan(100, 10, 3, 1 / 3) == [33, 22, 35]
    assert M.oversample_count(84129) == 126194 and M.merge_plan(126194, 84129, 6, 1 / 3)[:3] == [42064, 1, 0]
    assert (M.oversample_count(3), M.oversample_count(3, "reference"), M.oversample_count(3, "web")) == (5, 4, 5)


def test_two_centres_share_the_image(spark):
    grid = image(spark, np.ones((4, 10)))
    own = {(r["x"], r["y"]): r["owner"] for r in N.assign_nearest(grid, points(spark, [(0.2, 0.5), (0.7, 0.5)]), 10, 4, 2, offset=0.0).collect()}
    assert all(o == (0 if x < 5 else 1) for (x, _), o in own.items()) and len(own) == 40


@pytest.mark.parametrize("n,spread", [(1, 1.0), (60, 1.0), (200, 0.05)])
def test_nearest_is_exact(spark, n, spread):
    r = np.random.default_rng(n)
    xy = r.random((n, 2)) * spread
    xy[: n // 5] = xy[n - n // 5 :]  # ties
    got = {g["pix"]: (g["owner"], g["d2"]) for g in N.assign_nearest(image(spark, np.ones((23, 37))), points(spark, xy), 37, 23, n).collect()}
    s = np.minimum(xy * [37, 23], [37 - 1e-3, 23 - 1e-3])
    for p in range(23 * 37):
        d = (p % 37 + 0.5 - s[:, 0]) ** 2 + (p // 37 + 0.5 - s[:, 1]) ** 2
        assert got[p][0] == int(np.argmin(d)) and got[p][1] == pytest.approx(d.min())


def test_survivors_are_nearest_ties_to_the_least(spark):
    rng = np.random.default_rng(3)
    xy = np.concatenate([rng.random((40, 2)) / 16, np.full((3, 2), 0.75), [[1.0, 1.0], [0.0, 1.0]]]).tolist()
    alive = [i % 3 > 0 for i in range(len(xy))]
    table = spark.createDataFrame([(0, i, x, y, a) for i, ((x, y), a) in enumerate(zip(xy, alive))], "image_id long, idx int, x double, y double, alive boolean")
    got = {r["idx"]: r["target"] for r in N.nearest_alive(table.where("not alive"), table).collect()}
    dist = lambda i, j: (xy[i][0] - xy[j][0]) ** 2 + (xy[i][1] - xy[j][1]) ** 2
    assert got == {i: min((j for j in range(len(xy)) if alive[j]), key=lambda j: (dist(i, j), j)) for i in range(len(xy)) if not alive[i]}
    assert N.nearest_alive(table.where("not alive"), table.withColumn("alive", F.lit(False))).count() == 0


@pytest.mark.parametrize("n, shape", [(1, (16, 16)), (300, (37, 50)), (40, (16, 16))])
def test_owners_of_a_frame_are_exact(n, shape):
    height, width = shape
    xy = np.random.default_rng(n).random((n, 2)) ** 2
    xy[-1] = xy[0]
    seeds = np.minimum(xy * [width, height], [width - 1e-3, height - 1e-3])
    p = np.arange(width * height)
    d = (p[:, None] % width + 0.5 - seeds[:, 0]) ** 2 + (p[:, None] // width + 0.5 - seeds[:, 1]) ** 2
    assert (T.owners(xy, width, height) == d.argmin(axis=1)).all()


def test_nearest_without_points(spark):
    got = N.assign_nearest(image(spark, np.ones((4, 4))), points(spark, []), 4, 4, 1).select("owner").distinct().collect()
    assert [g["owner"] for g in got] == [-1]


def test_unit_hash_variants(spark):
    got = spark.range(3).select(H.unit_hash(7, F.col("id")).alias("a"), H.unit_hash(7, F.col("id"), True).alias("b")).collect()
    for i, g in enumerate(got):
        for value, steps in ((g["a"], i + 1), (g["b"], i + 2)):
            v = (7 + H.GOLDEN * steps) & H.MASK
            v = ((v ^ (v >> 30)) * H.MIX_A) & H.MASK
            v = ((v ^ (v >> 27)) * H.MIX_B) & H.MASK
            assert value == ((v ^ (v >> 31)) >> 11) * 2.0**-53
    assert 0 <= H.content_seed((3, 2, 2), np.zeros((3, 2, 2))) < 1 << 31


def test_samples_have_the_exact_count(spark):
    x, y = np.meshgrid(np.arange(32), np.arange(32))
    d = 0.01 + np.exp(-((x - 16) ** 2 + (y - 16) ** 2) / 64)
    for density, n in ((d * 400 / d.sum(), 600), (np.ones((32, 32)), 16), (np.zeros((32, 32)), 50), (np.where((x < 4) & (y < 4), 1.0, 0.0), 300)):
        got = P.sample_points(image(spark, density), n, 32, 32, 17).toPandas()
        assert sorted(got["idx"]) == list(range(n)) and got[["x", "y"]].to_numpy().min() >= 0 and got[["x", "y"]].to_numpy().max() <= 1
        if n == 300:  # more points than pixels with mass: each lies on one of the 16, in tiles of at least 4
            assert len(got[["x", "y"]].drop_duplicates()) == 300


def brute_match(idx, mass, table, remove):
    n = len(idx)
    order = sorted(range(n), key=lambda i: (mass[i], idx[i]))
    rank = {i: k for k, i in enumerate(order)}
    target = [-1] * n
    for c in range(table.shape[1]):
        asks = {}
        for i in order[:remove]:
            t = table[i, c]
            if target[i] < 0 and t >= 0 and target[t] < 0 and (t not in asks or rank[i] < rank[asks[t]]):
                asks[t] = i
        for t, i in asks.items():
            target[i] = t
    return target


def test_matching_against_a_sequential_version(spark):
    """Twenty images at once; each comes out as its own sequential rounds."""
    r = np.random.default_rng(8)
    n, tables, masses = 40, [], []
    for _ in range(20):
        tables.append(np.array([[t if t != i else -1 for t in r.choice(n, 8, False)] for i in range(n)]))
        masses.append(r.integers(0, 9, n).astype(float))
    cells = spark.createDataFrame([(g, i, float(m)) for g, mass in enumerate(masses) for i, m in enumerate(mass)], "image_id long, idx int, mass double")
    near = spark.createDataFrame([(g, i, int(t), k) for g, table in enumerate(tables) for i, row in enumerate(table) for k, t in enumerate(row) if t >= 0], "image_id long, src int, dst int, rank int")
    got = {(r["image_id"], r["idx"]): r["target"] for r in M.match_round(cells, near, 15).collect()}
    for g, (table, mass) in enumerate(zip(tables, masses)):
        assert [got.get((g, i), -1) for i in range(n)] == brute_match(np.arange(n), mass, table, 15)


def test_merging_keeps_the_mass_and_the_count(spark):
    r = np.random.default_rng(2)
    grid = image(spark, r.random((32, 32)) + 0.1)
    kept = M.merge_round(grid, points(spark, r.random((120, 2))), 30, 120, 32, 32)
    assert kept.count() == 90
    owned = N.assign_nearest(grid, kept, 32, 32, 90)
    assert A.cell_mass(kept, owned).agg(F.sum("mass")).first()[0] == pytest.approx(grid.agg(F.sum("density")).first()[0], abs=1e-6)


def test_concentrated_density_never_collapses(spark):
    d = np.zeros((24, 24))
    d[4:20, 6:18] = 1
    got = M.equal_mass_voronoi(image(spark, d), 60, 24, 24, 5).toPandas()
    assert len(got) == 60 and (got[["x", "y"]].to_numpy() > 0).all() and got["weight"].sum() == pytest.approx(60)
    assert got["mass"].std() / got["mass"].mean() < 0.5


def test_a_batch_comes_out_as_its_images_alone(spark):
    r = np.random.default_rng(3)
    dense, corner = r.random((24, 24)) + 0.1, np.zeros((24, 24))
    corner[:6, :6] = 1
    images = [image(spark, d).withColumn("image_id", F.lit(i).cast("long")) for i, d in enumerate((dense, corner, np.zeros((24, 24))))]
    both = images[0].union(images[1]).union(images[2])
    counts = spark.createDataFrame([(0, 40, 7), (1, 25, 8), (2, 10, 7)], "image_id long, n long, seed long")
    whole = M.equal_mass_voronoi(both, counts, 24, 24).toPandas().sort_values(["image_id", "idx"])
    for i, (n, seed) in enumerate(((40, 7), (25, 8), (10, 7))):
        alone = M.equal_mass_voronoi(images[i], n, 24, 24, seed).toPandas().sort_values("idx")
        mine = whole[whole["image_id"] == i]
        assert len(alone) == len(mine) == n
        np.testing.assert_allclose(mine[["x", "y", "mass"]].to_numpy(), alone[["x", "y", "mass"]].to_numpy(), atol=1e-9)
    same = M.equal_mass_voronoi(both, 40, 24, 24, 5).groupBy("image_id").count().collect()
    assert {x["image_id"]: x["count"] for x in same} == {0: 40, 1: 40, 2: 40}


def test_images_stop_for_themselves(spark):
    grid = image(spark, np.zeros((16, 16)))
    splat = spark.createDataFrame([(0, 0, 0.5, 0.5, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0)], "image_id long, idx int, x double, y double, lc_xx double, lc_xy double, lc_yy double, r double, g double, b double, weight double")
    good = R.render(splat, grid, 16, 16)
    bad = good.withColumns({"image_id": F.lit(1).cast("long"), "r": F.lit(0.9)})
    both = splat.union(splat.withColumn("image_id", F.lit(1).cast("long")))
    seen = []

    def still(at, shown):
        seen.append(sorted(x["n"] for x in shown.groupBy("image_id").agg(F.sum("n_points").alias("n")).collect()))
        return shown.select("image_id", "pix", *[F.lit(0.0).alias(f"d{i}") for i in range(8)])

    scores = R.correction_rounds(both, good.unionByName(bad), still, 3, 16, 16, target=50.0)[1].groupBy("image_id").count().collect()
    assert {x["image_id"]: x["count"] for x in scores} == {0: 1, 1: 3} and seen == [[1], [1]]


def test_float_keys_order_like_floats(spark):
    values = [0.0, -0.0, 1.5, -1.5, 1e-40, -1e-40, 3.4e38, -3.4e38, 1.0000001, 1.0, 2**-126, 0.1]
    got = {r["i"]: r["key"] for r in spark.createDataFrame(list(enumerate(values)), "i int, v double").select("i", S.order_key(F.col("v"), F.col("i")).alias("key")).collect()}
    assert sorted(got, key=got.get) == sorted(range(len(values)), key=lambda i: (np.float32(values[i]), i))
    bits = spark.createDataFrame([(float(np.float32(v)),) for v in values], "v double").select("v", S.float_bits(F.col("v")).alias("b")).collect()
    assert all(r["b"] == int(np.float32(r["v"] + 0.0).view(np.uint32)) for r in bits if r["v"])


def test_content_seeds_of_a_table(spark):
    a = np.random.default_rng(2).random((3, 4, 5)).astype(np.float32)
    rows = [(0, p, *(float(a[c].ravel()[p]) for c in range(3))) for p in range(20)]
    got = H.content_seeds(spark.createDataFrame(rows, "image_id long, pix int, r float, g float, b float"), 5, 4, 7).collect()
    assert [(x["image_id"], x["seed"]) for x in got] == [(0, H.content_seed((3, 4, 5), a, 7))]


def test_one_round_splat_has_its_closed_form(spark):
    grid = image(spark, np.zeros((8, 8)))
    lc = math.log(1.5**2)
    splat = spark.createDataFrame([(0, 0, 0.5, 0.5, lc, 0.0, lc, 1.0, 0.5, 0.25, 1.0)], "image_id long, idx int, x double, y double, lc_xx double, lc_xy double, lc_yy double, r double, g double, b double, weight double")
    for p in R.render(splat, grid, 8, 8).collect():
        a = math.exp(-((p["x"] - 4) ** 2 + (p["y"] - 4) ** 2) / (2 * 1.5**2))
        a = a if a >= 1 / 255 else 0.0
        assert [p[c] for c in "rgb"] == pytest.approx([a, a / 2, a / 4], abs=2e-6)


def test_correction_stops_early(spark):
    grid = image(spark, np.zeros((16, 16)))
    splat = spark.createDataFrame([(0, 0, 0.5, 0.5, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0)], "image_id long, idx int, x double, y double, lc_xx double, lc_xy double, lc_yy double, r double, g double, b double, weight double")
    shown = R.render(splat, grid, 16, 16)
    still = grid.select("image_id", "pix", *[F.lit(0.0).alias(f"d{i}") for i in range(8)])
    target = lambda k: R.correction_rounds(splat, shown, lambda at, s: still, k, 16, 16)[1].count()
    assert target(3) == 3
    assert R.correction_rounds(splat, shown, lambda at, s: still, 5, 16, 16, target=50.0)[1].count() == 1
    assert R.correction_rounds(splat, shown, lambda at, s: still, 5, 16, 16, least_gain=0.1)[1].count() == 2


def test_scalar_edges(spark):
    one = spark.range(1)
    got = one.select(S.clamp(F.lit(float("nan")), 0.0, 1.0).alias("nan"), S.positive_or_zero(F.lit(float("inf"))).alias("inf"), S.psnr(F.lit(0.0)).alias("psnr"), S.psnr(F.lit(0.0), True).alias("endless"), S.conic(F.lit(0.0), F.lit(0.0), F.lit(0.0))["q_xx"].alias("flat"), S.alpha(F.lit(99.0), F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(1.0)).alias("far")).first()
    assert (got["nan"], got["inf"], got["psnr"], got["flat"], got["far"]) == (0, 0, 100, None, 0) and got["endless"] == math.inf
    low, high = S.tile_range(F.lit(-5.0), F.lit(2.0), 64)
    assert tuple(one.select(low, high).first()) == (0, 0)


def test_power_diagram_and_grid(spark):
    assert G.crop(image(spark, np.arange(16.0).reshape(4, 4)), 2, 2).agg(F.sum("density")).first()[0] == 0 + 1 + 4 + 5
    heavy = points(spark, [(0.25, 0.5), (0.75, 0.5)]).withColumn("w", F.col("idx") * 100.0)
    got = N.assign_nearest(image(spark, np.ones((8, 8))), heavy, 8, 8, 2, penalty="w", most_penalty=100.0).select("owner").distinct().collect()
    assert [g["owner"] for g in got] == [1]


def blob(frame, width=26, height=20):
    x, y = np.meshgrid(np.arange(width), np.arange(height))
    return (0.05 + np.exp(-((x - 10 - 0.4 * frame) ** 2 + (y - 9) ** 2) / 30)).ravel()


def test_tracks_keep_their_identities():
    state, o, before = T.State(), T.Options(patience=2, churn_fraction=0.1), set()
    for f in range(6):
        shown, stats = T.push(state, blob(f), 26, 20, 40 + f, o)
        assert shown["track_id"].is_unique and shown["slot"].is_unique and stats["shortfall_for_next"] == 0
        assert stats["n_tracks"] == len(shown)
        if f:
            assert len(before & set(shown["track_id"])) > 0.5 * len(shown) and stats["retained_fraction"] > 0.5
        before = set(shown["track_id"])
        state = T.State.loads(state.dumps())
    assert set(state.slots).isdisjoint(state.free)


def test_track_limits_and_history():
    o = T.Options()
    assert T.limited_target(100, 300, o) == 105 and T.limited_target(100, 10, o) == 95 and T.limited_target(1, 9, o) == 2
    s = T.State()
    assert T.count_target(s, 10, o) == 10
    s.frame = 1
    assert T.count_target(s, 20, o) == 11
    s = T.State(slots=[3, 5], old=[True, False], history={"3": [0.0] * 6})
    assert T.blend_history(s, np.ones((2, 6)), o)[:, 0].tolist() == [0.9, 1.0] and set(s.history) == {"3", "5"}
    flat = T.hilbert_seeds(np.zeros(64), 8, 8, 4)
    assert sorted(map(tuple, flat)) == [(0.25, 0.25), (0.25, 0.75), (0.75, 0.25), (0.75, 0.75)]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(s, f, 12 + s, blob(f, 12, 10).tolist()) for s in range(2) for f in range(4)]
    schema = "stream_id long, frame long, n long, density array<double>"
    for f in range(2):  # two micro-batches of two frames
        spark.createDataFrame([r for r in rows if r[1] // 2 == f], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{f}")
    want = T.track_frames(spark.createDataFrame(rows, schema), 12, 10).toPandas()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    T.track_frames(stream, 12, 10).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").toPandas()
    keys = ["stream_id", "frame", "track_id"]
    pd.testing.assert_frame_equal(got.sort_values(keys, ignore_index=True), want.sort_values(keys, ignore_index=True), check_dtype=False)


def test_streams_close_and_blend_attributes(spark):
    maps = lambda v: [float(v)] * (6 * 120)
    rows = [(0, f, 12, blob(f, 12, 10).tolist(), maps(f), False) for f in range(3)]
    schema = "stream_id long, frame long, n long, density array<double>, maps array<double>, close boolean"
    got = T.track_frames(spark.createDataFrame(rows + [(0, 3, None, None, None, True)], schema), 12, 10, T.Options(patience=99, lloyd=0)).toPandas()
    assert got.groupby("frame").size().index.tolist() == [0, 1, 2]
    inside = got[(got["x"].between(0.1, 0.9)) & (got["y"].between(0.1, 0.9))]
    for f, value in ((0, 0.0), (1, 0.9), (2, 0.1 * 0.9 + 0.9 * 2)):
        np.testing.assert_allclose(inside[inside["frame"] == f]["lc_xx"], value)
    assert got["r"].max() <= 1
    with pytest.raises(Exception, match="closed"):
        T.track_frames(spark.createDataFrame([(0, 0, None, None, None, True), rows[1]], schema), 12, 10).collect()


def test_bicubic_of_constants_and_ramps(spark):
    flat = image(spark, np.full((9, 7), 200.0)).withColumn("v", F.col("density").cast("int"))
    assert [r["v"] for r in G.resize_bicubic(flat, 7, 9, 16, 4, ["v"]).select("v").distinct().collect()] == [200]
    ramp = image(spark, np.tile(np.arange(0, 160, 10), (4, 1)).astype(float)).withColumn("v", F.col("density").cast("int"))
    got = {r["x"]: r["v"] for r in G.resize_bicubic(ramp, 16, 4, 8, 4, ["v"]).where("y = 1").collect()}
    assert [got[x] for x in range(2, 6)] == [45, 65, 85, 105]
    assert G.resize_bicubic(ramp, 16, 4, 16, 4, ["v"]).where("x = 3 and v = 30").count() == 4


def test_packed_layout_is_stated():
    assert struct.calcsize("<IHH") == 8


def test_neighbours_of_many_points_in_one_place(spark):
    """As pairs of points these are 10^10."""
    n, k = 100_000, 4
    other = [(n, 0.51, 0.5), (n + 1, 0.51, 0.5), (n + 2, 0.9, 0.1), (n + 3, 0.52, 0.5), (n + 4, 0.52, 0.53), (n + 5, 0.52, 0.53)]
    few = spark.createDataFrame([(0, *o) for o in other], "image_id long, idx int, x double, y double")
    same = spark.range(n).select(F.lit(0).cast("long").alias("image_id"), F.col("id").cast("int").alias("idx"), F.lit(0.5).alias("x"), F.lit(0.5).alias("y"))
    got = {}
    for r in N.k_nearest(same.unionByName(few), 0.05, k).where(f"idx < 7 or idx >= {n - 1}").collect():
        got.setdefault(r["idx"], {})[r["rank"]] = r["neighbour"]
    lists = {i: [v[r] for r in range(1, len(v) + 1)] for i, v in got.items()}
    assert lists.pop(n + 2) == [n + 2]
    for i in (0, 1, 2, 3, 4, 5, 6, n - 1):
        assert lists.pop(i) == [j for j in range(6) if j != i][:k]
    assert lists == {n: [n + 1, 0, 1, 2], n + 1: [n, 0, 1, 2], n + 3: [n, n + 1, 0, 1], n + 4: [n + 5, n + 3, n, n + 1], n + 5: [n + 4, n + 3, n, n + 1]}


def test_survivors_are_searched_by_place_in_cells_of_their_number(spark, monkeypatch):
    seen, plain = [], N._by_rings
    monkeypatch.setattr(N, "_by_rings", lambda rows, *a: seen.append((rows.count(), a[5])) or plain(rows, *a))
    table = spark.range(4002).select(F.lit(0).cast("long").alias("image_id"), F.col("id").cast("int").alias("idx"), (F.col("id") % 4 / 4 + 0.01).alias("x"), F.lit(0.3).alias("y"), (F.col("id") >= 4000).alias("alive"))
    got = {r["idx"]: r["target"] for r in N.nearest_alive(table.where("not alive"), table).collect()}
    assert got == {i: 4000 if i % 4 == 0 else 4001 for i in range(4000)}
    assert seen == [(4, 1)]


def test_copies_of_large_splats_are_not_broadcast(spark):
    """Each has up to 64 copies, which the size of the table does not show, and these went to every executor."""
    splats = spark.range(300).selectExpr("0L image_id", "int(id) idx", "0.5D x", "0.5D y", "6.5D lc_xx", "0D lc_xy", "6.5D lc_yy", "0.5D r", "0.5D g", "0.5D b", "0.001D weight")
    grid = G.pixel_grid(spark.range(1).withColumnRenamed("id", "image_id"), 128, 128)
    colour = {f"__{c}": F.col(c) * F.col("weight") for c in R.CHANNELS}
    met = R._large_sums(R.project(splats, 128, 128).withColumns(colour), grid, 128, 1)
    met.collect()
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "__share" not in "".join(line for line in plan.splitlines() if "BroadcastHashJoin" in line)
    shown = R.render(splats, grid, 128, 128)
    assert shown.count() == 128 * 128 and shown.agg(F.max("r")).first()[0] == pytest.approx(0.15, abs=1e-2)


def test_estimates_of_a_loop_do_not_grow(spark):
    """a join multiplies the estimates of its sides, so state that keeps them has twice the digits after each step."""
    grid = G.pixel_grid(spark.range(2).withColumnRenamed("id", "image_id"), 16, 16).withColumn("density", F.when(F.col("image_id") == 0, 1.0).otherwise((F.col("pix") < 20).cast("double")))
    points = spark.createDataFrame([(m, i, (i % 3 + 0.5) / 9, (i // 3 + 0.5) / 9) for m in range(2) for i in range(9)], "image_id long, idx int, x double, y double")
    digits = []
    for _ in range(2):
        points = M.polish(grid, points, 9, 16, 16, 1)
        digits.append(len(str(points._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))
    assert points.count() == 18
    assert max(digits) < 10
