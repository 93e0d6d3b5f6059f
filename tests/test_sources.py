"""Array files, scenes and manifests: round trips and what is refused."""

import hashlib
import io
import json

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.sources import arrays as S
from tessera.sources import blobs as B
from tessera.sources import manifests as L


def npy(a, version=(1, 0)):
    out = io.BytesIO()
    np.lib.format.write_array(out, a, version=version)
    return out.getvalue()


def test_npy_round_trips():
    for dtype in ("<f4", "<i4", "<i8", "|u1"):
        a = np.arange(6).reshape(2, 3).astype(dtype)
        assert (S.parse_npy(S.dump_npy(a)) == a).all()
    for version in ((1, 0), (2, 0), (3, 0)):
        assert S.parse_npy(npy(np.ones((2, 2), "<f8"), version)).sum() == 4
    with pytest.raises(ValueError):
        S.dump_npy(np.ones(2, "<f8"))


GOOD = npy(np.full((3, 2, 2), 0.5, "<f4"))


@pytest.mark.parametrize("data", [b"", b"\x93NUMPY", b"xx" + GOOD, GOOD[:-1], GOOD + b"\0", GOOD[:6] + b"\x09" + GOOD[7:], npy(np.ones((3, 2, 2), "<f8")), npy(np.ones((2, 2), "<f4")), npy(np.full((3, 2, 2), 1.5, "<f4")), npy(np.full((3, 2, 2), np.nan, "<f4")), npy(np.asfortranarray(np.ones((3, 2, 2), "<f4"))), npy(np.ones((3, 2, 2), ">f4"))])
def test_malformed_images_are_refused(data):
    with pytest.raises(ValueError):
        S.parse_image(data)


def test_image_scan(spark, tmp_path):
    a = np.random.default_rng(1).random((1, 3, 4, 5)).astype("<f4")
    (tmp_path / "a.npy").write_bytes(npy(a))
    got = S.read_images(spark, str(tmp_path)).toPandas().sort_values("pix")
    assert len(got) == 20 and np.allclose(got["g"], a[0, 1].ravel()) and got["x"].max() == 4
    (tmp_path / "b.npy").write_bytes(b"broken")
    with pytest.raises(PySparkException, match="b.npy"):
        S.read_images(spark, str(tmp_path)).count()


def test_scene_round_trip(spark, tmp_path):
    xy, cov, rgb = (np.random.default_rng(k).random((2, 5, c)).astype("<f4") for k, c in ((1, 2), (2, 3), (3, 3)))
    data = S.save_scene({"states_points": xy, "states_cov": cov, "states_rgb": rgb}, {"profile": "fused"}, 7, 9)
    held, meta = S.load_scene(data)
    states = S.scene_states(held)
    assert meta == {"profile": "fused"} and S.frame_size(held, meta) == (7, 9) and len(states) == 10
    assert np.allclose(states[states.k == 1][["x", "y"]], xy[1])
    other = S.scene_states({"points": xy[0], "init_cov": cov[0], "init_rgb": rgb[0], "final_points": xy[1], "final_cov": cov[1], "final_rgb": rgb[1]})
    assert np.allclose(other.to_numpy(), states.to_numpy())
    assert S.frame_size({"density": np.ones((3, 4))}, {}) == (4, 3) and S.frame_size({}, {"width": 5, "height": 6}) == (5, 6)
    (tmp_path / "s.npz").write_bytes(data)
    got = S.read_arrays(spark, str(tmp_path)).groupBy("name").count().collect()
    assert {r["name"]: r["count"] for r in got}["states_cov"] == 30


def test_splat_round_trip(spark, tmp_path):
    r = np.random.default_rng(4)
    xy, scale, rot, color = r.random((6, 2)), r.random((6, 2)) * 5 + 0.1, r.random(6), r.random((6, 3))
    data = S.dump_splats(xy, scale, rot, color, 40, 30)
    back = S.parse_splats(data)
    assert (back["width"], back["height"]) == (40, 30) and np.allclose(back["xy"], xy) and np.allclose(back["scale"], scale, rtol=1e-5)
    assert np.allclose(S.parse_splats(S.dump_splats(xy, scale, rot, color, 40, 30, (20, 30)))["xy"][:, 0], 2 * xy[:, 0])
    with pytest.raises(ValueError):
        S.dump_splats(xy, scale, rot, color, 70_000, 30)
    with pytest.raises(ValueError):
        S.parse_splats(data[:-4])
    (tmp_path / "a.splat2d").write_bytes(data)
    assert S.read_splats(spark, str(tmp_path)).count() == 6


def test_maps_and_triples(spark, tmp_path):
    r = np.random.default_rng(5)
    layers = {"density": r.random((3, 4)), "log_cov": r.random((3, 3, 4)), "rgb": r.random((3, 3, 4)), "rate": r.random((3, 4))}
    for name, a in layers.items():
        (tmp_path / f"im.{name}.npy").write_bytes(npy(a.astype("<f4")))
    got = S.external_maps(spark, str(tmp_path), "im").toPandas().sort_values("pix")
    assert len(got) == 12 and np.allclose(got["lc_xy"], layers["log_cov"][1].ravel()) and np.allclose(got["rate"], layers["rate"].ravel())
    for name, c in (("p", 2), ("c", 3), ("k", 3)):
        (tmp_path / f"{name}.npy").write_bytes(npy(r.random((4, c)).astype("<f4")))
    path = lambda n: f"{tmp_path}/{n}.npy"
    assert S.read_triple(spark, path("p"), path("c"), path("k")).count() == 4
    (tmp_path / "k.npy").write_bytes(npy(r.random((3, 3)).astype("<f4")))
    with pytest.raises(PySparkException, match="different lengths"):
        S.read_triple(spark, path("p"), path("c"), path("k")).collect()


def test_manifests(spark, tmp_path):
    (tmp_path / "m.txt").write_text("# note\n\na.npy b.npy\n c.npy - g.npy maps\n")
    got = [tuple(r) for r in L.read_manifest(spark, f"{tmp_path}/m.txt").collect()]
    assert got == [("a.npy", "b.npy", None, None), ("c.npy", None, "g.npy", "maps")]
    (tmp_path / "bad.txt").write_text("a b c d e\n")
    with pytest.raises(PySparkException, match="manifest line"):
        L.read_manifest(spark, f"{tmp_path}/bad.txt").collect()
    assert L.read_manifest(spark, f"{tmp_path}/bad.txt", strict=False).count() == 0


def test_bundles_and_files(spark, tmp_path):
    B.write_files(spark.createDataFrame([("x.bin", b"one"), ("y.bin", b"two")], "name string, content binary"), f"file://{tmp_path}/files")
    files = [{"path": "x.bin", "sha256": hashlib.sha256(b"one").hexdigest(), "bytes": 3}, {"path": "y.bin", "sha256": "0", "bytes": 3}, {"path": "z.bin", "sha256": "0", "bytes": 3}]
    (tmp_path / "bundle.json").write_text(json.dumps({"name": "n", "profile": "p", "files": files}))
    got = {r["path"]: r["good"] for r in L.bundle_files(spark, f"{tmp_path}/bundle.json", f"{tmp_path}/files").collect()}
    assert got == {"x.bin": True, "y.bin": False, "z.bin": False}
    B.write_files(spark.createDataFrame([("a/x.bin", b"one"), ("b/x.bin", b"other"), ("b/y.bin", b"two")], "name string, content binary"), f"file://{tmp_path}/deep")
    files = [{"path": p, "sha256": hashlib.sha256(c).hexdigest(), "bytes": n} for p, c, n in (("a/x.bin", b"one", 3), ("b/x.bin", b"one", 5), ("b/y.bin", b"two", 4), ("x.bin", b"one", 3))]
    (tmp_path / "deep.json").write_text(json.dumps({"name": "n", "files": files}))
    got = {r["path"]: r["problem"] for r in L.bundle_files(spark, f"{tmp_path}/deep.json", f"{tmp_path}/deep").collect()}
    assert got == {"a/x.bin": None, "b/x.bin": "digest", "b/y.bin": "size", "x.bin": "missing"}
    for bad in ({"files": files}, {"name": "n", "files": [{"path": "../x.bin", "sha256": "0", "bytes": 1}]}):
        (tmp_path / "bad.json").write_text(json.dumps(bad))
        with pytest.raises(Exception, match="bundle"):
            L.bundle_files(spark, f"{tmp_path}/bad.json", f"{tmp_path}/deep").collect()


def test_splat_and_render_files(spark):
    splats = spark.createDataFrame([(3, i, 0.1 * i, 0.5, 0.0, 0.0, 0.0, 0.5, 1.0, 0.25, 2.0, 70 + i, i) for i in range(4)], "image_id long, idx int, x double, y double, lc_xx double, lc_xy double, lc_yy double, r double, g double, b double, weight double, track_id long, slot int")
    files = {r["name"]: S.parse_npy(bytes(r["content"])) for r in S.splat_files(splats).collect()}
    assert sorted(files) == [f"3.{n}.npy" for n in ("color", "cov", "ids", "points", "rgb", "slots", "weights")]
    assert files["3.color.npy"][0].tolist() == [1.0, 1.0, 0.5] and files["3.ids.npy"].tolist() == [70, 71, 72, 73]
    shown = spark.createDataFrame([(3, p, p / 8, 0.0, 1.0) for p in range(6)], "image_id long, pix int, r double, g double, b double")
    a = S.parse_image(bytes(S.render_files(shown, 3, 2).first()["content"]))
    assert a.shape == (3, 2, 3) and a[0, 1, 2] == 5 / 8 and a[2].min() == 1


def test_encoded_images(spark, tmp_path):
    head = b"BM" + (54 + 16).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little")
    body = (2).to_bytes(4, "little") + (2).to_bytes(4, "little") + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(24)
    (tmp_path / "a.bmp").write_bytes(head + body + bytes([255, 0, 0, 0, 255, 0, 0, 0, 0, 0, 255, 255, 255, 255, 0, 0]))
    got = {(r["x"], r["y"]): (r["r"], r["g"], r["b"]) for r in S.read_encoded(spark, str(tmp_path)).collect()}
    assert got == {(0, 1): (0, 0, 1), (1, 1): (0, 1, 0), (0, 0): (1, 0, 0), (1, 0): (1, 1, 1)}
    (tmp_path / "b.png").write_bytes(b"no image")
    with pytest.raises(Exception, match="not an image"):
        S.read_encoded(spark, str(tmp_path)).collect()


def test_arrays_are_written_by_pieces_and_read_by_ranges(spark, tmp_path):
    n = 3 * S.PIECE + 5
    i = F.col("id")
    splats = spark.range(n).select(F.lit(3).cast("long").alias("image_id"), i.cast("int").alias("idx"), (i / n).alias("x"), (i % 7 / 7).alias("y"), *[(i % k / k).alias(c) for k, c in zip(range(2, 9), ("lc_xx", "lc_xy", "lc_yy", "r", "g", "b", "weight"))])
    held = S.splat_pieces(splats)
    assert held.agg(F.max(F.length("content"))).first()[0] <= 12 * S.PIECE
    S.write_pieces(held, f"file://{tmp_path}/splats")
    assert np.array_equal(np.load(tmp_path / "splats" / "3.points.npy"), np.stack([np.arange(n) / n, np.arange(n) % 7 / 7], 1).astype("<f4"))
    states = splats.withColumn("k", F.lit(0)).unionByName(splats.withColumns({"k": F.lit(1), "x": F.col("y")}))
    S.write_pieces(S.scene_pieces(states, 8, 6, {"a": 1}), f"file://{tmp_path}/scene")
    arrays = dict(np.load(tmp_path / "scene" / "3.npz"))
    assert arrays["states_points"].shape == (2, n, 2) and arrays["states_points"][1, :, 0].tolist() == arrays["states_points"][0, :, 1].tolist()
    (tmp_path / "packed").mkdir()
    np.savez_compressed(tmp_path / "packed" / "3.npz", **arrays)
    density = spark.createDataFrame([(3, p, p // 4, float(p)) for p in range(12)], "image_id long, pix int, y int, density double")
    S.write_pieces(S.sample_pieces(splats.withColumns({f"init_{c}": F.col(c) for c in S.STATE[2:]}), density), f"file://{tmp_path}/sample")
    assert np.load(tmp_path / "sample" / "3.npz")["density"].tolist() == np.arange(12.0).reshape(3, 4).tolist()
    rows = [S.read_scenes(spark, f"{tmp_path}/{f}").drop("path") for f in ("scene", "packed")]
    assert rows[0].count() == 2 * n and rows[0].exceptAll(rows[1]).count() == 0 and rows[0].select("width", "height", "meta").distinct().collect() == [(8, 6, '{"a": 1}')]
    assert S.read_scenes(spark, f"{tmp_path}/sample").select("k", "width", "height").distinct().collect() == [(0, 4, 3)]
    np.save(tmp_path / "long.npy", np.arange(2 * S.SPLIT + 3, dtype="<f4"))
    long = S.read_arrays(spark, f"{tmp_path}/long.npy")
    assert long.rdd.getNumPartitions() == 3 and long.where("i <> value").count() == 0 and long.count() == 2 * S.SPLIT + 3
