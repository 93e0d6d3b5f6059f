"""Streams of frame files that fail and go on, weight blobs by ranges, files written by tasks, seeds along the curve."""

import hashlib
import os
import struct

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tessera.operators import curves, grid
from tessera.sources import blobs
from tessera.streaming import counts, tracks


def put(folder, stream, name, n):
    os.makedirs(f"{folder}/in", exist_ok=True)
    with open(f"{folder}/in/{name}.{stream}.json", "w") as f:
        f.write(f'{{"stream_id": {stream}, "n": {n}}}\n')


def run(spark, folder, before_commit=None):
    frames = counts.frame_files(spark, f"{folder}/in", "stream_id long, n long")
    counts.smooth_stream(frames, f"file://{folder}/out", f"file://{folder}/checkpoint", before_commit=before_commit).awaitTermination()


def found(spark, folder):
    rows = counts.smoothed_frames(spark, f"file://{folder}/out").collect()
    return {(r["stream_id"], r["frame"]): (r["n"], round(r["smoothed"], 9)) for r in rows}


def wanted(ns):
    out, s = {}, {}
    for stream, values in ns.items():
        for k, n in enumerate(values):
            s[stream] = float(n) if k == 0 else 0.9 * s[stream] + (1 - 0.9) * n
            out[stream, k] = (n, round(s[stream], 9))
    return out


def test_a_stream_that_fails_goes_on_where_it_was(spark, tmp_path):
    folder, ns = str(tmp_path), {1: [], 2: []}

    def more(names, streams):
        for k, name in enumerate(names):
            for s in streams:
                n = 7 * len(ns[s]) % 50 + 10 * s + k
                ns[s].append(n)
                put(folder, s, name, n)

    more(["a", "b", "c"], (1, 2))
    run(spark, folder)
    assert found(spark, folder) == wanted(ns)
    before = found(spark, folder)
    more(["d", "e"], (1,))  # the other stream has nothing new

    def fail(batch):
        raise RuntimeError(f"lost in batch {batch}")

    with pytest.raises(StreamingQueryException, match="lost in batch"):
        run(spark, folder, fail)
    assert found(spark, folder) == before  # frames were written, but their state was not
    run(spark, folder)
    assert found(spark, folder) == wanted(ns)
    put(folder, 1, "c2", 5)  # before what stream 1 has had
    with pytest.raises(StreamingQueryException, match="too late"):
        run(spark, folder)
    assert found(spark, folder) == wanted(ns)


def test_blobs_of_both_kinds(spark, tmp_path, monkeypatch):
    r = np.random.default_rng(1)
    tensors = [("f16", r.normal(size=5)), ("f32", r.normal(size=0)), ("u8", r.integers(0, 255, 9).astype(float)), ("f32", r.normal(size=33))]
    (tmp_path / "a.gffm").write_bytes(blobs.dump_tensors(tensors))
    pad = lambda b: b + bytes(-len(b) % 16)
    weight, bias, codes = r.normal(size=(9, 2, 4)).astype("<f2"), r.normal(size=4).astype("<f4"), np.arange(72, dtype=np.uint8)
    head = b"GFCH" + struct.pack("<II", 2, 1) + struct.pack("<IIII", 3, 2, 4, 1)
    body = head
    for part in (weight.tobytes(), bias.tobytes(), struct.pack("<f", 0.5), codes.tobytes(), np.ones(4, "<f4").tobytes()):
        body = pad(body) + part
    (tmp_path / "b.gfch").write_bytes(body)
    rows = blobs.read_blobs(spark, f"file://{tmp_path}").collect()
    got = {}
    for x in sorted(rows, key=lambda x: x["i"]):
        got.setdefault((os.path.basename(x["path"])[0], x["name"]), []).append(x["value"])
    assert got["a", "tensor0"] == tensors[0][1].astype("<f2").astype(float).tolist()
    assert got["a", "tensor3"] == tensors[3][1].astype("<f4").astype(float).tolist() and got["a", "tensor2"] == tensors[2][1].tolist()
    assert ("a", "tensor1") not in got and got["b", "conv0.weight"] == weight.astype(float).ravel().tolist()
    assert got["b", "conv0.weight8"][:10] == [0, *(k * 2.0**-9 for k in range(1, 8)), 2.0**-6, 2.0**-6 * 1.125]
    assert {tuple(x["shape"]) for x in rows if x["name"] == "conv0.weight8"} == {(9, 4, 2)}
    assert blobs.e4m3(np.array([0x7E, 0xFE, 0x38], np.uint8)).tolist() == [448.0, -448.0, 1.0] and np.isnan(blobs.e4m3(np.array([0x7F], np.uint8)))[0]
    for bad in (b"GFXX" + bytes(20), b"GFFM" + struct.pack("<II", 9, 0), b"GFFM" + struct.pack("<IIII", 1, 1, 1, 50), b"GF", b"GFFM" + struct.pack("<IIII", 1, 1, 7, 1) + bytes(32)):
        with pytest.raises(ValueError):
            blobs.layout("x", len(bad), lambda at, n, b=bad: b[at : at + n])


def test_ranges_and_chosen_tensors_only_are_read(tmp_path, monkeypatch):
    monkeypatch.setattr(blobs, "SPLIT", 10)
    (tmp_path / "a.bin").write_bytes(blobs.dump_tensors([("f32", np.arange(25.0)), ("f16", np.arange(12.0))]))
    reader = blobs.BlobReader(f"file://{tmp_path}")
    assert [(p.name, p.first, p.count) for p in reader.partitions()] == [("tensor0", 0, 10), ("tensor0", 10, 10), ("tensor0", 20, 5), ("tensor1", 0, 10), ("tensor1", 10, 2)]
    left = list(reader.pushFilters([blobs.EqualTo(("name",), "tensor1"), blobs.EqualTo(("i",), 3)]))
    assert len(left) == 1 and left[0].attribute == ("i",)
    parts = reader.partitions()
    assert [p.first for p in parts] == [0, 10]
    assert [v for p in parts for b in reader.read(p) for v in b.column("value").to_pylist()] == list(range(12))


def test_files_are_written_whole_or_not_at_all(spark, tmp_path):
    rows = [(f"{k % 3}/f{k}.bin", hashlib.sha256(str(k).encode()).digest() * 100) for k in range(40)]
    files = spark.createDataFrame(rows, "name string, content binary").repartition(6)
    blobs.write_files(files, f"file://{tmp_path}/out")
    there = {os.path.relpath(os.path.join(d, n), tmp_path / "out"): open(os.path.join(d, n), "rb").read() for d, _, names in os.walk(tmp_path / "out") for n in names}
    assert there == dict(rows)
    bad = files.withColumn("content", F.when(F.col("name") == "1/f7.bin", F.raise_error(F.lit("no content")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="no content"):
        blobs.write_files(bad, f"file://{tmp_path}/failed")
    assert [n for d, _, names in os.walk(tmp_path / "failed") if "_temporary" not in d for n in names] == []  # a task that the abort meets may leave one there


def test_seeds_along_the_curve(spark):
    """Of four images at once, the sequential version's: even, blank, with one heavy pixel, and with more points than pixels."""
    r = np.random.default_rng(3)
    w, h = 11, 7
    heavy = r.random(w * h)
    heavy[30] = 500.0
    images = {0: (r.random(w * h) * (r.random(w * h) > 0.3), 9), 1: (np.zeros(w * h), 10), 2: (heavy, 40), 3: (r.random(w * h), 200), 4: (np.zeros(w * h), 150)}
    pixels = grid.pixel_grid(spark.createDataFrame([(g,) for g in images], "image_id long"), w, h)
    values = spark.createDataFrame([(g, p, float(v)) for g, (m, _) in images.items() for p, v in enumerate(m)], "image_id long, pix int, density double")
    plan = spark.createDataFrame([(g, n) for g, (_, n) in images.items()], "image_id long, n long")
    got = {(x["image_id"], x["idx"]): (x["x"], x["y"]) for x in curves.hilbert_seeds(pixels.join(values, ["image_id", "pix"]), plan, w, h).collect()}
    assert len(got) == sum(n for _, n in images.values())
    for g, (m, n) in images.items():
        held = tracks.hilbert_seeds(m, w, h, n)
        assert all(np.allclose(got[g, i], held[i], atol=1e-9) for i in range(n)), g
