"""Array files: NPY, NPZ (stored or deflated ZIP) and packed splats, read through Spark's binaryFile and written back."""

from __future__ import annotations

import ast
import fnmatch
import io
import json
import struct
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import ExitStack, nullcontext
from dataclasses import dataclass, replace
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.operators.scan import ranked
from tessera.session import ship
from tessera.sources.blobs import FileWriter, Written

# Element types that are read, those that are written, and the head of a packed splat file.
READ_TYPES = ("<f4", "<f8", "<i4", "<u4", "<i8", "|u1", "|b1", "|i1")
WRITE_TYPES = ("<f4", "<i4", "<i8", "|u1")
SPLAT_MAGIC = b"GS2D"
LEAST_SCALE = 0.01
#: Rows of a piece that is written, elements or rows of a partition and of a batch that are read, and bytes that hold the head of any array.
PIECE, SPLIT, CHUNK, HEAD = 1 << 13, 1 << 20, 1 << 16, 1 << 17


def npy_head(data: bytes, types: tuple[str, ...] = READ_TYPES) -> tuple[np.dtype, tuple[int, ...], int]:
    """Type and shape of an NPY file, versions 1 to 3, and where its elements begin; ValueError for another type or Fortran order. ``data`` has to hold the head."""
    if data[:6] != b"\x93NUMPY" or len(data) < 10:
        raise ValueError("not an NPY file")
    if data[6] not in (1, 2, 3):
        raise ValueError(f"NPY version {data[6]} is not supported")
    wide = data[6] > 1
    start = 12 if wide else 10
    (size,) = struct.unpack("<I" if wide else "<H", data[8:start])
    if len(data) < start + size:
        raise ValueError("NPY header is cut short")
    try:
        head = ast.literal_eval(data[start : start + size].decode("utf-8" if data[6] == 3 else "latin-1").strip())
        shape, fortran, dtype = tuple(head["shape"]), bool(head["fortran_order"]), np.dtype(head["descr"])
    except (SyntaxError, ValueError, KeyError, TypeError, UnicodeDecodeError) as e:
        raise ValueError(f"NPY header: {e}") from e
    if dtype.str not in types:
        raise ValueError(f"NPY type {dtype.str} is not supported")
    if fortran and len(shape) > 1:
        raise ValueError("NPY in Fortran order is not supported")
    return dtype, shape, start + size


def parse_npy(data: bytes, types: tuple[str, ...] = READ_TYPES) -> np.ndarray:
    """The array of an NPY file; ValueError as for its head, or for a wrong size."""
    dtype, shape, start = npy_head(data, types)
    body = data[start:]
    if len(body) != int(np.prod(shape, dtype=np.int64)) * dtype.itemsize:
        raise ValueError("NPY payload has the wrong size")
    return np.frombuffer(body, dtype).reshape(shape)


def parse_image(data: bytes) -> np.ndarray:
    """A [3, H, W] float image with values in [0, 1]; a leading 1 is dropped."""
    a = parse_npy(data, ("<f4",))
    a = a[0] if a.ndim == 4 and a.shape[0] == 1 else a
    if a.ndim != 3 or a.shape[0] != 3:
        raise ValueError(f"image has shape {a.shape}")
    if not np.isfinite(a).all() or a.min(initial=0) < 0 or a.max(initial=0) > 1:
        raise ValueError("image has values outside 0 to 1")
    return a


def dump_npy(a: np.ndarray) -> bytes:
    if a.dtype.str not in WRITE_TYPES:
        raise ValueError(f"NPY type {a.dtype.str} is not written")
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(a), version=(1, 0))
    return out.getvalue()


def parse_npz(data: bytes) -> dict[str, np.ndarray]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return {n.removesuffix(".npy"): parse_npy(z.read(n)) for n in z.namelist() if n.endswith(".npy")}


def dump_npz(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, a in arrays.items():
            z.writestr(f"{name}.npy", dump_npy(a))
    return out.getvalue()


def parse_splats(data: bytes) -> dict:
    """Width, height, and x, y, scales, rotation and colour of each packed splat."""
    if data[:4] != SPLAT_MAGIC:
        raise ValueError("not a splat file")
    n, h, w = struct.unpack("<IHH", data[4:12])
    v = np.frombuffer(data[12:], "<f4")
    if len(v) != 8 * n:
        raise ValueError("splat file has the wrong size")
    parts = np.split(v, np.cumsum([2 * n, 2 * n, n]))
    scale = 1 / np.maximum(parts[1].reshape(n, 2), LEAST_SCALE)
    return {"width": w, "height": h, "xy": parts[0].reshape(n, 2), "scale": scale, "rotation": parts[2], "color": parts[3].reshape(n, 3)}


def dump_splats(xy, scale, rotation, color, width: int, height: int, crop: tuple[int, int] | None = None) -> bytes:
    """The packed form; scales are stored as their inverses, and points of a cropped frame are scaled to it."""
    w, h = crop or (width, height)
    if max(w, h) > 0xFFFF:
        raise ValueError("frame is too large for a splat file")
    xy = np.asarray(xy, "<f4") * np.array([width / w, height / h], "<f4")
    parts = [xy, 1 / np.maximum(np.asarray(scale, "<f4"), LEAST_SCALE), np.asarray(rotation, "<f4"), np.asarray(color, "<f4")]
    return SPLAT_MAGIC + struct.pack("<IHH", len(xy), h, w) + b"".join(np.asarray(p, "<f4").tobytes() for p in parts)


def binary(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def read_images(spark: SparkSession, path: str, pattern: str = "*.npy") -> DataFrame:
    """Pixels (path, pix, x, y, r, g, b) of all image arrays; a malformed file is an error that names it."""

    def pixels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, data in zip(batch["path"], batch["content"]):
                try:
                    a = parse_image(bytes(data))
                except ValueError as e:
                    raise ValueError(f"{p}: {e}") from e
                _, h, w = a.shape
                pix = np.arange(h * w)
                yield pd.DataFrame({"path": p, "pix": pix, "x": pix % w, "y": pix // w, "r": a[0].ravel(), "g": a[1].ravel(), "b": a[2].ravel()})

    return binary(spark, path, pattern).select("path", "content").mapInPandas(pixels, "path string, pix int, x int, y int, r float, g float, b float")


@dataclass
class Held(InputPartition):
    """An array in a file, or ``count`` of its elements from ``first`` on. Stored arrays begin at ``offset`` of the file; deflated ones (-1) at ``skip`` of their member."""

    path: str
    name: str
    member: str
    dtype: str
    shape: list[int]
    offset: int
    skip: int
    first: int = 0
    count: int = 0

    @property
    def size(self) -> int:
        return int(np.prod(self.shape, dtype=np.int64))

    def chunks(self, files: fs.FileSystem) -> Iterator[np.ndarray]:
        """The elements, at most CHUNK at once."""
        item = np.dtype(self.dtype).itemsize
        with files.open_input_file(self.path) as source, ExitStack() as more:
            if self.offset < 0:
                member = more.enter_context(more.enter_context(zipfile.ZipFile(source)).open(self.member))
                left = self.skip + self.first * item
                while left:
                    left -= len(member.read(min(left, CHUNK)))
            for at in range(self.first, self.first + self.count, CHUNK):
                n = min(CHUNK, self.first + self.count - at)
                data = source.read_at(n * item, self.offset + at * item) if self.offset >= 0 else member.read(n * item)
                yield np.frombuffer(data, self.dtype)


def listed(path: str, pattern: str) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    """The file ``path``, or the files of that folder that ``pattern`` fits, by name."""
    files, root = fs.FileSystem.from_uri(path)
    info = files.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    there = files.get_file_info(fs.FileSelector(root)) if info.type == fs.FileType.Directory else [info]
    return files, sorted((i for i in there if i.type == fs.FileType.File and not i.base_name.startswith((".", "_")) and fnmatch.fnmatchcase(i.base_name, pattern)), key=lambda i: i.path)


def held_arrays(files: fs.FileSystem, info: fs.FileInfo) -> list[Held]:
    """The arrays of an NPY or NPZ file, from its heads alone."""
    out = []

    def add(member: str, head: bytes, size: int, offset: int) -> None:
        dtype, shape, skip = npy_head(head)
        if size - skip != int(np.prod(shape, dtype=np.int64)) * dtype.itemsize:
            raise ValueError("NPY payload has the wrong size")
        out.append(Held(info.path, member.removesuffix(".npy"), member, dtype.str, list(shape), offset + skip if offset >= 0 else -1, skip))

    with files.open_input_file(info.path) as source:
        try:
            if source.read_at(2, 0) != b"PK":
                add("", source.read_at(min(info.size, HEAD), 0), info.size, 0)
                return out
            with zipfile.ZipFile(source) as z:
                for m in z.infolist():
                    if m.filename.endswith(".npy"):
                        with z.open(m) as member:
                            head = member.read(HEAD)
                        name, extra = struct.unpack("<HH", source.read_at(4, m.header_offset + 26))
                        add(m.filename, head, m.file_size, m.header_offset + 30 + name + extra if m.compress_type == zipfile.ZIP_STORED else -1)
        except (ValueError, zipfile.BadZipFile) as e:
            raise ValueError(f"{info.path}: {e}") from e
    return out


def repeated(value, kind: pa.DataType, n: int) -> pa.Array:
    return pa.array([value], kind).take(pa.array(np.zeros(n, np.int32)))


class ArrayReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.pattern = options["path"], options["pattern"]

    def partitions(self) -> list[Held]:
        files, found = listed(self.path, self.pattern)
        out = []
        for info in found:
            for h in held_arrays(files, info):
                step = SPLIT if h.offset >= 0 else max(1, h.size)
                out += [replace(h, first=at, count=min(step, h.size - at)) for at in range(0, h.size, step)]
        return out or [Held("", "", "", "|u1", [0], 0, 0)]

    def read(self, part: Held) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(self.path)
        at = part.first
        for v in part.chunks(files) if part.count else ():
            n = len(v)
            columns = [repeated(part.path, pa.string(), n), repeated(part.name, pa.string(), n), repeated(part.shape, pa.list_(pa.int32()), n), repeated(part.dtype, pa.string(), n), pa.array(np.arange(at, at + n)), pa.array(v.astype(np.float64))]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "name", "shape", "dtype", "i", "value"])
            at += n


class ArraySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "array_files"

    def schema(self) -> str:
        return "path string, name string, shape array<int>, dtype string, i long, value double"

    def reader(self, schema) -> ArrayReader:
        return ArrayReader(self.options)


def _load(spark: SparkSession, source: type[DataSource], path: str, pattern: str) -> DataFrame:
    ship(spark)
    spark.dataSource.register(source)
    return spark.read.format(source.name()).option("path", path).option("pattern", pattern).load()


def read_arrays(spark: SparkSession, path: str, pattern: str = "*.np[yz]") -> DataFrame:
    """All elements (path, name, shape, dtype, i, value) of the NPY and NPZ files of a folder, or of one file; name is empty for NPY.

    The driver reads heads only; partitions are ranges of stored arrays, and whole
    deflated ones, which are streamed. ``path`` is a URI that Arrow's file systems know.
    """
    return _load(spark, ArraySource, path, pattern)


def read_splats(spark: SparkSession, path: str) -> DataFrame:
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, data in zip(batch["path"], batch["content"]):
                s = parse_splats(bytes(data))
                n = len(s["rotation"])
                yield pd.DataFrame({"path": p, "width": s["width"], "height": s["height"], "idx": np.arange(n), "x": s["xy"][:, 0], "y": s["xy"][:, 1], "s1": s["scale"][:, 0], "s2": s["scale"][:, 1], "theta": s["rotation"], "r": s["color"][:, 0], "g": s["color"][:, 1], "b": s["color"][:, 2]})

    return binary(spark, path, "*.splat2d").select("path", "content").mapInPandas(rows, "path string, width int, height int, idx int, x float, y float, s1 float, s2 float, theta float, r float, g float, b float")


def read_triple(spark: SparkSession, points: str, cov: str, rgb: str) -> DataFrame:
    """Points, log-covariances and colours of three array files, joined by position; unequal lengths are an error."""
    out = None
    for path, names in ((points, ("x", "y")), (cov, ("lc_xx", "lc_xy", "lc_yy")), (rgb, ("r", "g", "b"))):
        k = len(names)
        part = read_arrays(spark, path).groupBy(F.expr(f"i div {k}").cast("int").alias("idx")).agg(*[F.max(F.when(F.col("i") % k == j, F.col("value"))).alias(c) for j, c in enumerate(names)])
        out = part if out is None else out.join(part, "idx", "full")
    short = F.col("x").isNull() | F.col("lc_xx").isNull() | F.col("r").isNull()
    return out.withColumn("x", F.when(short, F.raise_error(F.lit("arrays have different lengths")).cast("double")).otherwise(F.col("x")))


def external_maps(spark: SparkSession, folder: str, stem: str) -> DataFrame:
    """The density, log-covariance, colour and rate maps of one image, joined by pixel: what a network would have given."""
    layers = {"density": ("density",), "log_cov": ("lc_xx", "lc_xy", "lc_yy"), "rgb": ("map_r", "map_g", "map_b"), "rate": ("rate",)}
    out = None
    for layer, names in layers.items():
        a = read_arrays(spark, f"{folder}/{stem}.{layer}.npy", "*.npy").withColumn("n", F.expr(f"element_at(shape, -1) * element_at(shape, -2)"))
        part = a.groupBy((F.col("i") % F.col("n")).cast("int").alias("pix"), F.element_at("shape", -1).alias("width")).agg(*[F.max(F.when(F.floor(F.col("i") / F.col("n")) == j, F.col("value"))).alias(c) for j, c in enumerate(names)])
        out = part if out is None else out.join(part, ["pix", "width"])
    return out.withColumns({"x": F.col("pix") % F.col("width"), "y": F.expr("pix div width").cast("int")})


def scene_states(arrays: dict[str, np.ndarray]) -> pd.DataFrame:
    """Splats of every state (k, idx, x, y, lc_xx, lc_xy, lc_yy, r, g, b) of a scene, in either layout of its arrays."""
    if "states_points" in arrays:
        xy, cov, rgb = (arrays[f"states_{n}"] for n in ("points", "cov", "rgb"))
    else:
        kinds = [k for k in ("init", "final") if f"{k}_cov" in arrays]
        xy = np.stack([arrays.get(f"{k}_points", arrays["points"]) for k in kinds])
        cov, rgb = (np.stack([arrays[f"{k}_{n}"] for k in kinds]) for n in ("cov", "rgb"))
    k, n = xy.shape[:2]
    flat = np.concatenate([xy.reshape(k * n, 2), cov.reshape(k * n, 3), rgb.reshape(k * n, 3)], axis=1)
    out = pd.DataFrame(flat, columns=["x", "y", "lc_xx", "lc_xy", "lc_yy", "r", "g", "b"])
    out.insert(0, "idx", np.tile(np.arange(n), k))
    out.insert(0, "k", np.repeat(np.arange(k), n))
    return out


def frame_size(arrays: dict[str, np.ndarray], meta: dict) -> tuple[int, int]:
    """Width and height of a scene: from its own fields, its density, its render, or its notes."""
    if "width" in arrays and "height" in arrays:
        return int(np.ravel(arrays["width"])[0]), int(np.ravel(arrays["height"])[0])
    for name in ("density", "rendered"):
        if name in arrays:
            return int(arrays[name].shape[-1]), int(arrays[name].shape[-2])
    return int(meta["width"]), int(meta["height"])


def load_scene(data: bytes) -> tuple[dict[str, np.ndarray], dict]:
    arrays = parse_npz(data)
    meta = json.loads(bytes(arrays.pop("meta")).decode()) if "meta" in arrays else {}
    return arrays, meta


def save_scene(arrays: dict[str, np.ndarray], meta: dict, width: int, height: int) -> bytes:
    head = {"format_version": np.array([1], "<i4"), "width": np.array(width, "<i4"), "height": np.array(height, "<i4"), "meta": np.frombuffer(json.dumps(meta).encode(), np.uint8)}
    return dump_npz(head | arrays)


def pieces(rows: DataFrame, order: list[str], label: Callable[[str], tuple[str, str, int]], arrays_of: Callable[[pd.DataFrame], dict[str, np.ndarray]], facts: dict[str, Column], lead: Callable[[pd.Series], tuple[int, ...]]) -> DataFrame:
    """Array files of each image of ``rows`` by pieces (name, member, place, part, content) of PIECE rows, in ``order``; the head of an array is its part -1.

    ``arrays_of`` gives the arrays of some rows, ``label`` file, member and place of
    the member of an array, and ``lead`` the first lengths of an image's arrays from its ``facts``.
    """
    columns = [c for c in rows.columns if c != "image_id"]

    def framed(image: int, part: int, contents: dict[str, bytes]) -> pd.DataFrame:
        where = [label(n) for n in contents]
        return pd.DataFrame({"name": [f"{image}.{w[0]}" for w in where], "member": [w[1] for w in where], "place": [w[2] for w in where], "part": part, "content": list(contents.values())})

    def dump(pdf: pd.DataFrame) -> pd.DataFrame:
        held = arrays_of(pdf.sort_values("rank"))
        return framed(pdf["image_id"].iloc[0], pdf["rank"].iloc[0] // PIECE, {n: np.ascontiguousarray(a).tobytes() for n, a in held.items()})

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, image in batch.iterrows():
                none = arrays_of(pd.DataFrame({c: np.zeros(0) for c in columns}))
                yield framed(image["image_id"], -1, {n: npy_start(a.dtype, (*lead(image), *a.shape[1:])) for n, a in none.items()})

    schema = "name string, member string, place int, part long, content binary"
    body = ranked(rows, ["image_id"], order).groupBy("image_id", F.expr(f"rank div {PIECE}")).applyInPandas(dump, schema)
    return body.unionByName(rows.groupBy("image_id").agg(*[c.alias(n) for n, c in facts.items()]).mapInPandas(heads, schema))


def npy_start(dtype: np.dtype, shape: tuple[int, ...]) -> bytes:
    """The head of an NPY file."""
    if dtype.str not in WRITE_TYPES:
        raise ValueError(f"NPY type {dtype.str} is not written")
    out = io.BytesIO()
    np.lib.format.write_array_header_1_0(out, {"descr": dtype.str, "fortran_order": False, "shape": tuple(int(n) for n in shape)})
    return out.getvalue()


def splat_pieces(splats: DataFrame) -> DataFrame:
    """The array files of each image's splats by pieces: .points .cov .rgb .color .weights, and .ids .slots where there are tracks."""
    tracked = "track_id" in splats.columns

    def arrays_of(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        rgb, weight = pdf[["r", "g", "b"]].to_numpy("<f4"), pdf["weight"].to_numpy("<f4")
        arrays = {"points": pdf[["x", "y"]].to_numpy("<f4"), "cov": pdf[["lc_xx", "lc_xy", "lc_yy"]].to_numpy("<f4"), "rgb": rgb, "color": np.clip(rgb * weight[:, None], 0, 1).astype("<f4"), "weights": weight}
        if tracked:
            arrays |= {"ids": pdf["track_id"].to_numpy("<i8"), "slots": pdf["slot"].to_numpy("<i4")}
        return arrays

    return pieces(splats, ["idx"], lambda n: (f"{n}.npy", "", 0), arrays_of, {"n": F.count(F.lit(1))}, lambda image: (image["n"],))


def splat_files(splats: DataFrame) -> DataFrame:
    """(name, content) of :func:`splat_pieces`, whole: for files that fit a row."""
    held = splat_pieces(splats).groupBy("name").agg(F.sort_array(F.collect_list(F.struct("part", "content"))).alias("s"))
    return held.select("name", F.aggregate("s", F.lit(b""), lambda all_, s: F.concat(all_, s["content"])).alias("content"))


def render_files(rendered: DataFrame, width: int, height: int) -> DataFrame:
    """(name, content) of each image's render as a [3, H, W] array."""

    def dump(pdf: pd.DataFrame) -> pd.DataFrame:
        a = pdf.sort_values("pix")[["r", "g", "b"]].to_numpy("<f4").T.reshape(3, height, width)
        return pd.DataFrame({"name": [f"{pdf['image_id'].iloc[0]}.npy"], "content": [dump_npy(np.ascontiguousarray(a))]})

    return rendered.groupBy("image_id").applyInPandas(dump, "name string, content binary")


STATE = ("x", "y", "lc_xx", "lc_xy", "lc_yy", "r", "g", "b")


def sample_pieces(points: DataFrame, density: DataFrame) -> DataFrame:
    """An NPZ of each image by pieces: points and density, and of points with init_ or final_ columns what is there."""
    there = [p for p in ("init", "final") if f"{p}_lc_xx" in points.columns]
    names = ["points", "density", *[f"{p}_{n}" for p in there for n in ("cov", "rgb")]]
    label = lambda n: ("npz", f"{n}.npy", names.index(n))

    def arrays_of(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        arrays = {"points": pdf[["x", "y"]].to_numpy("<f4")}
        for p in there:
            arrays[f"{p}_cov"] = pdf[[f"{p}_lc_xx", f"{p}_lc_xy", f"{p}_lc_yy"]].to_numpy("<f4")
            arrays[f"{p}_rgb"] = pdf[[f"{p}_r", f"{p}_g", f"{p}_b"]].to_numpy("<f4")
        return arrays

    of_points = pieces(points, ["idx"], label, arrays_of, {"n": F.count(F.lit(1))}, lambda image: (image["n"],))
    maps = density.select("image_id", "pix", "y", "density").join(points.select("image_id").distinct(), "image_id", "left_semi")
    of_maps = pieces(maps, ["pix"], label, lambda pdf: {"density": pdf["density"].to_numpy("<f4")}, {"n": F.count(F.lit(1)), "h": F.max("y") + 1}, lambda image: (image["h"], image["n"] // image["h"]))
    return of_points.unionByName(of_maps)


def scene_pieces(states: DataFrame, width: int, height: int, meta: dict) -> DataFrame:
    """A scene NPZ of each image by pieces, from its splats of every state (image_id, k, idx, ...)."""
    head = {"format_version": np.array([1], "<i4"), "width": np.array(width, "<i4"), "height": np.array(height, "<i4"), "meta": np.frombuffer(json.dumps(meta).encode(), np.uint8)}
    names = [*head, "states_points", "states_cov", "states_rgb"]

    def arrays_of(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        of = lambda columns: pdf[list(columns)].to_numpy("<f4")
        return {"states_points": of(STATE[:2]), "states_cov": of(STATE[2:5]), "states_rgb": of(STATE[5:])}

    body = pieces(states, ["k", "idx"], lambda n: ("npz", f"{n}.npy", names.index(n)), arrays_of, {"n": F.count(F.lit(1)), "k": F.countDistinct("k")}, lambda image: (image["k"], image["n"] // image["k"]))
    fields = F.explode(F.array(*[F.struct(F.lit(f"{n}.npy").alias("member"), F.lit(k).alias("place"), F.lit(0).cast("long").alias("part"), F.lit(dump_npy(a)).alias("content")) for k, (n, a) in enumerate(head.items())]))
    return body.unionByName(states.select("image_id").distinct().select(F.concat("image_id", F.lit(".npz")).alias("name"), fields.alias("f")).select("name", "f.*"))


class PieceWriter(FileWriter):
    """Files from their pieces, which come in order: a piece at a time is held."""

    def write(self, rows: Iterator) -> Written:
        files, root = self._files()
        out, attempt = Written(), f"{root}/_temporary-{self.job}/{uuid.uuid4().hex}"
        files.create_dir(attempt)
        for k, (name, of_file) in enumerate(groupby(rows, lambda r: r["name"])):
            with files.open_output_stream(f"{attempt}/{k}") as target, ExitStack() as more:
                archive = None
                for member, of_member in groupby(of_file, lambda r: r["member"]):
                    if member and archive is None:
                        archive = more.enter_context(zipfile.ZipFile(target, "w", zipfile.ZIP_STORED))
                    with archive.open(member, "w", force_zip64=True) if member else nullcontext(target) as held:
                        for row in of_member:
                            held.write(bytes(row["content"]))
            out.moves.append((f"{attempt}/{k}", f"{root}/{name}"))
        return out


class PieceSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pieced_files"

    def schema(self) -> str:
        return "name string, member string, place int, part long, content binary"

    def writer(self, schema, overwrite: bool) -> PieceWriter:
        return PieceWriter(self.options["path"])


def write_pieces(held: DataFrame, folder: str) -> None:
    """Write files from rows (name, member, place, part, content) under ``folder``, a URI that Arrow's file systems know and all executors share. Members make a stored ZIP, in the order of their places."""
    ship(held.sparkSession)
    held.sparkSession.dataSource.register(PieceSink)
    dealt = held.select("name", "member", "place", "part", "content").repartition("name").sortWithinPartitions("name", "place", "member", "part")
    dealt.write.format("pieced_files").mode("append").option("path", folder).save()


@dataclass
class Rows(InputPartition):
    """Splats of a scene: ``count`` of the ``n`` of each state from the ``first`` on, states counted on from ``state``, in arrays of points, log-covariances and colours."""

    path: str
    width: int
    height: int
    meta: str
    state: int
    n: int
    first: int
    count: int
    arrays: list[Held]


class SceneReader(ArrayReader):
    def partitions(self) -> list[Rows]:
        files, found = listed(self.path, self.pattern)
        out = []
        for info in found:
            held = {h.name: h for h in held_arrays(files, info)}
            whole = lambda name: np.concatenate([*replace(held[name], count=held[name].size).chunks(files)])  # noqa: B023, E731
            meta = json.loads(bytes(whole("meta")).decode()) if "meta" in held else {}
            width, height = frame_size({n: whole(n) if n in ("width", "height") else h for n, h in held.items()}, meta)
            if "states_points" in held:
                states = [(0, [held[f"states_{n}"] for n in ("points", "cov", "rgb")])]
            else:
                kinds = [k for k in ("init", "final") if f"{k}_cov" in held]
                states = [(k, [held.get(f"{kind}_points", held.get("points")), held[f"{kind}_cov"], held[f"{kind}_rgb"]]) for k, kind in enumerate(kinds)]
            for k, arrays in states:
                n, rows = arrays[0].shape[-2], arrays[0].size // 2
                if [a.size for a in arrays] != [2 * rows, 3 * rows, 3 * rows]:
                    raise ValueError(f"{info.path}: scene has arrays of different lengths")
                step = SPLIT if all(a.offset >= 0 for a in arrays) else max(1, rows)
                out += [Rows(info.path, width, height, json.dumps(meta), k, n, at, min(step, rows - at), arrays) for at in range(0, rows, step)]
        return out or [Rows("", 0, 0, "", 0, 1, 0, 0, [])]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(self.path)
        at = part.first
        streams = [in_rows(replace(a, first=part.first * k, count=part.count * k).chunks(files), k) for a, k in zip(part.arrays, (2, 3, 3))]
        for parts in zip(*streams):
            v = np.concatenate(parts, axis=1).astype(np.float32)
            row = np.arange(at, at + len(v))
            columns = [repeated(part.path, pa.string(), len(v)), *[repeated(x, pa.int32(), len(v)) for x in (part.width, part.height)], repeated(part.meta, pa.string(), len(v)), pa.array(part.state + row // part.n, pa.int32()), pa.array(row % part.n, pa.int32()), *[pa.array(np.ascontiguousarray(c)) for c in v.T]]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "width", "height", "meta", "k", "idx", *STATE])
            at += len(v)


def in_rows(chunks: Iterator[np.ndarray], k: int) -> Iterator[np.ndarray]:
    """Rows of ``k`` elements, CHUNK // 4 at once, whatever the chunks."""
    rest = np.zeros(0)
    for v in chunks:
        rest = np.concatenate([rest, v])
        while len(rest) >= k * (CHUNK // 4):
            yield rest[: k * (CHUNK // 4)].reshape(-1, k)
            rest = rest[k * (CHUNK // 4) :]
    if len(rest):
        yield rest.reshape(-1, k)


class SceneSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "scene_files"

    def schema(self) -> str:
        return "path string, width int, height int, meta string, k int, idx int, " + ", ".join(f"{c} float" for c in STATE)

    def reader(self, schema) -> SceneReader:
        return SceneReader(self.options)


def read_scenes(spark: SparkSession, path: str) -> DataFrame:
    """Splats of every state of the scene NPZ files, with the scene's frame size and notes (JSON). Partitions are ranges of stored arrays, or states whose arrays are deflated, which are streamed."""
    return _load(spark, SceneSource, path, "*.npz")


def packed_files(splats: DataFrame, width: int, height: int, crop: tuple[int, int] | None = None) -> DataFrame:
    """(name, content) of the packed form of each image's splats (x, y, s1, s2, theta, r, g, b)."""

    def dump(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        return pd.DataFrame({"name": [f"{pdf['image_id'].iloc[0]}.splat2d"], "content": [dump_splats(pdf[["x", "y"]], pdf[["s1", "s2"]], pdf["theta"], pdf[["r", "g", "b"]], width, height, crop)]})

    return splats.groupBy("image_id").applyInPandas(dump, "name string, content binary")


def map_files(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """(name, content) of the layers that :func:`external_maps` reads, for each image."""
    layers = {"density": ("density",), "log_cov": ("lc_xx", "lc_xy", "lc_yy"), "rgb": ("map_r", "map_g", "map_b"), "rate": ("rate",)}

    def dump(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pix")
        held = {f"{pdf['image_id'].iloc[0]}.{layer}.npy": dump_npy(np.ascontiguousarray(pdf[list(names)].to_numpy("<f4").T.reshape(len(names), height, width))) for layer, names in layers.items()}
        return pd.DataFrame({"name": list(held), "content": list(held.values())})

    return pixels.groupBy("image_id").applyInPandas(dump, "name string, content binary")


def dump_bmp(rgb: np.ndarray) -> bytes:
    """An uncompressed 24-bit BMP of a [height, width, 3] byte array."""
    h, w, _ = rgb.shape
    rows = np.zeros((h, -(-w * 3 // 4) * 4), np.uint8)
    rows[:, : w * 3] = rgb[::-1, :, ::-1].reshape(h, w * 3)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + rows.size, 0, 0, 54, 40, w, h, 1, 24, 0, rows.size, 0, 0, 0, 0) + rows.tobytes()


def bmp_files(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """(name, content) of a BMP of each image's bytes r8, g8, b8."""

    def dump(pdf: pd.DataFrame) -> pd.DataFrame:
        a = pdf.sort_values("pix")[["r8", "g8", "b8"]].to_numpy(np.uint8).reshape(height, width, 3)
        return pd.DataFrame({"name": [f"{pdf['image_id'].iloc[0]}.bmp"], "content": [dump_bmp(a)]})

    return pixels.groupBy("image_id").applyInPandas(dump, "name string, content binary")


def read_encoded(spark: SparkSession, path: str) -> DataFrame:
    """Pixels (path, pix, x, y, r, g, b) of JPEG, PNG, GIF or BMP files, by Spark's image source; a file it can't decode is an error, greys are spread over the channels."""

    def pixels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, h, w, n, data in batch.itertuples(index=False):
                a = np.frombuffer(bytes(data), np.uint8).reshape(h * w, n)
                a = (np.repeat(a, 3, 1) if n == 1 else a[:, 2::-1]).astype(np.float32) / np.float32(255)
                pix = np.arange(h * w)
                yield pd.DataFrame({"path": p, "pix": pix, "x": pix % w, "y": pix // w, "r": a[:, 0], "g": a[:, 1], "b": a[:, 2]})

    held = spark.read.format("image").option("dropInvalid", "false").load(path).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")
    bad = F.raise_error(F.concat(F.lit("not an image: "), "origin")).cast("int")
    held = held.withColumn("nChannels", F.when(F.col("nChannels") > 0, F.col("nChannels")).otherwise(bad))
    return held.mapInPandas(pixels, "path string, pix int, x int, y int, r float, g float, b float")
