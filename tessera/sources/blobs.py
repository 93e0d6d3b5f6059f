"""Files through Spark's Python data sources: tensors of weight blobs by ranges of bytes, and files of any content written by the tasks."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from tessera.session import ship

# Heads of the two kinds of blobs, their versions, and their element types by code.
TENSORS, CONVS, VERSIONS = b"GFFM", b"GFCH", (1, 2)
KINDS = ("f16", "f32", "u8")
ALIGN = 16
#: Elements of a tensor that a partition reads.
SPLIT = 1 << 20
SIZES = {"f16": 2, "f32": 4, "u8": 1, "e4m3": 1}
ROWS = "path string, name string, tensor int, kind string, shape array<int>, i long, value double"


def _align(at: int) -> int:
    return -(-at // ALIGN) * ALIGN


def e4m3(codes: np.ndarray) -> np.ndarray:
    """The numbers of 8-bit floats of four exponent bits (bias 7) and three fraction bits; all ones are NaN."""
    sign, exponent, fraction = np.where(codes & 0x80, -1.0, 1.0), (codes >> 3 & 15).astype(int), (codes & 7) / 8.0
    out = sign * np.where(exponent > 0, (1 + fraction) * 2.0 ** (exponent - 7.0), fraction * 2.0**-6)
    return np.where(codes & 0x7F == 0x7F, np.nan, out)


def decode(data: bytes, kind: str) -> np.ndarray:
    if kind == "e4m3":
        return e4m3(np.frombuffer(data, np.uint8))
    return np.frombuffer(data, {"f16": "<f2", "f32": "<f4", "u8": "|u1"}[kind]).astype(np.float64)


@dataclass
class Tensor(InputPartition):
    """Where some elements of a tensor lie."""

    path: str
    name: str
    tensor: int
    kind: str
    shape: list[int]
    offset: int
    first: int = 0
    count: int = 0

    def split(self) -> Iterator[Tensor]:
        whole = int(np.prod(self.shape, dtype=np.int64))
        for first in range(0, whole, SPLIT):
            yield Tensor(self.path, self.name, self.tensor, self.kind, self.shape, self.offset + first * SIZES[self.kind], first, min(SPLIT, whole - first))


def layout(path: str, size: int, read_at: Callable[[int, int], bytes]) -> list[Tensor]:
    """The tensors of a blob, from its heads alone; ValueError for another kind of file, or one that is cut short."""

    def numbers(at: int, n: int) -> tuple[int, ...]:
        if at + 4 * n > size:
            raise ValueError(f"{path}: blob header is cut short")
        return struct.unpack(f"<{n}I", read_at(at, 4 * n))

    magic = read_at(0, 4) if size >= 12 else b""
    if magic not in (TENSORS, CONVS):
        raise ValueError(f"{path}: not a weight blob")
    version, n = numbers(4, 2)
    if version not in VERSIONS:
        raise ValueError(f"{path}: blob version {version} is not supported")
    at, out = 12, []

    def add(name: str, kind: str, *shape: int) -> None:
        nonlocal at
        at = _align(at)
        out.append(Tensor(path, name, len(out), kind, list(shape), at))
        at += int(np.prod(shape, dtype=np.int64)) * SIZES[kind]
        if at > size:
            raise ValueError(f"{path}: blob payload is cut short")

    for k in range(n):
        if magic == TENSORS:
            kind, count = numbers(at, 2)
            if kind >= len(KINDS):
                raise ValueError(f"{path}: blob has elements of type {kind}")
            at += 8
            add(f"tensor{k}", KINDS[kind], count)
            continue
        side, cin, cout, precision = numbers(at, 4)
        at += 16
        add(f"conv{k}.weight", "f16", side * side, cin, cout)
        add(f"conv{k}.bias", "f32", cout)
        if precision == 1:
            add(f"conv{k}.scale", "f32", 1)
            add(f"conv{k}.weight8", "e4m3", side * side, cout, cin)
            add(f"conv{k}.scale8", "f32", cout)
    return out


def dump_tensors(tensors: list[tuple[str, np.ndarray]], version: int = 1) -> bytes:
    """A blob of (kind, values)."""
    out = bytearray(TENSORS + struct.pack("<II", version, len(tensors)))
    for kind, values in tensors:
        out += struct.pack("<II", KINDS.index(kind), len(values))
        out += bytes(_align(len(out)) - len(out)) + values.astype({"f16": "<f2", "f32": "<f4", "u8": "|u1"}[kind]).tobytes()
    return bytes(out)


class BlobReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder, self.names, self.tensors = folder, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """A choice of names or numbers of tensors leaves the bytes of all others unread."""
        for f in filters:
            chosen = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if chosen is not None and f.attribute == ("name",):
                self.names = chosen if self.names is None else self.names & chosen
            elif chosen is not None and f.attribute == ("tensor",):
                self.tensors = chosen if self.tensors is None else self.tensors & chosen
            else:
                yield f

    def partitions(self) -> list[Tensor]:
        files, root = fs.FileSystem.from_uri(self.folder)
        out = []
        for info in sorted(files.get_file_info(fs.FileSelector(root)), key=lambda i: i.path):
            if info.type == fs.FileType.File and not info.base_name.startswith((".", "_")):
                with files.open_input_file(info.path) as source:
                    for t in layout(info.path, info.size, lambda at, n: source.read_at(n, at)):  # noqa: B023
                        if (self.names is None or t.name in self.names) and (self.tensors is None or t.tensor in self.tensors):
                            out += t.split()
        return out or [Tensor("", "", 0, "u8", [0], 0)]

    def read(self, part: Tensor) -> Iterator[pa.RecordBatch]:
        if not part.count:
            return
        files, _ = fs.FileSystem.from_uri(self.folder)
        with files.open_input_file(part.path) as source:
            values = decode(source.read_at(part.count * SIZES[part.kind], part.offset), part.kind)
        n = part.count
        same = lambda v, kind: pa.array([v], kind).take(pa.array(np.zeros(n, np.int32)))
        columns = [same(part.path, pa.string()), same(part.name, pa.string()), same(part.tensor, pa.int32()), same(part.kind, pa.string()), same(part.shape, pa.list_(pa.int32())), pa.array(np.arange(part.first, part.first + n)), pa.array(values)]
        yield pa.RecordBatch.from_arrays(columns, names=["path", "name", "tensor", "kind", "shape", "i", "value"])


class BlobSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "weight_blobs"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> BlobReader:
        return BlobReader(self.options["path"])


def read_blobs(spark: SparkSession, folder: str) -> DataFrame:
    """Every element of every tensor (path, name, tensor, kind, shape, i, value) of the weight blobs in ``folder``.

    The driver reads heads only; partitions are ranges of bytes. Filters by name or
    number of a tensor decide which ranges are read; for that, the session is set to push
    filters to Python sources. Empty tensors have no rows. ``folder`` is a URI that Arrow's file
    systems know.
    """
    ship(spark)
    spark.dataSource.register(BlobSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("weight_blobs").option("path", folder).load()


def blob_files(tensors: DataFrame) -> DataFrame:
    """(name, content) of a blob for each blob of ``tensors`` (blob, tensor, kind, values: array)."""

    def dump(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("tensor")
        return pd.DataFrame({"name": [f"{pdf['blob'].iloc[0]}.bin"], "content": [dump_tensors([(k, np.asarray(v)) for k, v in zip(pdf["kind"], pdf["values"])])]})

    return tensors.groupBy("blob").applyInPandas(dump, "name string, content binary")


@dataclass
class Written(WriterCommitMessage):
    """The files of a task: where they are, and what they are to be called."""

    moves: list[tuple[str, str]] = field(default_factory=list)


class FileWriter(DataSourceWriter):
    """Tasks write files beside their place; the commit renames them, so a task that runs twice or a job that fails leaves none."""

    def __init__(self, folder: str):
        self.folder, self.job = folder.rstrip("/"), uuid.uuid4().hex

    def _files(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.folder)

    def write(self, rows: Iterator) -> Written:
        files, root = self._files()
        out, attempt = Written(), f"{root}/_temporary-{self.job}/{uuid.uuid4().hex}"
        files.create_dir(attempt)
        for k, row in enumerate(rows):
            at = f"{attempt}/{k}"
            with files.open_output_stream(at) as target:
                target.write(bytes(row["content"]))
            out.moves.append((at, f"{root}/{row['name']}"))
        return out

    def commit(self, messages: list[Written | None]) -> None:
        files, root = self._files()
        for message in messages:
            for source, target in message.moves if message else []:
                files.create_dir(target.rsplit("/", 1)[0])
                files.move(source, target)
        self._clear(files, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*self._files())

    def _clear(self, files: fs.FileSystem, root: str) -> None:
        at = f"{root}/_temporary-{self.job}"
        if files.get_file_info(at).type == fs.FileType.Directory:
            files.delete_dir(at)


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "whole_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"])


def write_files(files: DataFrame, folder: str) -> None:
    """Write (name, content) rows as files under ``folder``, a URI that Arrow's file systems know and all executors share. The tasks write; the driver renames."""
    ship(files.sparkSession)
    files.sparkSession.dataSource.register(FileSink)
    files.select("name", "content").write.format("whole_files").mode("append").option("path", folder).save()
