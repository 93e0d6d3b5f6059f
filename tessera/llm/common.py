"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import ship

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Separators of words: space and the control characters from tab to carriage return.
SPACES = "[\\x20\\x09-\\x0D]+"
#: Rows and bytes that go to a Python worker at once, unless the session says otherwise: documents can be long.
BATCH_ROWS, BATCH_BYTES = 2048, 8 << 20
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Files of a table whose names and first places are broadcast; those of a table of more files are shuffled.
BROADCAST_FILES = 100_000


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def bound_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches than Spark's own, where the session has not set any."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, str(value))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bound_batches(spark)
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def in_worker(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``f`` for mapInArrow; when its task ends, the worker, which lives on, gives freed memory back to the system."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        give_back()

    return run


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it. Only where driver and executors are one process may it be unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        found = "file:///tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    ship(spark)
    path = f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scope:
    """Scratch tables made in the thread while the scope is open; all but those kept are deleted when it closes."""

    def __init__(self):
        self.made: list[str] = []

    def keep(self, df: DataFrame) -> DataFrame:
        """A table of :func:`materialize` that is not to be deleted."""
        self.made.remove(df._scratch_path)
        return df


_open = threading.local()


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[Scope]:
    """Within it, scratch tables are for this thread's work only, and go when it ends."""
    scopes = _open.__dict__.setdefault("scopes", [])
    scope = Scope()
    scopes.append(scope)
    try:
        yield scope
    finally:
        scopes.remove(scope)
        for path in scope.made:
            delete_path(spark, path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: later passes start from these files, and so survive lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    if scopes := _open.__dict__.get("scopes"):
        scopes[-1].made.append(path)
    before = spark.conf.get(CLEAN_SHUFFLES, "false")
    spark.conf.set(CLEAN_SHUFFLES, "true")  # what this write shuffled goes with it, not when the driver next collects garbage
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop_materialized(df: DataFrame) -> None:
    """Remove the files of :func:`materialize` once nothing reads them any more."""
    delete_path(df.sparkSession, df._scratch_path)


def is_parquet_table(docs: DataFrame) -> bool:
    """Whether ``docs`` is a table of Parquet files as read, so that its rows have an index in their file."""
    plan = docs._jdf.queryExecution().analyzed()
    if plan.nodeName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    return plan.relation().fileFormat().getClass().getSimpleName() == "ParquetFileFormat"


def placed(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """All or some columns of ``docs`` and __place, the place of each row in the table, from 0: a key that tells repeated rows apart.

    The order of a table of Parquet files is that of its parts and of the rows in them; anything else is written first.
    """
    if not is_parquet_table(docs):
        docs = materialize(docs if columns is None else docs.select(*columns), "placed")
    columns = columns or docs.columns
    part = F.regexp_extract(F.col("_metadata.file_name"), "part-([0-9]+)", 1)
    part = F.when(part != "", part.cast("long"))
    rows = docs.select(*columns, part.alias("__part"), F.col("_metadata.file_path").alias("__path"), F.col("_metadata.row_index").alias("__row"))
    counts = rows.groupBy("__part", "__path").count()
    before = Window.orderBy("__part", "__path").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    starts = materialize(counts.select(F.col("__path").alias("__of"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start")), "starts")
    if len(docs.inputFiles()) <= BROADCAST_FILES:
        starts = F.broadcast(starts)
    met = rows.join(starts, F.col("__path") == F.col("__of"))
    return met.select(*columns, (F.col("__start") + F.col("__row")).alias("__place"))


def doc_crc(doc_id: Column) -> Column:
    """crc32 of the doc_id written as text; of the empty text for null."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def positions(df: DataFrame, group: list[str], spread: Column, order: list[str], per_bucket: int = 20_000, out: str = "position") -> DataFrame:
    """Number the rows of each group from 0 without gaps, without bringing a group into one task.

    Every group is dealt to sub-buckets by ``spread`` (a long, even hash, not
    negative); rows are numbered within a bucket and start at the count of the
    group's earlier buckets. ``df`` is evaluated twice, so it should be cheap to
    read. The count of buckets follows the count of rows. A group is ordered by
    bucket, then by ``order``.
    """
    keys = [*group, "__sub"]
    n = max(256, -(-df.count() // per_bucket))
    dealt = df.withColumn("__sub", F.pmod(spread, F.lit(n)).cast("int"))
    counts = dealt.groupBy(*keys).count()
    before = Window.partitionBy(*group).orderBy("__sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    names = [f"__k{i}" for i in range(len(keys))]
    starts = starts.select(*[F.col(k).alias(a) for k, a in zip(keys, names)], "__start")
    on = None
    for k, a in zip(keys, names):
        same = F.col(k).eqNullSafe(F.col(a))
        on = same if on is None else on & same
    numbered = dealt.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.join(starts, on, "left").withColumn(out, (F.col("__start") + F.col("__rn") - 1).cast("long")).drop("__sub", "__rn", "__start", *names)
