"""The smoothed counts of streams of frame files, by micro-batches: a batch is a DataFrame job, and the state between batches a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.scan import ranked, recurrence
from tessera.session import scratch
from tessera.streaming.tracks import Options

STATE = "stream_id long, n_frames long, smoothed double, last string"
FRAMES = "stream_id long, path string, frame long, n long, smoothed double, n_target long"


def frame_files(spark: SparkSession, folder: str, schema: str, **options: str) -> DataFrame:
    """A stream of the JSON files in ``folder``, as columns of ``schema`` and path. A trigger takes all files that are there."""
    return spark.readStream.schema(schema).options(**options).json(folder).withColumn("path", F.col("_metadata.file_path"))


def _committed(spark: SparkSession, out: str) -> list[int]:
    """Batches whose state is whole."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/state")
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    found = [s.getPath() for s in files.listStatus(root)]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return sorted(int(p.getName().split("=")[1]) for p in found if p.getName().startswith("batch=") and files.exists(path(p, "_SUCCESS")))


def _state_before(spark: SparkSession, out: str, batch: int) -> DataFrame:
    earlier = [k for k in _committed(spark, out) if k < batch]
    return spark.read.schema(STATE).parquet(f"{out}/state/batch={earlier[-1]}") if earlier else spark.createDataFrame([], STATE)


def smoothed_batch(frames: DataFrame, state: DataFrame, options: Options | None = None, most: int = 1 << 24) -> tuple[DataFrame, DataFrame]:
    """(frames, state) after a batch of ``frames`` (stream_id, path, n): frames in lexical order of their paths go on from ``state``.

    A stream's frames are numbered through all batches. One whose path does not come
    after those that its stream has had is an error.
    """
    keep = F.lit((options or Options()).ema)
    held = scratch(ranked(frames.select("stream_id", "path", F.col("n").cast("long").alias("n")), ["stream_id"], ["path"], "__i"), "frames")
    met = held.join(state, "stream_id", "left")
    late = F.raise_error(F.concat(F.lit("a frame comes too late: "), F.col("path"))).cast("long")
    met = met.withColumn("n", F.when(F.col("last") >= F.col("path"), late).otherwise(F.col("n")))
    first, new = F.col("__i") == 0, F.col("smoothed").isNull()
    step = F.when(first & new, F.col("n").cast("double")).otherwise(F.when(first, keep * F.col("smoothed")).otherwise(0.0) + (1 - keep) * F.col("n"))
    steps = met.select("stream_id", "path", "n", "__i", F.coalesce("n_frames", F.lit(0)).alias("__before"), F.when(first, 0.0).otherwise(keep).alias("a"), step.alias("b"))
    found = recurrence(scratch(steps, "steps"), ["stream_id"], "__i", most, "smoothed")
    done = scratch(found.select("stream_id", "path", (F.col("__before") + F.col("__i")).alias("frame"), "n", "smoothed", F.greatest(F.lit(1), F.rint("smoothed").cast("long")).alias("n_target")), "smoothed")
    now = done.groupBy("stream_id").agg((F.max("frame") + 1).alias("n_frames"), F.max_by("smoothed", "frame").alias("smoothed"), F.max("path").alias("last"))
    return done, state.join(now.select("stream_id"), "stream_id", "left_anti").select(*now.columns).unionByName(now)


def smooth_stream(frames: DataFrame, out: str, checkpoint: str, options: Options | None = None, before_commit: Callable[[int], None] | None = None) -> StreamingQuery:
    """Start a query over the stream ``frames`` (stream_id, path, n) that takes all that is there, writes to ``out`` and stops.

    A batch writes its frames and then the state after it. One that fails before its
    state is whole has left nothing: it is run again from the state before and writes over
    what there is, so every frame counts once. A later query with the same
    ``checkpoint`` and ``out`` goes on with files that have come since.
    ``before_commit`` is called between the two writes, for tests.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done, state = smoothed_batch(batch, _state_before(spark, out, number), options)
        done.write.mode("overwrite").parquet(f"{out}/frames/batch={number}")
        if before_commit:
            before_commit(number)
        state.write.mode("overwrite").parquet(f"{out}/state/batch={number}")

    return frames.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def smoothed_frames(spark: SparkSession, out: str) -> DataFrame:
    """The frames of all batches whose state is whole."""
    whole = [f"{out}/frames/batch={k}" for k in _committed(spark, out)]
    return spark.read.schema(FRAMES).parquet(*whole) if whole else spark.createDataFrame([], FRAMES)
