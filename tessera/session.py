"""What a session has to offer: the package on its workers, and the folder that its executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

HERE = os.path.dirname(os.path.abspath(__file__))


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver found it: its files go to the executors by Spark's own file service, once a session."""
    context = spark.sparkContext
    if getattr(context, "_tessera_shipped", False) or not os.path.isdir(HERE):  # a package inside an archive came with the job
        return
    path = os.path.join(tempfile.mkdtemp(), f"{os.path.basename(HERE)}.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(HERE):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                out.write(full, os.path.relpath(full, os.path.dirname(HERE)))
    context.addPyFile(path)
    context._tessera_shipped = True


def scratch(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage of a loop's state: written to the shared folder that the session names."""
    spark: SparkSession = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def settled(df: DataFrame, label: str) -> DataFrame:
    """Like :func:`scratch`, for state that a loop joins with itself: written as Parquet files and read again, it is planned by the size of these.

    A checkpoint keeps the estimate of the plan before it, and a join multiplies
    those of its sides: the digits of such estimates double from step to step.
    """
    spark: SparkSession = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names; only where driver and executors are one process may it be unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        found = "file:///tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")
