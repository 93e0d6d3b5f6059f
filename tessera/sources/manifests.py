"""Text and JSON manifests, size checks, previews and report lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators.scan import ranked
from tessera.operators.select import quantiles

BUNDLE_SCHEMA = "name string, profile string, files array<struct<path:string,sha256:string,bytes:long>>"
# Limits of what is accepted.
LEAST_SIDE, MOST_POINTS, MOST_STATES = 16, 1_000_000, 16


def parse_manifest(lines: DataFrame, strict: bool = True) -> DataFrame:
    """(input, render, gaussians, maps) of lines (value): blank lines and # comments are skipped and - is none. ``strict``: any other number of fields than 2 to 4 is an error; else only lines of exactly 2 are taken."""
    held = lines.select(F.split(F.trim("value"), r"\s+").alias("f"), F.trim("value").alias("v")).where("v <> '' and not startswith(v, '#')")
    bad = (F.size("f") < 2) | (F.size("f") > 4)
    held = held.withColumn("f", F.when(bad, F.raise_error(F.concat(F.lit("manifest line: "), F.col("v"))).cast("array<string>")).otherwise(F.col("f"))) if strict else held.where("size(f) = 2")
    at = lambda i: F.when(F.get("f", F.lit(i)) != "-", F.get("f", F.lit(i)))
    return held.select(*[at(i).alias(n) for i, n in enumerate(("input", "render", "gaussians", "maps"))])


def read_manifest(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    return parse_manifest(spark.read.text(path), strict)


def frames_in_order(files: DataFrame, streams: Column | None = None) -> DataFrame:
    """``files`` (path) with frame: their place in lexical order, for each stream if given."""
    keyed = files if streams is None else files.withColumn("__stream", streams)
    return ranked(keyed, [] if streams is None else ["__stream"], ["path"], "frame").drop("__stream")


def bundle_files(spark: SparkSession, manifest: str, folder: str) -> DataFrame:
    """(path, sha256, bytes, good, problem): the files a JSON bundle manifest lists by their paths in ``folder``, held against what is there; problem is null if all is well.

    A manifest without a name or a list of files, and a path that leaves the folder, are errors.
    """
    text = spark.read.text(manifest, wholetext=True).select(F.from_json("value", BUNDLE_SCHEMA).alias("m"))
    whole = F.col("m.name").isNotNull() & F.col("m.files").isNotNull()
    files = F.when(whole, F.col("m.files")).otherwise(F.raise_error(F.lit("bundle manifest lacks its name or files")).cast("array<struct<path:string,sha256:string,bytes:long>>"))
    wanted = text.select(F.explode(files).alias("f")).select("f.path", "f.sha256", "f.bytes")
    outside = F.col("path").isNull() | F.col("path").startswith("/") | F.col("path").rlike(r"(^|/)\.\.(/|$)")
    wanted = wanted.withColumn("path", F.when(outside, F.raise_error(F.concat(F.lit("bundle path: "), F.coalesce("path", F.lit("null")))).cast("string")).otherwise(F.col("path")))
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    root = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString()
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    there = there.select(F.substring("path", len(root) + 2, 1 << 30).alias("__path"), F.sha2("content", 256).alias("__found"), F.col("length").alias("__length"))
    problem = F.when(F.col("__found").isNull(), "missing").when(F.col("bytes").isNotNull() & (F.col("bytes") != F.col("__length")), "size").when(~F.col("sha256").eqNullSafe(F.col("__found")), "digest")
    return wanted.join(there, F.col("path") == F.col("__path"), "left").select("path", "sha256", "bytes", problem.isNull().alias("good"), problem.alias("problem"))


def planar(rgba: DataFrame) -> DataFrame:
    """Pixels with bytes r8, g8, b8 as floats in [0, 1]."""
    return rgba.withColumns({c: S.clamp(F.col(f"{c}8") / 255.0, 0.0, 1.0) for c in "rgb"}).drop("r8", "g8", "b8")


def check_sizes(jobs: DataFrame) -> DataFrame:
    """``jobs`` (width, height, n, k) with problem: null if all limits hold."""
    side = (F.col("width") < LEAST_SIDE) | (F.col("height") < LEAST_SIDE)
    problem = F.when(side, "side under 16").when(F.col("width").cast("long") * F.col("height") >= 1 << 31, "too many pixels").when((F.col("n") < 1) | (F.col("n") > MOST_POINTS), "count outside 1 to 1000000").when((F.col("k") < 1) | (F.col("k") > MOST_STATES), "states outside 1 to 16")
    return jobs.withColumn("problem", problem)


def density_preview(pixels: DataFrame) -> DataFrame:
    """``pixels`` with grey (0 to 255): density over its 99.5th percentile of the image, or its maximum if that is not positive."""
    d = F.when(F.col("density").isNull() | F.isnan("density") | (F.abs("density") == float("inf")), 0.0).otherwise(F.col("density").cast("double"))
    tops = quantiles(pixels.select("image_id", d.alias("__d")), ["image_id"], "__d", {"hi": 0.995}).join(pixels.groupBy("image_id").agg(F.max(d).alias("top")), "image_id")
    hi = F.when(F.col("hi") > 0, F.col("hi")).otherwise(F.coalesce("top", F.lit(1.0)))
    grey = F.floor(S.clamp(d / F.greatest(hi, F.lit(1e-8)), 0.0, 1.0) * 255.0 + 0.5).cast("int")
    return pixels.join(tops, "image_id").withColumn("grey", grey).drop("hi", "top")


def point_preview(grid: DataFrame, points: DataFrame, pixel: Column) -> DataFrame:
    """``grid`` with grey: 255 where a point lies, else 0."""
    hit = points.select("image_id", pixel.alias("pix")).distinct().withColumn("grey", F.lit(255))
    return grid.join(hit, ["image_id", "pix"], "left").fillna(0, ["grey"])


def json_lines(df: DataFrame, *keys: str) -> DataFrame:
    """One JSON object (value) for each row, with the key columns beside it."""
    return df.select(*keys, F.to_json(F.struct(*df.columns)).alias("value"))
