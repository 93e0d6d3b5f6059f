"""Pixel grids: a row for each pixel, keyed by (image_id, pix), with pix = y * width + x."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def pixel_grid(images: DataFrame, width: int, height: int) -> DataFrame:
    """All pixels (image_id, pix, x, y) of each image in ``images`` (image_id)."""
    grid = images.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(width * height - 1))).alias("pix"))
    return grid.withColumns({"x": F.col("pix") % width, "y": F.expr(f"pix div {width}").cast("int")})


def fill_grid(grid: DataFrame, values: DataFrame, columns: list[str]) -> DataFrame:
    """``grid`` with the columns of ``values`` (image_id, pix, ...); 0 where a pixel has no row."""
    return grid.join(values.select("image_id", "pix", *columns), ["image_id", "pix"], "left").fillna(0, columns)


def edge_pad(pixels: DataFrame, width: int, height: int, multiple: int, columns: list[str]) -> DataFrame:
    """Pad right and bottom to a multiple by repeating the last column and row."""
    w, h = (-(-v // multiple) * multiple for v in (width, height))
    grid = pixel_grid(pixels.select("image_id").distinct(), w, h)
    source = F.least("y", F.lit(height - 1)) * width + F.least("x", F.lit(width - 1))
    return _from_source(grid, source, pixels, columns)


def reflect_pad(pixels: DataFrame, width: int, height: int, multiple: int, columns: list[str]) -> DataFrame:
    """Pad right and bottom to a multiple by reflection, without repeating the edge."""
    w, h = (-(-v // multiple) * multiple for v in (width, height))
    grid = pixel_grid(pixels.select("image_id").distinct(), w, h)
    fold = lambda v, n: F.when(F.col(v) < n, F.col(v)).otherwise(2 * (n - 1) - F.col(v))
    return _from_source(grid, fold("y", height) * width + fold("x", width), pixels, columns)


def _from_source(grid: DataFrame, source: Column, pixels: DataFrame, columns: list[str]) -> DataFrame:
    held = pixels.select("image_id", F.col("pix").alias("source"), *columns)
    return grid.withColumn("source", source.cast("int")).join(held, ["image_id", "source"]).drop("source")


def crop(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """The top left ``width`` x ``height`` pixels, numbered anew."""
    return pixels.where((F.col("x") < width) & (F.col("y") < height)).withColumn("pix", (F.col("y") * width + F.col("x")).cast("int"))


def tile_of(x: Column, y: Column, width: int, height: int, tile: int | Column, shift_y: int | Column, shift_x: int | Column) -> Column:
    """The shifted tile of a pixel; the last tile of a row or column also takes what is left over."""
    tile, shift_y, shift_x = (F.lit(v) if isinstance(v, int) else v for v in (tile, shift_y, shift_x))
    across = lambda size: F.ceil(F.lit(size) / tile)
    along = lambda v, shift, size: F.least(F.floor(((v + shift) % size) / tile), across(size) - 1)
    return (along(y, shift_y, height) * across(width) + along(x, shift_x, width)).cast("int")


def pixel_of(x: Column, y: Column, width: int, height: int) -> Column:
    """The pixel that holds a normalised point."""
    at = lambda v, n: F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor(v * n))).cast("int")
    return at(y, height) * width + at(x, width)


def bicubic_taps(spark: SparkSession, size: int, new: int) -> DataFrame:
    """(to, source, tap): the whole-number weights, of 2^22 in all, with which each place along a resized side takes its sources. Cubic convolution with a = -0.5, widened when a side shrinks."""
    scale = size / new
    wide = max(scale, 1.0)
    centre = (F.col("id") + 0.5) * scale
    first = F.greatest(F.lit(0), F.floor(centre - 2 * wide + 0.5))
    stop = F.least(F.lit(size), F.floor(centre + 2 * wide + 0.5))

    def kernel(s: Column) -> Column:
        x = F.abs((s - F.col("centre") + 0.5) / wide)
        return F.when(x < 1, (1.5 * x - 2.5) * x * x + 1).when(x < 2, (((x - 5) * x + 8) * x - 4) * -0.5).otherwise(0.0)

    held = spark.range(new).select(F.col("id").cast("int").alias("to"), centre.alias("centre"), F.sequence(first, stop - 1).alias("sources"))
    held = held.withColumn("raw", F.transform("sources", kernel))
    held = held.withColumn("total", F.aggregate("raw", F.lit(0.0), lambda a, v: a + v)).select("to", "total", F.explode(F.arrays_zip("sources", "raw")).alias("t"))
    share = F.col("t.raw") / F.col("total") * float(1 << 22)
    return held.select("to", F.col("t.sources").cast("int").alias("source"), F.when(share < 0, F.ceil(share - 0.5)).otherwise(F.floor(share + 0.5)).cast("long").alias("tap"))


def resize_bicubic(pixels: DataFrame, width: int, height: int, new_width: int, new_height: int, columns: list[str]) -> DataFrame:
    """Images of bytes (0 to 255 in ``columns``) at another size: first along x, then along y, rounded to bytes after each."""

    def along(df: DataFrame, axis: str, other: str, size: int, new: int) -> DataFrame:
        taps = bicubic_taps(df.sparkSession, size, new)
        met = df.join(taps, F.col(axis) == F.col("source"))
        sums = met.groupBy("image_id", other, "to").agg(*[F.sum(F.col(c).cast("long") * F.col("tap")).alias(c) for c in columns])
        byte = lambda c: F.greatest(F.lit(0), F.least(F.lit(255), F.shiftright(F.col(c) + (1 << 21), 22))).cast("int").alias(c)
        return sums.select("image_id", other, F.col("to").alias(axis), *[byte(c) for c in columns])

    out = pixels.select("image_id", "x", "y", *columns)
    out = along(out, "x", "y", width, new_width) if new_width != width else out
    out = along(out, "y", "x", height, new_height) if new_height != height else out
    return out.select("image_id", (F.col("y") * new_width + F.col("x")).cast("int").alias("pix"), "x", "y", *columns)
