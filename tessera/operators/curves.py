"""Points along the Hilbert curve: stretches of equal mass, cut by running sums in the order of the curve."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators.scan import running
from tessera.session import scratch

#: An image or a stretch with no more mass than this has none.
BLANK = 1e-12


def along_curve(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """``pixels`` (image_id, x, y, density) with h, the distance along the curve of the enclosing power-of-two square, and running mass and place (from 1) by it."""
    side = 1 << max(0, max(width, height) - 1).bit_length()
    held = pixels.select("image_id", "x", "y", S.positive_or_zero(F.col("density")).alias("m"), S.hilbert(F.col("x"), F.col("y"), side).alias("h"))
    return running(scratch(held, "curve"), ["image_id"], "h", {"cum": (F.sum, F.col("m")), "place": (F.sum, F.lit(1))}, side * side)


def hilbert_seeds(pixels: DataFrame, n: int | DataFrame, width: int, height: int) -> DataFrame:
    """``n`` points (image_id, idx, x, y) of each image, at the centroids of stretches of equal mass along the Hilbert curve.

    ``n`` is a number or a table (image_id, n). Cut i lies before the first pixel whose
    running mass is over i shares of n; a pixel's stretch is the last whose cut is not
    after it. A stretch without pixels or mass, as where one pixel holds several shares,
    gives the pixel at its cut, or the last of the image. An image without mass is cut by
    numbers of pixels, and its stretches give the middle of their pixels. Every pixel
    yields the cuts that fall on it, n in all: there is no join of cuts with pixels.
    """
    plan = n if isinstance(n, DataFrame) else pixels.select("image_id").distinct().withColumn("n", F.lit(n))
    placed = along_curve(pixels, width, height)
    sizes = placed.groupBy("image_id").agg(F.max("cum").alias("total"), F.count(F.lit(1)).alias("size"), F.max("h").alias("last"))
    plan = plan.select("image_id", F.col("n").cast("long").alias("n")).join(sizes, "image_id")
    held = placed.join(plan, "image_id")
    count, blank = F.col("n"), F.col("total") <= BLANK
    share = lambda i: F.col("total") * i / count
    guess = F.greatest(F.lit(0), F.least(count - 1, F.floor(F.col("cum") * count / F.when(~blank, F.col("total")))))
    held = held.withColumn("__i", F.when(~blank, guess))
    up, down = F.col("__i") + 1, F.col("__i")
    exact = F.when((up < count) & (share(up) < F.col("cum")), up).when((down > 0) & (share(down) >= F.col("cum")), down - 1).otherwise(down)
    even = F.least(count - 1, F.ceil(F.col("place") * count / F.col("size")) - 1)
    held = scratch(held.withColumn("stretch", F.when(blank, even).otherwise(exact).cast("long")), "stretches")
    held = running(held, ["image_id"], "h", {"before": (F.max, F.col("stretch"))}, 1 << 2 * max(0, max(width, height) - 1).bit_length(), exclusive=True)
    px, py = F.col("x") + 0.5, F.col("y") + 0.5
    sums = held.groupBy("image_id", F.col("stretch").alias("i")).agg(F.sum("m").alias("mass"), F.sum(F.col("m") * px).alias("mx"), F.sum(F.col("m") * py).alias("my"), F.avg(px).alias("ax"), F.avg(py).alias("ay"))
    first = F.coalesce(F.col("before") + 1, F.lit(0).cast("long"))
    final = F.when(F.col("h") == F.col("last"), count - 1).otherwise(F.col("stretch"))
    cuts = held.withColumn("__to", final).where(first <= F.col("__to")).select("image_id", px.alias("cx"), py.alias("cy"), blank.alias("blank"), F.explode(F.sequence(first, F.col("__to"))).alias("i"))
    met = cuts.join(sums, ["image_id", "i"], "left")
    at = lambda mean, middle, pixel, size: S.clamp(F.when(F.col("mass") > BLANK, F.col(mean) / F.when(F.col("mass") > BLANK, F.col("mass"))).otherwise(F.when(F.col("blank"), F.coalesce(middle, pixel)).otherwise(F.col(pixel))) / size, 0.0, 1.0)
    return met.select("image_id", F.col("i").cast("int").alias("idx"), at("mx", "ax", "cx", width).alias("x"), at("my", "ay", "cy", height).alias("y"))
