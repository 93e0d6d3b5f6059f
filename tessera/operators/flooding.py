"""Jump flooding: nearest points by rounds of ever shorter steps over the grid, and exact recovery of what the rounds lose."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.nearest import NUDGE, assign_nearest, without_pixels
from tessera.session import scratch


def schedule(width: int, height: int) -> list[int]:
    """Steps from the power of two at or above half the longer side down to 1, and 1 once more."""
    top = max(1, max(width, height) // 2)
    first = (top - 1).bit_length()
    return [1 << k for k in range(first, -1, -1)] + [1]


def _offer(cell_x, cell_y):
    """What a pixel keeps of a point: the least (d2, idx) wins."""
    dx, dy = cell_x + 0.5 - F.col("px"), cell_y + 0.5 - F.col("py")
    return F.struct((dx * dx + dy * dy).alias("d2"), "idx", "px", "py")


def snap(points: DataFrame, width: int, height: int) -> DataFrame:
    """(image_id, x, y, best): each point in the pixel that holds it; of several the nearest to the centre, then the least idx, stays."""
    inside = lambda v, n: F.greatest(F.lit(0.0), F.least(F.lit(n - NUDGE), v * F.lit(float(n))))
    held = points.select("image_id", "idx", inside(F.col("x"), width).alias("px"), inside(F.col("y"), height).alias("py"))
    held = held.withColumns({"x": F.floor("px").cast("int"), "y": F.floor("py").cast("int")})
    return held.groupBy("image_id", "x", "y").agg(F.min(_offer(F.col("x"), F.col("y"))).alias("best"))


def flood(points: DataFrame, width: int, height: int, steps: list[int] | None = None) -> DataFrame:
    """(image_id, pix, owner, d2) after the rounds: a pixel's point is the nearest of those that it and the eight pixels a step away had.

    All pixels of a round see what the round before left. Each offers its point to
    nine pixels, and the offers are summed up where they are made before they move:
    one shuffle a round. Pixels that no point has reached have no row.
    """
    held = snap(points, width, height)
    for step in steps or schedule(width, height):
        side = F.array(F.lit(-step), F.lit(0), F.lit(step))
        spread = held.select("image_id", F.explode(F.transform(side, lambda d: F.col("x") + d)).alias("x"), "y", "best")
        spread = spread.select("image_id", "x", F.explode(F.transform(side, lambda d: F.col("y") + d)).alias("y"), F.col("best.idx").alias("idx"), F.col("best.px").alias("px"), F.col("best.py").alias("py"))
        inside = spread.where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))
        held = inside.groupBy("image_id", "x", "y").agg(F.min(_offer(F.col("x"), F.col("y"))).alias("best"))
    return held.select("image_id", (F.col("y") * width + F.col("x")).cast("int").alias("pix"), F.col("best.idx").alias("owner"), F.col("best.d2").alias("d2"))


def recover(flooded: DataFrame, pixels: DataFrame, points: DataFrame, width: int, height: int, n_hint: int) -> DataFrame:
    """``pixels`` with owner and d2 as flooded, and with lost points put back.

    A point is lost if it owns no pixel; in an image with pixels that nothing has
    reached, every point takes part. A pixel goes to the nearest of these if that is
    strictly nearer than its owner. Owner is -1 and d2 null in images without points.
    """
    shown = pixels.join(flooded, ["image_id", "pix"], "left")
    unfilled = shown.where("owner is null").select("image_id").distinct()
    lost = without_pixels(points, flooded)
    lost = scratch(lost.unionByName(points.join(unfilled, "image_id", "left_semi")).distinct(), "lost")
    if lost.isEmpty():
        return shown.withColumn("owner", F.coalesce("owner", F.lit(-1)))
    nearest = assign_nearest(pixels.join(lost.select("image_id").distinct(), "image_id", "left_semi"), lost, width, height, n_hint)
    other = nearest.select("image_id", "pix", F.col("owner").alias("__owner"), F.col("d2").alias("__d2"))
    both = shown.join(other, ["image_id", "pix"], "left")
    better = F.col("__d2").isNotNull() & (F.col("d2").isNull() | (F.col("__d2") < F.col("d2")))
    owner = F.when(better, F.col("__owner")).otherwise(F.coalesce("owner", F.lit(-1)))
    return both.withColumns({"owner": owner, "d2": F.when(better, F.col("__d2")).otherwise(F.col("d2"))}).drop("__owner", "__d2")


def jump_flood(pixels: DataFrame, points: DataFrame, width: int, height: int, n_hint: int, steps: list[int] | None = None) -> DataFrame:
    """``pixels`` with owner and d2 by jump flooding with recovery: nearly the nearest point of each pixel, in log2(side) + 2 rounds whatever the points are."""
    return recover(scratch(flood(points, width, height, steps), "flooded"), pixels, points, width, height, n_hint)
