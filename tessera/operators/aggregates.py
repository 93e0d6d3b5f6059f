"""Sums and moments over images, cells and tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators.select import at_ranks, quantiles

EMPTY = 1e-8


def density_from_logits(pixels: DataFrame, logit: str = "logit") -> DataFrame:
    """``pixels`` with density: exponentials with a mean of 1 in each image. Two aggregations, joined by image."""
    top = pixels.groupBy("image_id").agg(F.max(logit).alias("top"))
    raised = pixels.join(top, "image_id").withColumn("raised", F.exp(F.col(logit) - F.col("top")))
    mean = raised.groupBy("image_id").agg(F.avg("raised").alias("mean"))
    return raised.join(mean, "image_id").withColumn("density", F.col("raised") / (F.col("mean") + 1e-8)).drop("top", "raised", "mean")


def auto_counts(pixels: DataFrame, width: int, height: int, logit: str = "logit") -> DataFrame:
    """The number of points each image asks for, as the profiles count them."""
    total = F.sum(S.rate(F.col(logit)))
    out = pixels.groupBy("image_id").agg(total.alias("rate_sum"), F.sum(F.exp(F.col(logit))).alias("plain_sum"))
    most = min(1_000_000, max(1, int(0.40 * width * height)))
    one = F.lit(1).cast("long")
    return out.select(
        "image_id",
        "rate_sum",
        F.col("plain_sum").alias("rate_sum_aligned"),
        F.greatest(one, F.rint("rate_sum").cast("long")).alias("n_reference"),
        F.greatest(one, F.floor("rate_sum")).alias("n_production"),
        F.least(F.lit(most).cast("long"), F.greatest(one, F.floor("rate_sum"))).alias("n_fused"),
    )


def sampling_density(pixels: DataFrame, n: int | Column, anisotropy: Column | None = None) -> DataFrame:
    """Density scaled so that it sums to ``n`` in each image, after weighting by anisotropy if given; unchanged if there is none."""
    d = S.positive_or_zero(F.col("density"))
    weighted = d * F.greatest(anisotropy, F.lit(1.0)) if anisotropy is not None else d
    totals = pixels.groupBy("image_id").agg(F.sum(weighted).alias("total"))
    scaled = F.when(F.col("total") > EMPTY, weighted * (F.lit(float(n)) if isinstance(n, int) else n.cast("double")) / F.col("total")).otherwise(weighted)
    return pixels.join(totals, "image_id").withColumn("sampling", scaled).drop("total")


def tile_mass(pixels: DataFrame, tile: Column) -> DataFrame:
    return pixels.groupBy("image_id", tile.alias("tile")).agg(F.sum(S.positive_or_zero(F.col("density"))).alias("mass"))


def cell_mass(points: DataFrame, owned: DataFrame) -> DataFrame:
    """mass and n_pixels of each point (image_id, idx) from ``owned`` (image_id, owner, density); 0 for points that own nothing."""
    sums = owned.groupBy("image_id", F.col("owner").alias("idx")).agg(F.sum("density").alias("mass"), F.count(F.lit(1)).alias("n_pixels"))
    return points.join(sums, ["image_id", "idx"], "left").fillna(0, ["mass", "n_pixels"])


def cell_moments(owned: DataFrame) -> DataFrame:
    """Mass, mean and covariance of the pixel centres of each cell, weighted by density, or evenly if a cell has no mass."""
    px, py, d = F.col("x") + 0.5, F.col("y") + 0.5, F.col("density")
    terms = {"x": px, "y": py, "xx": px * px, "xy": px * py, "yy": py * py}
    sums = owned.groupBy("image_id", F.col("owner").alias("idx")).agg(F.sum(d).alias("mass"), F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(d * t).alias(f"w_{k}") for k, t in terms.items()], *[F.sum(t).alias(f"u_{k}") for k, t in terms.items()])
    some = F.col("mass") > 1e-12
    mean = {k: F.when(some, F.col(f"w_{k}") / F.when(some, F.col("mass"))).otherwise(F.col(f"u_{k}") / F.col("n")) for k in terms}
    return sums.select("image_id", "idx", "mass", "n", *[mean[k].alias(f"m_{k}") for k in terms]).select(
        "image_id", "idx", "mass", F.col("n").cast("long").alias("n_pixels"), "m_x", "m_y",
        F.greatest(F.col("m_xx") - F.col("m_x") * F.col("m_x"), F.lit(0.0)).alias("var_x"),
        F.greatest(F.col("m_yy") - F.col("m_y") * F.col("m_y"), F.lit(0.0)).alias("var_y"),
        (F.col("m_xy") - F.col("m_x") * F.col("m_y")).alias("cov_xy"),
    )


def lloyd_centroids(points: DataFrame, owned: DataFrame, width: int, height: int) -> DataFrame:
    """Each point at the density-weighted centroid of its cell; unmoved if the cell has no mass."""
    px, py, d = F.col("x") + 0.5, F.col("y") + 0.5, F.col("density")
    sums = owned.groupBy("image_id", F.col("owner").alias("idx")).agg(F.sum(d).alias("__m"), F.sum(d * px).alias("__x"), F.sum(d * py).alias("__y"))
    some = F.col("__m") > EMPTY
    move = lambda c, s, n: F.when(some, S.clamp(F.col(s) / F.when(some, F.col("__m")) / n, 0.0, 1.0)).otherwise(F.col(c))
    return points.join(sums, ["image_id", "idx"], "left").withColumns({"x": move("x", "__x", width), "y": move("y", "__y", height)}).drop("__m", "__x", "__y")


def normalised_weights(cells: DataFrame) -> DataFrame:
    """``cells`` with weight: mass over the mean mass of the image's cells."""
    totals = cells.groupBy("image_id").agg(F.sum("mass").alias("total"), F.count(F.lit(1)).alias("n"))
    return cells.join(totals, "image_id").withColumn("weight", F.col("mass") * F.col("n") / F.greatest(F.col("total"), F.lit(EMPTY))).drop("total", "n")


def hard_counts(points: DataFrame, grid: DataFrame, pixel: Column) -> DataFrame:
    """Points in each pixel of ``grid``."""
    counts = points.groupBy("image_id", pixel.alias("pix")).agg(F.count(F.lit(1)).alias("n_points"))
    return grid.join(counts, ["image_id", "pix"], "left").fillna(0, ["n_points"])


def image_error(a: DataFrame, b: DataFrame, channels: tuple[str, ...] = ("r", "g", "b"), where: Column | None = None) -> DataFrame:
    """Squared error, mse and psnr of two images over their pixels, or those of a crop."""
    right = b.select("image_id", "pix", *[F.col(c).alias(f"__{c}") for c in channels])
    both = a.join(right, ["image_id", "pix"])
    both = both if where is None else both.where(where)
    squares = sum((((F.col(c) - F.col(f"__{c}")) * (F.col(c) - F.col(f"__{c}"))) for c in channels), F.lit(0.0))
    out = both.groupBy("image_id").agg(F.sum(squares).alias("squared_error"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("mse", F.col("squared_error") / (F.col("n") * len(channels))).withColumn("psnr", S.psnr(F.col("mse")))


def _with(aggregates: DataFrame, more: DataFrame, groups: list[str]) -> DataFrame:
    """The columns of both, by group; null groups are groups."""
    named = more.select(*[F.col(g).alias(f"__{g}") for g in groups], *[c for c in more.columns if c not in groups])
    on = F.lit(True)
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"__{g}"))
    return aggregates.join(named, on, "left").drop(*[f"__{g}" for g in groups])


def quantile_envelope(df: DataFrame, value: str, groups: list[str], limit: float = 0.5) -> DataFrame:
    """Median, high percentiles, maximum and the share over ``limit``; exact, by radix selection."""
    sums = df.groupBy(*groups).agg(F.max(value).alias("top"), F.avg((F.col(value) > limit).cast("double")).alias("share_over"))
    return _with(sums, quantiles(df, groups, value, {"p50": 0.5, "p95": 0.95, "p99": 0.99}), groups)


def latency_stats(df: DataFrame, value: str, groups: list[str]) -> DataFrame:
    """Mean, extremes, population deviation, median, deciles and the 99th percentile by rank (rounded up); exact, by radix selection."""
    sums = df.groupBy(*groups).agg(F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("top"), F.stddev_pop(value).alias("deviation"))
    ranks = df.groupBy(*groups).agg(F.ceil(F.count(value) * F.lit(0.99)).cast("long").alias("rank")).where("rank > 0")
    high = at_ranks(df, groups, value, ranks).select(*groups, F.col("value").alias("p99"))
    return _with(_with(sums, quantiles(df, groups, value, {"median": 0.5, "p10": 0.1, "p90": 0.9}), groups), high, groups)
