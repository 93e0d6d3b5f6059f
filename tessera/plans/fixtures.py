"""Image-shaped inputs derived from the relational test tables; every table is read whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import grid as G
from tessera.session import ship

WIDTH = HEIGHT = 32


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


def empty_grid(spark: SparkSession, width: int = WIDTH, height: int = HEIGHT) -> DataFrame:
    return G.pixel_grid(spark.range(1).withColumnRenamed("id", "image_id"), width, height)


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """32 x 32 pixels whose density is the quantity of the orders that fall on them, with maps made from the pixel number."""
    sums = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % (WIDTH * HEIGHT)).cast("int").alias("pix")).agg(F.sum("l_quantity").alias("density"))
    filled = G.fill_grid(empty_grid(spark), sums.withColumn("image_id", F.lit(0).cast("long")), ["density"])
    of = lambda m, a, s: (F.col("pix") % m - a) * s
    return filled.withColumns({"lc_xx": of(7, 3, 0.1), "lc_xy": of(5, 2, 0.05), "lc_yy": of(9, 4, 0.1), "map_r": of(11, 0, 0.1), "map_g": of(13, 0, 0.0625), "map_b": of(17, 0, 0.0625), "logit": of(19, 12, 0.5)})


def batch(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Three images of different density, one of them nearly empty, and the count and seed of each."""
    image, pix = (F.col("l_suppkey") % 3).alias("image_id"), (F.col("l_orderkey") % (WIDTH * HEIGHT)).cast("int").alias("pix")
    corner = (F.col("l_suppkey") % 3 != 2) | (F.col("l_orderkey") % 1024 < 200)
    sums = table(spark, d, "lineitem").select(image, pix, F.when(corner, F.col("l_quantity")).otherwise(0.0).alias("q")).groupBy("image_id", "pix").agg(F.sum("q").alias("density"))
    grid = G.pixel_grid(spark.range(3).withColumnRenamed("id", "image_id"), WIDTH, HEIGHT)
    counts = spark.range(3).select(F.col("id").alias("image_id"), (40 + 25 * F.col("id")).alias("n"), (12345 + F.col("id")).alias("seed"))
    return G.fill_grid(grid, sums, ["density"]), counts


def points(spark: SparkSession, d: str) -> DataFrame:
    """A point for each customer."""
    i = F.col("c_custkey").cast("int")
    place = lambda k, m: ((i * k) % m + 0.5) / m
    return table(spark, d, "customer").select(F.lit(0).cast("long").alias("image_id"), i.alias("idx"), place(37, 101).alias("x"), place(59, 103).alias("y"))


def splats(spark: SparkSession, d: str) -> DataFrame:
    """A splat for each part."""
    i = F.col("p_partkey").cast("int")
    place = lambda k, m: ((i * k) % m + 0.5) / m
    return table(spark, d, "part").select(
        F.lit(0).cast("long").alias("image_id"), i.alias("idx"), place(41, 97).alias("x"), place(53, 89).alias("y"),
        (i % 7 * 0.25 - 0.5).alias("lc_xx"), ((i % 5 - 2) * 0.125).alias("lc_xy"), (i % 11 * 0.125 - 0.5).alias("lc_yy"),
        (i % 17 / 16).alias("r"), (F.col("p_size") % 23 / 22).alias("g"), (i % 13 / 12).alias("b"), (i % 3 * 0.015625 + 0.015625).alias("weight"),
    )


def image(spark: SparkSession) -> DataFrame:
    return empty_grid(spark).withColumns({"r": F.col("pix") % 8 / 8.0, "g": F.col("pix") % 16 / 16.0, "b": F.col("pix") % 32 / 32.0})


def deltas(spark: SparkSession, rounds: int) -> DataFrame:
    ks = spark.range(rounds).select(F.col("id").cast("int").alias("k"))
    g = empty_grid(spark).crossJoin(F.broadcast(ks))  # as many copies of a small grid as there are rounds
    return g.select("image_id", "k", "pix", *[(((F.col("pix") * (i + 3) + F.col("k")) % 9 - 4) * 0.0078125).alias(f"d{i}") for i in range(8)])


def daily_counts(spark: SparkSession, d: str) -> DataFrame:
    """A stream whose frames are the days of the event table: distinct users of each."""
    e = table(spark, d, "events")
    return e.groupBy(F.to_date("ts").alias("day")).agg(F.countDistinct("user_id").alias("n")).select(F.lit(0).cast("long").alias("stream_id"), F.datediff("day", F.lit("2024-01-01")).cast("long").alias("frame"), "n")


def frames(spark: SparkSession, d: str, side: int = 16) -> DataFrame:
    """Four streams of frames with a 16 x 16 density: event values by user, day and stream."""
    e = table(spark, d, "events").where("user_id is not null")
    cells = e.groupBy((F.col("user_id") % 4).alias("stream_id"), F.datediff(F.to_date("ts"), F.lit("2024-01-01")).cast("long").alias("frame"), (F.expr("user_id div 4") % (side * side)).cast("int").alias("pix")).agg(F.sum(F.greatest("value", F.lit(0.0))).alias("v"))
    made = cells.groupBy("stream_id", "frame").agg(F.map_from_entries(F.collect_list(F.struct("pix", "v"))).alias("m"))
    density = F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda p: F.coalesce(F.try_element_at("m", p), F.lit(0.0)))
    return made.select("stream_id", "frame", (F.lit(20) + F.col("frame") % 5).cast("long").alias("n"), density.alias("density"))


#: The same inputs as SQL.
PIXELS = """pixels AS (
  SELECT 0::BIGINT AS image_id, g::INTEGER AS pix, (g % 32)::INTEGER AS x, (g // 32)::INTEGER AS y, coalesce(s.d, 0.0)::DOUBLE AS density,
         (g % 7 - 3) * 0.1::DOUBLE AS lc_xx, (g % 5 - 2) * 0.05::DOUBLE AS lc_xy, (g % 9 - 4) * 0.1::DOUBLE AS lc_yy,
         (g % 11) * 0.1::DOUBLE AS map_r, (g % 13) * 0.0625::DOUBLE AS map_g, (g % 17) * 0.0625::DOUBLE AS map_b, (g % 19 - 12) * 0.5::DOUBLE AS logit
  FROM range(1024) t(g) LEFT JOIN (SELECT l_orderkey % 1024 AS p, sum(l_quantity) AS d FROM lineitem GROUP BY 1) s ON s.p = g)"""
POINTS = """points AS (
  SELECT 0::BIGINT AS image_id, c_custkey::INTEGER AS idx, ((c_custkey * 37) % 101 + 0.5::DOUBLE) / 101 AS x, ((c_custkey * 59) % 103 + 0.5::DOUBLE) / 103 AS y FROM customer)"""
SPLATS = """splats AS (
  SELECT 0::BIGINT AS image_id, p_partkey::INTEGER AS idx, ((p_partkey * 41) % 97 + 0.5::DOUBLE) / 97 AS x, ((p_partkey * 53) % 89 + 0.5::DOUBLE) / 89 AS y,
         (p_partkey % 7) * 0.25::DOUBLE - 0.5::DOUBLE AS lc_xx, (p_partkey % 5 - 2) * 0.125::DOUBLE AS lc_xy, (p_partkey % 11) * 0.125::DOUBLE - 0.5::DOUBLE AS lc_yy,
         (p_partkey % 17) / 16.0::DOUBLE AS r, (p_size % 23) / 22.0::DOUBLE AS g, (p_partkey % 13) / 12.0::DOUBLE AS b,
         (p_partkey % 3) * 0.015625::DOUBLE + 0.015625::DOUBLE AS weight FROM part)"""
OWNED = """seeds AS (
  SELECT idx, greatest(0.0::DOUBLE, least(31.999::DOUBLE, x * 32.0::DOUBLE)) AS px, greatest(0.0::DOUBLE, least(31.999::DOUBLE, y * 32.0::DOUBLE)) AS py FROM points
), scored AS (
  SELECT p.*, s.idx AS owner, (p.x + 0.5::DOUBLE - s.px) * (p.x + 0.5::DOUBLE - s.px) + (p.y + 0.5::DOUBLE - s.py) * (p.y + 0.5::DOUBLE - s.py) AS d2 FROM pixels p CROSS JOIN seeds s
), owned AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY pix ORDER BY d2, owner) = 1
), cells AS (
  SELECT q.image_id, q.idx, q.x, q.y, coalesce(m.mass, 0.0)::DOUBLE AS mass, coalesce(m.n, 0)::BIGINT AS n_pixels
  FROM points q LEFT JOIN (SELECT owner, sum(density) AS mass, count(*) AS n FROM owned GROUP BY owner) m ON m.owner = q.idx)"""
