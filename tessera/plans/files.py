"""Queries over sources and sinks: each writes files from a table into the shared folder, reads them back and returns what was read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import hashing as H
from tessera.functions import scalars as S
from tessera.operators import aggregates as A
from tessera.operators import curves as C
from tessera.operators import grid as G
from tessera.operators import merge as M
from tessera.operators import nearest as N
from tessera.operators import sampling as P
from tessera.plans import fixtures as X
from tessera.plans import sampler
from tessera.plans.queries import r6
from tessera.plans.registry import query
from tessera.session import shared_dir
from tessera.sources import arrays, blobs, manifests
from tessera.streaming import counts

SIZE = (X.WIDTH, X.HEIGHT)


def folder(spark: SparkSession, label: str) -> str:
    """A new folder in the shared one, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def exported(files: DataFrame, label: str) -> str:
    at = folder(files.sparkSession, label)
    blobs.write_files(files, at)
    return at


def exported_pieces(held: DataFrame, label: str) -> str:
    at = folder(held.sparkSession, label)
    arrays.write_pieces(held, at)
    return at


def colours(spark: SparkSession, d: str) -> DataFrame:
    """Pixels with bytes and floats of colour from the quantities of orders."""
    p = X.pixels(spark, d).withColumns({"r8": (F.col("density") % 256).cast("int"), "g8": ((F.col("density") * 3) % 256).cast("int"), "b8": (F.col("pix") % 256).cast("int")})
    return p.withColumns({"r": F.col("density") % 8 / 8, "g": F.col("density") % 16 / 16, "b": F.col("density") % 32 / 32})


_COLOURS_ONLY = f"WITH {X.PIXELS}, colours AS (SELECT *, (density % 256)::INTEGER AS r8, ((density * 3) % 256)::INTEGER AS g8, (pix % 256)::INTEGER AS b8, density % 8 / 8 AS r, density % 16 / 16 AS g, density % 32 / 32 AS b FROM pixels)"
_COLOURS = _COLOURS_ONLY + " "


@query(_COLOURS + "SELECT pix, x, y, r::FLOAT::DOUBLE AS r, g::FLOAT::DOUBLE AS g, b::FLOAT::DOUBLE AS b FROM colours")
def npy_images(spark: SparkSession, d: str) -> DataFrame:
    """S3, K3: renders as [3, H, W] arrays."""
    at = exported(arrays.render_files(colours(spark, d), *SIZE), "renders")
    return arrays.read_images(spark, at).select("pix", "x", "y", *[F.col(c).cast("double").alias(c) for c in "rgb"])


_FLOATS = ", ".join(f"{c}::FLOAT AS {c}" for c in (*arrays.STATE, "weight"))


@query(f"""WITH {X.SPLATS}, f AS (SELECT row_number() OVER (ORDER BY idx) - 1 AS n, idx, {_FLOATS} FROM splats), v AS (
  SELECT n, 'points' AS name, 2 AS k, [x, y] AS held FROM f UNION ALL SELECT n, 'cov', 3, [lc_xx, lc_xy, lc_yy] FROM f UNION ALL SELECT n, 'rgb', 3, [r, g, b] FROM f
  UNION ALL SELECT n, 'color', 3, [least(1, greatest(0, r * weight)), least(1, greatest(0, g * weight)), least(1, greatest(0, b * weight))] FROM f
  UNION ALL SELECT n, 'weights', 1, [weight] FROM f UNION ALL SELECT n, 'ids', 1, [idx * 1000] FROM f UNION ALL SELECT n, 'slots', 1, [idx % 97] FROM f)
SELECT name, n * k + j AS i, round(held[j + 1]::DOUBLE, 5) + 0.0 AS value FROM v, range(3) t(j) WHERE j < k""")
def splat_arrays(spark: SparkSession, d: str) -> DataFrame:
    """The array files of splats with tracks, element by element."""
    tracked = X.splats(spark, d).withColumns({"track_id": F.col("idx").cast("long") * 1000, "slot": F.col("idx") % 97})
    found = arrays.read_arrays(spark, exported_pieces(arrays.splat_pieces(tracked), "splats"))
    return found.select(F.regexp_extract("path", r"([a-z]+)\.npy$", 1).alias("name"), "i", (F.round("value", 5) + 0.0).alias("value"))


@query(f"WITH {X.SPLATS} SELECT (row_number() OVER (ORDER BY idx) - 1)::INTEGER AS idx, " + ", ".join(f"round({c}::FLOAT::DOUBLE, 5) + 0.0 AS {c}" for c in arrays.STATE) + " FROM splats")
def array_triple(spark: SparkSession, d: str) -> DataFrame:
    """Points, covariances and colours joined by place."""
    at = exported_pieces(arrays.splat_pieces(X.splats(spark, d)), "triple")
    found = arrays.read_triple(spark, *[f"{at}/0.{n}.npy" for n in ("points", "cov", "rgb")])
    return found.select("idx", *[(F.round(c, 5) + 0.0).alias(c) for c in arrays.STATE])


def _states(spark: SparkSession, d: str) -> DataFrame:
    first = X.splats(spark, d).withColumn("k", F.lit(0))
    return first.unionByName(first.withColumns({"k": F.lit(1), "lc_xx": F.col("lc_xx") + 0.25, "r": F.col("g"), "g": F.col("r")}))


@query(f"""WITH {X.SPLATS}, s AS (SELECT 0 AS k, * FROM splats UNION ALL SELECT 1, * REPLACE (lc_xx + 0.25 AS lc_xx, g AS r, r AS g) FROM splats)
SELECT k, (row_number() OVER (PARTITION BY k ORDER BY idx) - 1)::INTEGER AS idx, """ + ", ".join(f"round({c}::FLOAT::DOUBLE, 5) + 0.0 AS {c}" for c in arrays.STATE) + """, 32 AS width, 32 AS height, 'parts' AS origin FROM s""")
def scene_states(spark: SparkSession, d: str) -> DataFrame:
    """A scene of two states, its frame size and notes."""
    found = arrays.read_scenes(spark, exported_pieces(arrays.scene_pieces(_states(spark, d), *SIZE, {"origin": "parts"}), "scenes"))
    return found.select("k", "idx", *[(F.round(F.col(c).cast("double"), 5) + 0.0).alias(c) for c in arrays.STATE], "width", "height", F.get_json_object("meta", "$.origin").alias("origin"))


@query(f"""WITH {X.SPLATS}, s AS (SELECT 0 AS k, * FROM splats UNION ALL SELECT 1, * REPLACE (lc_xy + 0.5 AS lc_xy, b AS r) FROM splats)
SELECT k, (row_number() OVER (PARTITION BY k ORDER BY idx) - 1)::INTEGER AS idx, round(x::FLOAT::DOUBLE, 5) + 0.0 AS x, round(lc_xy::FLOAT::DOUBLE, 5) + 0.0 AS lc_xy, round(r::FLOAT::DOUBLE, 5) + 0.0 AS r, 32 AS width, 32 AS height FROM s""")
def sample_archive(spark: SparkSession, d: str) -> DataFrame:
    """S6 (second layout), K1: points, density, first and final attributes; the frame size follows from the density."""
    s = X.splats(spark, d)
    both = s.select("image_id", "idx", "x", "y", *[F.col(c).alias(f"init_{c}") for c in arrays.STATE[2:]], *[F.col(c).alias(f"final_{c}") for c in arrays.STATE[2:]])
    both = both.withColumns({"final_lc_xy": F.col("final_lc_xy") + 0.5, "final_r": F.col("final_b")})
    found = arrays.read_scenes(spark, exported_pieces(arrays.sample_pieces(both, X.pixels(spark, d)), "samples"))
    return found.select("k", "idx", *[(F.round(F.col(c).cast("double"), 5) + 0.0).alias(c) for c in ("x", "lc_xy", "r")], "width", "height")


@query(f"""WITH {X.SPLATS}, f AS (SELECT (row_number() OVER (ORDER BY idx) - 1)::INTEGER AS n, x::FLOAT AS x, y::FLOAT AS y, (idx % 9 * 0.25)::FLOAT AS s1, (idx % 5 * 0.5 + 0.125)::FLOAT AS s2, (idx % 7 * 0.375)::FLOAT AS theta, r::FLOAT AS r FROM splats)
SELECT n AS idx, round((x * 1.6::FLOAT)::DOUBLE, 4) AS x, round((y * 2.0::FLOAT)::DOUBLE, 4) AS y, round((1::FLOAT / greatest(1::FLOAT / greatest(s1, 0.01::FLOAT), 0.01::FLOAT))::DOUBLE, 4) AS s1, round((1::FLOAT / greatest(1::FLOAT / greatest(s2, 0.01::FLOAT), 0.01::FLOAT))::DOUBLE, 4) AS s2, theta::DOUBLE AS theta, round(r::DOUBLE, 4) AS r, 20 AS width, 16 AS height FROM f""")
def packed_splats(spark: SparkSession, d: str) -> DataFrame:
    """The packed form, of a cropped frame."""
    i = F.col("idx")
    s = X.splats(spark, d).withColumns({"s1": i % 9 * 0.25, "s2": i % 5 * 0.5 + 0.125, "theta": i % 7 * 0.375})
    found = arrays.read_splats(spark, exported(arrays.packed_files(s, *SIZE, (20, 16)), "packed"))
    four = lambda c: F.round(F.col(c).cast("double"), 4).alias(c)
    return found.select("idx", four("x"), four("y"), four("s1"), four("s2"), F.col("theta").cast("double").alias("theta"), four("r"), "width", "height")


@query(f"WITH {X.PIXELS} SELECT pix, x, y, " + ", ".join(f"round({e}::FLOAT::DOUBLE, 5) + 0.0 AS {n}" for n, e in (("density", "density"), ("lc_xx", "lc_xx"), ("lc_xy", "lc_xy"), ("lc_yy", "lc_yy"), ("map_r", "map_r"), ("map_g", "map_g"), ("map_b", "map_b"), ("rate", "(density + 1) / 64"))) + " FROM pixels")
def external_layers(spark: SparkSession, d: str) -> DataFrame:
    """The maps of an image from four files."""
    at = exported(arrays.map_files(X.pixels(spark, d).withColumn("rate", (F.col("density") + 1) / 64), *SIZE), "maps")
    found = arrays.external_maps(spark, at, "0")
    return found.select("pix", F.col("x").cast("int").alias("x"), "y", *[(F.round(c, 5) + 0.0).alias(c) for c in ("density", "lc_xx", "lc_xy", "lc_yy", "map_r", "map_g", "map_b", "rate")])


@query(_COLOURS + "SELECT pix, x, y, round((r8::FLOAT / 255::FLOAT)::DOUBLE, 6) AS r, round((g8::FLOAT / 255::FLOAT)::DOUBLE, 6) AS g, round((b8::FLOAT / 255::FLOAT)::DOUBLE, 6) AS b FROM colours")
def encoded_images(spark: SparkSession, d: str) -> DataFrame:
    """Pixels of an encoded image file."""
    found = arrays.read_encoded(spark, exported(arrays.bmp_files(colours(spark, d), *SIZE), "encoded"))
    return found.select("pix", "x", "y", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in "rgb"])


@query(_COLOURS + """, tx AS (
  SELECT g AS to_, src, CASE WHEN sh < 0 THEN ceil(sh - 0.5) ELSE floor(sh + 0.5) END::BIGINT AS tap FROM (
    SELECT g, src, raw / sum(raw) OVER (PARTITION BY g) * 4194304.0::DOUBLE AS sh FROM (
      SELECT g, src, CASE WHEN q < 1 THEN (1.5::DOUBLE * q - 2.5::DOUBLE) * q * q + 1 WHEN q < 2 THEN (((q - 5) * q + 8) * q - 4) * -0.5::DOUBLE ELSE 0.0::DOUBLE END AS raw FROM (
        SELECT g, src, abs((src - c + 0.5::DOUBLE) / w) AS q FROM (SELECT g, (g + 0.5::DOUBLE) * (32::DOUBLE / 20) AS c, greatest(32::DOUBLE / 20, 1.0::DOUBLE) AS w FROM range(20) t(g)) o, range(32) s(src)
        WHERE src >= floor(c - 2 * w + 0.5::DOUBLE) AND src < floor(c + 2 * w + 0.5::DOUBLE))))), ty AS (
  SELECT g AS to_, src, CASE WHEN sh < 0 THEN ceil(sh - 0.5) ELSE floor(sh + 0.5) END::BIGINT AS tap FROM (
    SELECT g, src, raw / sum(raw) OVER (PARTITION BY g) * 4194304.0::DOUBLE AS sh FROM (
      SELECT g, src, CASE WHEN q < 1 THEN (1.5::DOUBLE * q - 2.5::DOUBLE) * q * q + 1 WHEN q < 2 THEN (((q - 5) * q + 8) * q - 4) * -0.5::DOUBLE ELSE 0.0::DOUBLE END AS raw FROM (
        SELECT g, src, abs((src - c + 0.5::DOUBLE) / w) AS q FROM (SELECT g, (g + 0.5::DOUBLE) * (32::DOUBLE / 48) AS c, greatest(32::DOUBLE / 48, 1.0::DOUBLE) AS w FROM range(48) t(g)) o, range(32) s(src)
        WHERE src >= floor(c - 2 * w + 0.5::DOUBLE) AND src < floor(c + 2 * w + 0.5::DOUBLE))))), h AS (SELECT y, to_ AS x, greatest(0, least(255, (sum(r8 * tap) + 2097152) >> 22))::INTEGER AS r8, greatest(0, least(255, (sum(g8 * tap) + 2097152) >> 22))::INTEGER AS g8, greatest(0, least(255, (sum(b8 * tap) + 2097152) >> 22))::INTEGER AS b8 FROM colours JOIN tx ON x = src GROUP BY y, to_), v AS (SELECT x, to_ AS y, greatest(0, least(255, (sum(r8 * tap) + 2097152) >> 22))::INTEGER AS r8, greatest(0, least(255, (sum(g8 * tap) + 2097152) >> 22))::INTEGER AS g8, greatest(0, least(255, (sum(b8 * tap) + 2097152) >> 22))::INTEGER AS b8 FROM h JOIN ty ON y = src GROUP BY x, to_) SELECT (y * 20 + x)::INTEGER AS pix, x::INTEGER AS x, y::INTEGER AS y, r8, g8, b8 FROM v""")
def resized_images(spark: SparkSession, d: str) -> DataFrame:
    """An encoded image, resized to a given size as it is read."""
    width, height = 20, 48
    read = arrays.read_encoded(spark, exported(arrays.bmp_files(colours(spark, d), *SIZE), "to-resize"))
    held = read.select(F.lit(0).cast("long").alias("image_id"), "x", "y", *[F.rint(F.col(c) * 255).cast("int").alias(f"{c}8") for c in "rgb"])
    return G.resize_bicubic(held, *SIZE, width, height, ["r8", "g8", "b8"]).select("pix", "x", "y", "r8", "g8", "b8")


@query(_COLOURS + "SELECT (py * 40 + px)::INTEGER AS pix, px::INTEGER AS x, py::INTEGER AS y, r8 / 255.0::DOUBLE AS r, g8 / 255.0::DOUBLE AS g, b8 / 255.0::DOUBLE AS b FROM range(40) a(px), range(40) c(py) JOIN colours ON pix = least(py, 31) * 32 + least(px, 31)")
def planar_pixels(spark: SparkSession, d: str) -> DataFrame:
    """Bytes as floats, padded to a multiple."""
    p = manifests.planar(colours(spark, d).select("image_id", "pix", "x", "y", "r8", "g8", "b8"))
    return G.edge_pad(p, *SIZE, 20, ["r", "g", "b"]).select("pix", "x", "y", "r", "g", "b")


@query("""WITH f AS (SELECT r_name || '/' || n_name || '.txt' AS path, n_nationkey AS k, 'nation ' || n_name AS content FROM nation JOIN region ON r_regionkey = n_regionkey)
SELECT path, CASE WHEN k % 5 = 0 THEN sha256('other') ELSE sha256(content) END AS sha256, (length(content) + CASE WHEN k % 7 = 1 THEN 1 ELSE 0 END)::BIGINT AS bytes,
       CASE WHEN k % 11 = 2 THEN 'missing' WHEN k % 7 = 1 THEN 'size' WHEN k % 5 = 0 THEN 'digest' END AS problem FROM f""")
def bundle_check(spark: SparkSession, d: str) -> DataFrame:
    """A bundle's files by relative path, size and digest."""
    n, r = X.table(spark, d, "nation"), X.table(spark, d, "region")
    f = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat("r_name", F.lit("/"), "n_name", F.lit(".txt")).alias("path"), F.col("n_nationkey").alias("k"), F.concat(F.lit("nation "), "n_name").alias("content"))
    at = exported(f.where("k % 11 <> 2").select(F.col("path").alias("name"), F.col("content").cast("binary").alias("content")), "bundle")
    digest = F.when(F.col("k") % 5 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.sha2("content", 256))
    size = (F.length("content") + F.when(F.col("k") % 7 == 1, 1).otherwise(0)).cast("long")
    listed = f.agg(F.to_json(F.struct(F.lit("nations").alias("name"), F.collect_list(F.struct("path", digest.alias("sha256"), size.alias("bytes"))).alias("files"))).cast("binary").alias("content"))
    manifest = exported(listed.select(F.lit("manifest.json").alias("name"), "content"), "manifest")
    return manifests.bundle_files(spark, f"{manifest}/manifest.json", at).drop("good")


@query("SELECT 'in/' || s_suppkey AS input, CASE WHEN s_suppkey % 4 <> 1 THEN 'out/' || s_nationkey END AS render FROM supplier WHERE s_suppkey % 3 <> 0")
def pair_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Lines of other than two fields, comments and blanks are passed over."""
    s = F.col("s_suppkey")
    two = F.concat(F.lit(" in/"), s, F.lit("\t"), F.when(s % 4 == 1, F.lit("-")).otherwise(F.concat(F.lit("out/"), "s_nationkey")))
    line = F.when(s % 6 == 0, F.concat(F.lit("# in/"), s)).when(s % 9 == 3, F.lit("  ")).when(s % 3 == 0, F.concat(two, F.lit(" more"))).otherwise(two)
    return manifests.parse_manifest(X.table(spark, d, "supplier").select(line.alias("value")), strict=False).select("input", "render")


@query(f"WITH {X.SPLATS} SELECT k::INTEGER AS k, CASE WHEN k = 0 THEN 'initializer' ELSE 'refinement ' || k END AS label, count(*) AS n, sum(idx)::BIGINT AS points, sum((r * 16)::BIGINT)::BIGINT AS red, sum((g * 22)::BIGINT)::BIGINT AS green FROM splats, range(3) t(k) GROUP BY k")
def labelled_states(spark: SparkSession, d: str) -> DataFrame:
    """The splats of every labelled state, and sums of what they hold."""
    states = X.splats(spark, d).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return sampler.label_states(states).groupBy("k", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("idx").alias("points"), F.sum(F.rint(F.col("r") * 16).cast("long")).alias("red"), F.sum(F.rint(F.col("g") * 22).cast("long")).alias("green"))


@query()
def image_seeds(spark: SparkSession, d: str) -> DataFrame:
    """F12 (no SQL: BLAKE2; a test holds it against the plain function)."""
    return H.content_seeds(colours(spark, d), *SIZE, 7)


_CELLS = f"WITH {X.PIXELS}, {X.POINTS}, {X.OWNED}"


@query(_CELLS + " SELECT idx, row_number() OVER (ORDER BY ((mass - 20) * 0.37)::FLOAT, idx) AS place FROM cells")
def float_keys(spark: SparkSession, d: str) -> DataFrame:
    """F16: a key that orders like (32-bit float, index), for values below and above zero."""
    points = X.points(spark, d)
    cells = A.cell_mass(points, N.assign_nearest(X.pixels(spark, d), points, *SIZE, points.count()))
    key = S.order_key((F.col("mass") - 20) * 0.37, F.col("idx"))
    from pyspark.sql import Window

    return cells.select("idx", F.row_number().over(Window.partitionBy("image_id").orderBy(key)).cast("long").alias("place"))


@query(_CELLS + ", k AS (SELECT idx, x, y, mass, (idx - idx % 3 + 1)::INTEGER AS g FROM cells), s AS (SELECT g, sum(mass) AS m, sum(mass * x) AS mx, sum(mass * y) AS my FROM k GROUP BY g) SELECT (row_number() OVER (ORDER BY k.idx) - 1)::INTEGER AS idx, round(CASE WHEN m > 1e-8 THEN mx / m ELSE x END, 6) + 0.0 AS x, round(CASE WHEN m > 1e-8 THEN my / m ELSE y END, 6) + 0.0 AS y FROM k JOIN s USING (g) WHERE k.idx = k.g OR k.g NOT IN (SELECT idx FROM cells)")
def merge_centroids(spark: SparkSession, d: str) -> DataFrame:
    """Two cells of three merge into the third, and the survivors are numbered anew."""
    points = X.points(spark, d)
    cells = A.cell_mass(points, N.assign_nearest(X.pixels(spark, d), points, *SIZE, points.count()))
    to = (F.col("idx") - F.col("idx") % 3 + 1).cast("int")
    there = cells.select("image_id", F.col("idx").alias("target"))
    merged = cells.select("image_id", "idx", to.alias("target")).where("idx <> target").join(there, ["image_id", "target"], "left_semi")
    return M.merge_into(cells, merged.select("image_id", "idx", "target")).select("idx", *r6(x=F.col("x"), y=F.col("y")))


@query("""WITH RECURSIVE c AS (SELECT c_custkey AS id, (c_custkey * 37 % 500 + 1)::BIGINT AS n FROM customer), o AS (
  SELECT id, n, greatest(n + 1, floor(n * 1.5 + 0.5))::BIGINT AS fused, greatest(n + 1, round_even(n * 1.5, 0))::BIGINT AS reference, greatest(n, ceil(n * 1.5))::BIGINT AS web FROM c
), r AS (SELECT id, n, fused, reference, web, fused AS now, 0 AS k, 0::BIGINT AS removed FROM o
  UNION ALL SELECT id, n, fused, reference, web, now - CASE WHEN k = 2 THEN now - n ELSE least(now - n, greatest(1, now // 3)) END, k + 1, CASE WHEN k = 2 THEN now - n ELSE least(now - n, greatest(1, now // 3)) END FROM r WHERE k < 3)
SELECT id, fused, reference, web, max(removed) FILTER (k = 1) AS first, max(removed) FILTER (k = 2) AS second, max(removed) FILTER (k = 3) AS third FROM r GROUP BY id, fused, reference, web""")
def merge_schedules(spark: SparkSession, d: str) -> DataFrame:
    """M1, M6': how many points each of three rounds removes, and from how many points the profiles start."""
    c = X.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 37 % 500 + 1).cast("long").alias("n"))
    c = c.withColumns({p: M.oversampled(F.col("n"), p) for p in ("fused", "reference", "web")}).withColumn("now", F.col("fused"))
    for k, name in enumerate(("first", "second", "third")):
        c = c.withColumn(name, M.removal(F.col("now"), F.col("n"), k == 2)).withColumn("now", F.col("now") - F.col(name))
    return c.drop("now", "n")


@query(f"WITH {X.PIXELS}, p AS (SELECT pix, x, y FROM pixels WHERE x < 4 AND y < 4), s AS (SELECT count(*) AS n, count(DISTINCT (x, y)) AS places FROM p) SELECT n * 5 AS n_points, n AS pixels, 5::BIGINT AS uses FROM s")
def repeated_pixels(spark: SparkSession, d: str) -> DataFrame:
    """A tile with five times as many points as pixels uses every pixel five times, at different places."""
    few = X.pixels(spark, d).where("x < 4 and y < 4").withColumn("pix", (F.col("y") * 4 + F.col("x")).cast("int")).withColumn("density", F.col("density") + 1)
    drawn = P.sample_points(few, 80, 4, 4, 12345, tile=4).select("idx", "x", "y", G.pixel_of(F.col("x"), F.col("y"), 4, 4).alias("pix"))
    uses = drawn.groupBy("pix").agg(F.countDistinct("x", "y").alias("uses"))
    return uses.agg(F.sum("uses").alias("n_points"), F.count(F.lit(1)).alias("pixels"), F.max("uses").alias("uses"))


@query("""WITH v AS (SELECT p_partkey % 5 AS tensor, CASE WHEN p_partkey % 5 % 3 = 2 THEN p_size ELSE (p_size % 13) * 0.25::DOUBLE - 1 END AS value, row_number() OVER (PARTITION BY p_partkey % 5 ORDER BY p_partkey) - 1 AS i FROM part)
SELECT 'tensor' || tensor AS name, ['f16', 'f32', 'u8'][(tensor % 3 + 1)::INTEGER] AS kind, (count(*) OVER (PARTITION BY tensor))::INTEGER AS n, i, value::DOUBLE AS value FROM v WHERE tensor <> 3""")
def blob_tensors(spark: SparkSession, d: str) -> DataFrame:
    """A weight blob, written and read again by ranges of bytes; of one tensor nothing is read."""
    tensor = F.col("p_partkey") % 5
    value = F.when(tensor % 3 == 2, F.col("p_size").cast("double")).otherwise(F.col("p_size") % 13 * 0.25 - 1)
    held = X.table(spark, d, "part").groupBy(tensor.cast("int").alias("tensor")).agg(F.sort_array(F.collect_list(F.struct("p_partkey", value.alias("v")))).alias("s"))
    kind = F.element_at(F.array(*[F.lit(k) for k in blobs.KINDS]), F.col("tensor") % 3 + 1)
    at = exported(blobs.blob_files(held.select(F.lit("weights").alias("blob"), "tensor", kind.alias("kind"), F.transform("s", lambda x: x["v"]).alias("values"))), "blobs")
    found = blobs.read_blobs(spark, at).where(F.col("name").isin("tensor0", "tensor1", "tensor2", "tensor4"))
    return found.select("name", "kind", F.element_at("shape", 1).alias("n"), "i", "value")


@query("""WITH RECURSIVE c AS (SELECT user_id % 4 AS stream_id, ts::DATE AS day, count(DISTINCT user_id) AS n FROM events WHERE user_id IS NOT NULL GROUP BY 1, 2),
o AS (SELECT stream_id, n, row_number() OVER (PARTITION BY stream_id ORDER BY day) - 1 AS frame FROM c),
w AS (SELECT stream_id, frame, n, n::DOUBLE AS s FROM o WHERE frame = 0 UNION ALL SELECT o.stream_id, o.frame, o.n, 0.9::DOUBLE * w.s + (1 - 0.9::DOUBLE) * o.n FROM w JOIN o ON o.stream_id = w.stream_id AND o.frame = w.frame + 1)
SELECT stream_id, frame, n, round(s, 6) AS smoothed, greatest(1, round_even(s, 0))::BIGINT AS n_target FROM w""")
def streamed_counts(spark: SparkSession, d: str) -> DataFrame:
    """S12, V1, V2, V13 as a stream: a file a day and stream, taken in the order of their paths by two queries with one checkpoint; files of the later half of the days come between."""
    at = folder(spark, "frames")
    e = X.table(spark, d, "events").where("user_id is not null")
    daily = N.scratch(e.groupBy((F.col("user_id") % 4).alias("stream_id"), F.to_date("ts").alias("day")).agg(F.countDistinct("user_id").alias("n")), "daily")
    middle = daily.agg(F.date_add(F.min("day"), (F.datediff(F.max("day"), F.min("day")) / 2).cast("int"))).first()[0]
    for part in (F.col("day") <= F.lit(middle), F.col("day") > F.lit(middle)):
        daily.where(part).withColumns({"stream": F.col("stream_id"), "date": F.col("day")}).repartition("stream_id", "day").write.mode("append").partitionBy("stream", "date").json(f"{at}/in")
        frames = counts.frame_files(spark, f"{at}/in", "stream_id long, n long")
        counts.smooth_stream(frames, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return counts.smoothed_frames(spark, f"{at}/out").select("stream_id", "frame", "n", F.round("smoothed", 6).alias("smoothed"), "n_target")


_WALK = """walk AS (
  SELECT pix, 0::BIGINT AS d, x::BIGINT AS x, y::BIGINT AS y, 16::BIGINT AS s FROM pixels
  UNION ALL
  SELECT pix, d + s * s * CASE WHEN x & s > 0 THEN CASE WHEN y & s > 0 THEN 2 ELSE 3 END WHEN y & s > 0 THEN 1 ELSE 0 END,
         CASE WHEN y & s > 0 THEN x WHEN x & s > 0 THEN s - 1 - y ELSE y END, CASE WHEN y & s > 0 THEN y WHEN x & s > 0 THEN s - 1 - x ELSE x END, s // 2
  FROM walk WHERE s > 0
)"""


@query(f"""WITH RECURSIVE {X.PIXELS}, {_WALK}, o AS (
  SELECT p.x, p.y, p.density AS m, sum(p.density) OVER (ORDER BY d) AS cum, sum(p.density) OVER () AS total, row_number() OVER (ORDER BY d) - 1 AS j FROM pixels p JOIN walk w ON w.pix = p.pix AND w.s = 0
), cuts AS (SELECT i::INTEGER AS i, CASE WHEN i = 0 THEN 0 WHEN i = 700 THEN 1024 ELSE (SELECT count(*) FROM o WHERE cum <= total * i / 700) END AS a FROM range(701) t(i)
), stretches AS (SELECT i, a, lead(a) OVER (ORDER BY i) AS b FROM cuts
), sums AS (SELECT i, a, sum(m) AS mass, sum(m * (x + 0.5)) AS mx, sum(m * (y + 0.5)) AS my FROM stretches LEFT JOIN o ON j >= a AND j < b WHERE i < 700 GROUP BY i, a)
SELECT i AS idx, round(CASE WHEN mass > 1e-12 THEN mx / mass ELSE o.x + 0.5 END / 32, 6) + 0.0 AS x, round(CASE WHEN mass > 1e-12 THEN my / mass ELSE o.y + 0.5 END / 32, 6) + 0.0 AS y FROM sums JOIN o ON o.j = least(a, 1023)""")
def hilbert_seeding(spark: SparkSession, d: str) -> DataFrame:
    """700 points at the centroids of stretches of equal mass along the curve; pixels with several shares give several points."""
    return C.hilbert_seeds(X.pixels(spark, d), 700, *SIZE).select("idx", *r6(x=F.col("x"), y=F.col("y")))
