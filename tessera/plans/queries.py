"""Queries over the operators, each with the SQL that should give the same rows where there is such SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import hashing as H
from tessera.functions import scalars as S
from tessera.operators import aggregates as A
from tessera.operators import flooding as J
from tessera.operators import grid as G
from tessera.operators import merge as M
from tessera.operators import nearest as N
from tessera.operators import render as R
from tessera.operators import sampling as P
from tessera.plans import fixtures as X
from tessera.plans import sampler
from tessera.plans.registry import QUERIES, SQL, query  # noqa: F401
from tessera.sources import manifests
from tessera.streaming import tracks

SIZE = (X.WIDTH, X.HEIGHT)
SEED = 12345


def r6(**columns: Column) -> list[Column]:
    """Columns rounded to six places, as engines differ in the last bits of transcendental functions."""
    return [(F.round(c, 6) + 0.0).alias(n) for n, c in columns.items()]


def _r(*names: str, **exprs: str) -> str:
    return ", ".join([f"round({n}, 6) + 0.0 AS {n}" for n in names] + [f"round({e}, 6) + 0.0 AS {n}" for n, e in exprs.items()])


def _owned(spark: SparkSession, d: str) -> DataFrame:
    points = X.points(spark, d)
    return N.scratch(N.assign_nearest(X.pixels(spark, d), points, *SIZE, points.count()), "owned")


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return A.cell_mass(X.points(spark, d), _owned(spark, d))


def _sql_unit(salt: str, seed: int = SEED, steps: int = 1) -> str:
    def mul(v: str, c: int) -> str:
        return f"((({v})::UHUGEINT * {c}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"

    v = f"(({seed}::UHUGEINT + ({H.GOLDEN}::UHUGEINT * (({salt}) + {steps})::UHUGEINT) % 18446744073709551616::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"
    for shift, c in ((30, H.MIX_A), (27, H.MIX_B)):
        v = mul(f"xor({v}, ({v}) >> {shift})", c)
    return f"((xor({v}, ({v}) >> 31) >> 11)::DOUBLE * {2.0**-53!r}::DOUBLE)"


# ---------------------------------------------------------------- scalars


@query("SELECT p_partkey AS id, " + _r(rate="exp(greatest(-20.0, least(8.0, l))) + 1e-8", sigmoid="1.0 / (1.0 + exp(-l))", psnr="-10.0 * log10(greatest(m, 1e-10))", shift="CASE WHEN p_size > 25 THEN ln(25.0 / p_size) ELSE 0.0 END") + " FROM (SELECT *, (p_partkey % 41 - 25) * 0.75::DOUBLE AS l, (p_partkey % 10) * 0.001::DOUBLE AS m FROM part)")
def scalar_rates(spark: SparkSession, d: str) -> DataFrame:
    """F1, F18, F19, F21."""
    p = X.table(spark, d, "part")
    logit, mse = (F.col("p_partkey") % 41 - 25) * 0.75, F.col("p_partkey") % 10 * 0.001
    return p.select(F.col("p_partkey").alias("id"), *r6(rate=S.rate(logit), sigmoid=S.sigmoid(logit), psnr=S.psnr(mse), shift=S.count_shift(F.lit(25.0), F.col("p_size"))))


_SHAPE = f"""WITH {X.SPLATS}, base AS (
  SELECT *, (lc_xx + lc_yy) / 2.0 AS mean, sqrt(((lc_xx - lc_yy) / 2.0) * ((lc_xx - lc_yy) / 2.0) + lc_xy * lc_xy + 1e-16) AS radius FROM splats
), sr AS (
  SELECT *, exp((mean + radius) * 0.5) AS s1, exp((mean - radius) * 0.5) AS s2, CASE WHEN radius <= 1e-8 THEN 0.0 ELSE atan2(2.0 * lc_xy, lc_xx - lc_yy) * -0.5 END AS theta FROM base
), cv AS (
  SELECT *, cos(theta) * cos(theta) * s1 * s1 + sin(theta) * sin(theta) * s2 * s2 AS s_xx, cos(theta) * sin(theta) * (s2 * s2 - s1 * s1) AS s_xy, sin(theta) * sin(theta) * s1 * s1 + cos(theta) * cos(theta) * s2 * s2 AS s_yy FROM sr)
"""


@query(_SHAPE + "SELECT idx, " + _r("s1", "s2", "theta", "s_xx", "s_xy", "s_yy", ux="cos(theta)", uy="sin(theta)", ratio="greatest(1.0, s1 / greatest(s2, 1e-8))", q_xx="s_yy / (s_xx * s_yy - s_xy * s_xy)", q_xy="-s_xy / (s_xx * s_yy - s_xy * s_xy)", q_yy="s_xx / (s_xx * s_yy - s_xy * s_xy)", extent="sqrt(2 * ln(255.0) * s_xx)") + ", ceil(3.0 * sqrt((s_xx + s_yy) / 2.0 + sqrt(greatest(0.1, ((s_xx + s_yy) / 2.0) * ((s_xx + s_yy) / 2.0) - (s_xx * s_yy - s_xy * s_xy)))))::INTEGER AS radius FROM cv")
def scalar_covariance(spark: SparkSession, d: str) -> DataFrame:
    """F2, F4, F5, F6."""
    shape = S.scale_rotation(F.col("lc_xx"), F.col("lc_xy"), F.col("lc_yy"))
    named = X.splats(spark, d).withColumns({"s1": shape["s_major"], "s2": shape["s_minor"], "theta": shape["theta"]}).withColumns({"ux": F.cos("theta"), "uy": F.sin("theta")})
    c = named.withColumns(S.conic(F.col("s1"), F.col("s2"), F.col("theta")))
    names = ("s1", "s2", "theta", "s_xx", "s_xy", "s_yy", "ux", "uy", "q_xx", "q_xy", "q_yy")
    return c.select("idx", *r6(**{n: F.col(n) for n in names}, ratio=S.anisotropy(F.col("s1"), F.col("s2")), extent=S.cutoff_extent(F.col("s_xx"))), "radius")


@query(f"WITH {X.SPLATS}, b AS (SELECT *, (lc_xx + lc_yy) / 2.0 AS m, sqrt(((lc_xx - lc_yy) / 2.0) * ((lc_xx - lc_yy) / 2.0) + lc_xy * lc_xy + 1e-16) AS rad FROM splats), e AS (SELECT *, exp(m + rad) AS hi, exp(m - rad) AS lo FROM b), s AS (SELECT *, CASE WHEN rad <= 1e-5 THEN exp(m) ELSE (hi - lo) / (2 * rad) END AS slope, CASE WHEN rad <= 1e-5 THEN exp(m) * (1 - m) ELSE hi - (hi - lo) / (2 * rad) * (m + rad) END AS base FROM e) SELECT idx, " + _r(c_xx="base + slope * lc_xx", c_xy="slope * lc_xy", c_yy="base + slope * lc_yy") + " FROM s")
def scalar_matrix_exp(spark: SparkSession, d: str) -> DataFrame:
    """F3."""
    return X.splats(spark, d).select("idx", *r6(**S.exp_symmetric(F.col("lc_xx"), F.col("lc_xy"), F.col("lc_yy"))))


@query("WITH o AS (SELECT o_orderkey AS id, o_orderkey AS pix FROM orders) SELECT id, " + _r(u=_sql_unit("pix"), u_extra=_sql_unit("pix", steps=2), jitter_x="0.25 + 0.5 * " + _sql_unit("3000003 + 2 * pix"), jitter_y="0.25 + 0.5 * " + _sql_unit("3000004 + 2 * pix")) + " FROM o")
def scalar_hashes(spark: SparkSession, d: str) -> DataFrame:
    """F9, F9', F10: for each order."""
    k = F.col("o_orderkey").cast("long")
    return X.table(spark, d, "orders").select(k.alias("id"), *r6(u=H.unit_hash(SEED, k), u_extra=H.unit_hash(SEED, k, True), jitter_x=0.25 + 0.5 * H.unit_hash(SEED, k * 2 + H.SALT_X), jitter_y=0.25 + 0.5 * H.unit_hash(SEED, k * 2 + H.SALT_Y)))


@query("""WITH RECURSIVE o AS (SELECT o_orderkey AS id, (o_orderkey % 1024)::BIGINT AS x, (o_orderkey * 37 + o_custkey) % 1024 AS y FROM orders), walk AS (
  SELECT id, 0::BIGINT AS d, x, y::BIGINT AS y, 512::BIGINT AS s FROM o
  UNION ALL
  SELECT id, d + s * s * CASE WHEN x & s > 0 THEN CASE WHEN y & s > 0 THEN 2 ELSE 3 END WHEN y & s > 0 THEN 1 ELSE 0 END,
         CASE WHEN y & s > 0 THEN x WHEN x & s > 0 THEN s - 1 - y ELSE y END, CASE WHEN y & s > 0 THEN y WHEN x & s > 0 THEN s - 1 - x ELSE x END, s // 2
  FROM walk WHERE s > 0
) SELECT o.id, w.d AS hilbert, (""" + " | ".join(f"(((o.x >> {k}) & 1) << {2 * k}) | (((o.y >> {k}) & 1) << {2 * k + 1})" for k in range(10)) + """)::INTEGER AS morton
FROM o JOIN walk w ON w.id = o.id AND w.s = 0""")
def scalar_curves(spark: SparkSession, d: str) -> DataFrame:
    """for a place of each order in a square of 1024."""
    x, y = (F.col("o_orderkey") % 1024).cast("int"), ((F.col("o_orderkey") * 37 + F.col("o_custkey")) % 1024).cast("int")
    o = X.table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("id"), x.alias("x"), y.alias("y"))
    return o.select("id", S.hilbert(F.col("x"), F.col("y"), 1024).alias("hilbert"), S.morton(F.col("x"), F.col("y"), 10).alias("morton"))


@query("SELECT p_partkey AS id, CASE WHEN p_size > 0 AND p_partkey % 4 <> 3 THEN p_size END AS width, CASE WHEN p_partkey % 4 = 3 THEN NULL WHEN p_partkey % 4 = 0 THEN CASE WHEN p_size > 0 THEN p_size END WHEN p_size > 0 THEN 7 END AS height FROM part")
def parse_sizes(spark: SparkSession, d: str) -> DataFrame:
    """S2."""
    n = F.col("p_size").cast("string")
    forms = F.when(F.col("p_partkey") % 4 == 0, n).when(F.col("p_partkey") % 4 == 1, F.concat(n, F.lit("x7"))).when(F.col("p_partkey") % 4 == 2, F.concat(n, F.lit(" * 7"))).otherwise(F.concat(n, F.lit("by7")))
    size = S.parse_size(forms)
    return X.table(spark, d, "part").select(F.col("p_partkey").alias("id"), size["width"].alias("width"), size["height"].alias("height"))


@query(f"WITH {X.PIXELS} SELECT x, round(sum(floor((density * 0.125 + 0.1) * 4294967296.0)::HUGEINT)::DOUBLE / 4294967296.0, 6) + 0.0 AS total FROM pixels GROUP BY x")
def fixed_point_sums(spark: SparkSession, d: str) -> DataFrame:
    """sums that do not depend on their order."""
    return X.pixels(spark, d).groupBy("x").agg(F.sum(S.fixed_point(F.col("density") * 0.125 + 0.1)).alias("t")).select("x", *r6(total=S.from_fixed_point(F.col("t"))))


@query()
def key_seeds(spark: SparkSession, d: str) -> DataFrame:
    """F11 (no SQL: a keyed BLAKE2 hash)."""
    return X.table(spark, d, "nation").select("n_name", H.key_seed(SEED, F.col("n_name")).alias("seed"))


# ---------------------------------------------------------------- grids, filters, sinks


@query(f"WITH {X.PIXELS}, g AS (SELECT i % 48 AS x, i // 48 AS y FROM range(48 * 48) t(i)) SELECT (g.y * 48 + g.x)::INTEGER AS pix, e.density AS edge, f.density AS mirrored FROM g JOIN pixels e ON e.x = least(g.x, 31) AND e.y = least(g.y, 31) JOIN pixels f ON f.x = CASE WHEN g.x < 32 THEN g.x ELSE 62 - g.x END AND f.y = CASE WHEN g.y < 32 THEN g.y ELSE 62 - g.y END")
def padding(spark: SparkSession, d: str) -> DataFrame:
    """P1, P2."""
    p = X.pixels(spark, d)
    edge = G.edge_pad(p, *SIZE, 48, ["density"]).select("pix", F.col("density").alias("edge"))
    return edge.join(G.reflect_pad(p, *SIZE, 48, ["density"]).select("pix", F.col("density").alias("mirrored")), "pix")


@query(f"WITH {X.PIXELS} SELECT (y * 20 + x)::INTEGER AS pix, density FROM pixels WHERE x < 20 AND y < 12")
def cropping(spark: SparkSession, d: str) -> DataFrame:
    return G.crop(X.pixels(spark, d), 20, 12).select("pix", "density")


@query(f"WITH {X.PIXELS}, h AS (SELECT quantile_cont(density, 0.995) AS hi, max(density) AS top FROM pixels) SELECT pix, floor(greatest(0.0, least(1.0, density / greatest(CASE WHEN hi > 0 THEN hi ELSE top END, 1e-8))) * 255.0 + 0.5)::INTEGER AS grey FROM pixels, h")
def density_preview(spark: SparkSession, d: str) -> DataFrame:
    """K6."""
    return manifests.density_preview(X.pixels(spark, d)).select("pix", "grey")


@query(f"WITH {X.PIXELS}, {X.POINTS}, c AS (SELECT (least(31, greatest(0, floor(y * 32))) * 32 + least(31, greatest(0, floor(x * 32))))::INTEGER AS pix, count(*) AS n FROM points GROUP BY 1) SELECT p.pix, coalesce(c.n, 0)::BIGINT AS n_points, CASE WHEN c.n > 0 THEN 255 ELSE 0 END AS grey FROM pixels p LEFT JOIN c ON c.pix = p.pix")
def hard_counts(spark: SparkSession, d: str) -> DataFrame:
    """A9, K7."""
    pixel, points, grid = G.pixel_of(F.col("x"), F.col("y"), *SIZE), X.points(spark, d), X.empty_grid(spark)
    seen = manifests.point_preview(grid, points, pixel).select("pix", "grey")
    return A.hard_counts(points, grid, pixel).join(seen, "pix").select("pix", "n_points", "grey")


@query("SELECT p_partkey AS id, CASE WHEN p_size < 16 THEN 'side under 16' WHEN p_partkey * 600 < 1 OR p_partkey * 600 > 1000000 THEN 'count outside 1 to 1000000' WHEN p_partkey % 20 < 1 OR p_partkey % 20 > 16 THEN 'states outside 1 to 16' END AS problem FROM part")
def size_checks(spark: SparkSession, d: str) -> DataFrame:
    """P8."""
    jobs = X.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("width"), F.lit(64).alias("height"), (F.col("p_partkey") * 600).alias("n"), (F.col("p_partkey") % 20).alias("k"))
    return manifests.check_sizes(jobs).select("id", "problem")


@query("SELECT 'in/' || p_partkey || '.npy' AS input, CASE WHEN p_partkey % 3 > 0 THEN 'out/' || p_partkey || '.npy' END AS render, CASE WHEN p_partkey % 2 = 0 THEN 'g' || p_partkey END AS gaussians FROM part WHERE p_partkey % 5 <> 0")
def manifest_lines(spark: SparkSession, d: str) -> DataFrame:
    """S11."""
    k = F.col("p_partkey")
    line = F.concat(F.lit("in/"), k, F.lit(".npy "), F.when(k % 3 > 0, F.concat(F.lit("out/"), k, F.lit(".npy"))).otherwise(F.lit("-")), F.when(k % 2 == 0, F.concat(F.lit("  g"), k)).otherwise(F.lit("")))
    lines = X.table(spark, d, "part").select(F.when(k % 5 == 0, F.lit("# skipped")).otherwise(line).alias("value"))
    return manifests.parse_manifest(lines).select("input", "render", "gaussians")


@query("SELECT s_suppkey % 3 AS stream, 'f' || s_suppkey AS path, row_number() OVER (PARTITION BY s_suppkey % 3 ORDER BY 'f' || s_suppkey) - 1 AS frame FROM supplier")
def frame_order(spark: SparkSession, d: str) -> DataFrame:
    """S12, T6."""
    files = X.table(spark, d, "supplier").select((F.col("s_suppkey") % 3).alias("stream"), F.concat(F.lit("f"), "s_suppkey").alias("path"))
    return manifests.frames_in_order(files, F.col("stream")).select("stream", "path", F.col("frame").cast("long").alias("frame"))


# ---------------------------------------------------------------- aggregates


#: Logits that the quantities of a pixel's orders give.
_LOGITS = f"WITH {X.PIXELS.replace('(g % 19 - 12) * 0.5::DOUBLE AS logit', '(coalesce(s.d, 0.0)::DOUBLE % 19 - 12) * 0.5::DOUBLE AS logit')}"


def _with_logits(spark: SparkSession, d: str) -> DataFrame:
    return X.pixels(spark, d).withColumn("logit", (F.col("density") % 19 - 12) * 0.5)


@query(_LOGITS + ", e AS (SELECT pix, exp(logit - max(logit) OVER ()) AS e FROM pixels) SELECT pix, round(e / (avg(e) OVER () + 1e-8), 6) + 0.0 AS density FROM e")
def density_normalisation(spark: SparkSession, d: str) -> DataFrame:
    """A1, A18."""
    return A.density_from_logits(_with_logits(spark, d).drop("density")).select("pix", *r6(density=F.col("density")))


@query(_LOGITS + ", s AS (SELECT sum(exp(greatest(-20.0, least(8.0, logit))) + 1e-8) AS t, sum(exp(logit)) AS a FROM pixels) SELECT round(t, 6) AS rate_sum, round(a, 6) AS rate_sum_aligned, greatest(1, round_even(t, 0))::BIGINT AS n_reference, greatest(1, floor(t))::BIGINT AS n_production, least(409, greatest(1, floor(t)))::BIGINT AS n_fused FROM s")
def auto_counts(spark: SparkSession, d: str) -> DataFrame:
    """A2, A2'."""
    c = A.auto_counts(_with_logits(spark, d), *SIZE)
    return c.select(F.round("rate_sum", 6).alias("rate_sum"), F.round("rate_sum_aligned", 6).alias("rate_sum_aligned"), "n_reference", "n_production", "n_fused")


@query(f"WITH {X.PIXELS}, w AS (SELECT pix, density, density * greatest(lc_xx + 1, 1.0) AS v FROM pixels) SELECT pix, " + _r(plain="density * 100.0 / (sum(density) OVER ())", stretched="v * 100.0 / (sum(v) OVER ())") + " FROM w")
def sampling_densities(spark: SparkSession, d: str) -> DataFrame:
    """A3, A4."""
    p = X.pixels(spark, d)
    a = A.sampling_density(p, 100).select("pix", F.col("sampling").alias("plain"))
    b = A.sampling_density(p, 100, F.col("lc_xx") + 1).select("pix", F.col("sampling").alias("stretched"))
    return a.join(b, "pix").select("pix", *r6(plain=F.col("plain"), stretched=F.col("stretched")))


#: What 150 points on 32 x 32 pixels ask for with seed 12345: tile size, shifts of the grid in y and x, and offset of the rounding.
_TILE, _SHIFT_Y, _SHIFT_X, _OFFSET = 10, 4, 8, 0.35896209133735046
_TILED = f"""WITH {X.PIXELS}, tiled AS (
  SELECT pix, x, y, density, (least((((y + {_SHIFT_Y}) % 32) // {_TILE}), 3) * 4 + least((((x + {_SHIFT_X}) % 32) // {_TILE}), 3))::INTEGER AS tile FROM pixels
), mass AS (SELECT tile, sum(density) AS mass FROM tiled GROUP BY tile)"""


@query(_TILED + " SELECT tile, mass FROM mass")
def tile_masses(spark: SparkSession, d: str) -> DataFrame:
    """A5, P5."""
    t = P.tile_size(*SIZE, 150)
    return A.tile_mass(X.pixels(spark, d), G.tile_of(F.col("x"), F.col("y"), *SIZE, t, *H.tile_shifts(SEED, t))).select("tile", "mass")


_COUNTS = f""", edges AS (
  SELECT tile, mass, floor(sum(mass) OVER (ORDER BY tile ROWS UNBOUNDED PRECEDING) * (150.0::DOUBLE / sum(mass) OVER ()) + {_OFFSET!r}::DOUBLE + 1e-12::DOUBLE)::BIGINT AS edge, mass * (150.0::DOUBLE / sum(mass) OVER ()) AS share FROM mass
), base AS (
  SELECT tile, mass, share - floor(share) AS residual, greatest(0, edge - lag(edge, 1, 0) OVER (ORDER BY tile)) AS base FROM edges
), repair AS (
  SELECT *, 150 - sum(base) OVER () AS missing, row_number() OVER (ORDER BY residual DESC, tile) AS up, row_number() OVER (ORDER BY base = 0, residual, tile) AS down FROM base
), counts AS (
  SELECT tile, mass, (base + CASE WHEN missing > 0 AND up <= missing THEN 1 WHEN missing < 0 AND down <= -missing AND base > 0 THEN -1 ELSE 0 END)::INTEGER AS n_points FROM repair
)"""


@query(_TILED + _COUNTS + " SELECT tile, n_points FROM counts")
def systematic_counts(spark: SparkSession, d: str) -> DataFrame:
    """W1, W2, W3, W8."""
    t = P.tile_size(*SIZE, 150)
    tiles = A.tile_mass(X.pixels(spark, d), G.tile_of(F.col("x"), F.col("y"), *SIZE, t, *H.tile_shifts(SEED, t)))
    return P.tile_counts(tiles, 150, P.offset_of(SEED)).select("tile", "n_points")


@query(_TILED + _COUNTS + f""", raced AS (
  SELECT t.*, n_points, CASE WHEN density > 0 THEN ln(greatest({_sql_unit('pix + 1000003')}, 1e-300)) / density ELSE {_sql_unit('pix + 2000003')} - 1.0 END AS priority FROM tiled t JOIN counts USING (tile) WHERE n_points > 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY priority DESC, pix) - 1 AS rank FROM raced),
starts AS (SELECT tile, sum(n_points) OVER (ORDER BY tile) - n_points AS first FROM counts)
SELECT (first + rank)::INTEGER AS idx, """ + _r(x=f"(x + 0.25 + 0.5 * {_sql_unit('3000003 + 2 * pix')}) / 32", y=f"(y + 0.25 + 0.5 * {_sql_unit('3000004 + 2 * pix')}) / 32") + " FROM ranked JOIN starts USING (tile) WHERE rank < n_points")
def weighted_samples(spark: SparkSession, d: str) -> DataFrame:
    """W4."""
    s = P.sample_points(X.pixels(spark, d), 150, *SIZE, SEED)
    return s.select("idx", *r6(x=F.col("x"), y=F.col("y")))


_THIRD = "CASE WHEN pix % 3 = 0 OR x < 10 AND y < 10 THEN 0.0 ELSE density END"


@query((_TILED + _COUNTS).replace("SELECT pix, x, y, density, (least", f"SELECT pix, x, y, {_THIRD} AS density, (least") + f""", raced AS (
  SELECT t.*, n_points, max(density) OVER (PARTITION BY tile) AS top, CASE WHEN density > 0 THEN ln(greatest({_sql_unit('pix + 1000003')}, 1e-300)) / density ELSE {_sql_unit('pix + 2000003')} - 1.0 END AS priority FROM tiled t JOIN counts USING (tile) WHERE n_points > 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY priority DESC, pix) - 1 AS rank FROM raced WHERE density > 0 OR top <= 0),
starts AS (SELECT tile, sum(n_points) OVER (ORDER BY tile) - n_points AS first FROM counts)
SELECT (first + rank)::INTEGER AS idx, pix FROM ranked JOIN starts USING (tile) WHERE rank < n_points""")
def blank_pixels_skipped(spark: SparkSession, d: str) -> DataFrame:
    """W4': a third of the pixels and a corner without density, of which only tiles that have nothing else take any."""
    blank = (F.col("pix") % 3 == 0) | ((F.col("x") < 10) & (F.col("y") < 10))
    s = P.sample_points(X.pixels(spark, d).withColumn("density", F.when(blank, 0.0).otherwise(F.col("density"))), 150, *SIZE, SEED, skip_blank=True)
    return s.select("idx", G.pixel_of(F.col("x"), F.col("y"), *SIZE).alias("pix"))


_CELLS = f"WITH {X.PIXELS}, {X.POINTS}, {X.OWNED}"


@query(_CELLS + " SELECT idx, mass, n_pixels, round(mass * count(*) OVER () / greatest(sum(mass) OVER (), 1e-8), 6) + 0.0 AS weight FROM cells")
def cell_masses(spark: SparkSession, d: str) -> DataFrame:
    """The flagship query."""
    return A.normalised_weights(_cells(spark, d)).select("idx", "mass", "n_pixels", *r6(weight=F.col("weight")))


@query(_CELLS + " SELECT pix, owner, round(d2, 6) + 0.0 AS d2 FROM owned")
def nearest_owner(spark: SparkSession, d: str) -> DataFrame:
    """J1."""
    return _owned(spark, d).select("pix", "owner", *r6(d2=F.col("d2")))


@query(f"WITH {X.POINTS}, s AS (SELECT DISTINCT ON (x, y) idx, x, y FROM points ORDER BY x, y, idx), q AS (SELECT g::INTEGER AS pix, g % 128 + 0.5::DOUBLE AS x, g // 128 + 0.5::DOUBLE AS y FROM range(16384) t(g)) SELECT pix, arg_min(idx, ((q.x - s.x * 128) * (q.x - s.x * 128) + (q.y - s.y * 128) * (q.y - s.y * 128), idx)) AS owner FROM q, s GROUP BY pix")
def nearest_owner_128(spark: SparkSession, d: str) -> DataFrame:
    """J1 at a published size, 128 x 128 pixels, with a point for each customer."""
    points = X.points(spark, d)
    return N.assign_nearest(X.empty_grid(spark, 128, 128), points, 128, 128, points.count()).select("pix", "owner")


@query(f"WITH {X.PIXELS}, {X.POINTS}, s AS (SELECT pix, idx, (p.x - least(31.999::DOUBLE, q.x * 32.0)) * (p.x - least(31.999::DOUBLE, q.x * 32.0)) + (p.y - least(31.999::DOUBLE, q.y * 32.0)) * (p.y - least(31.999::DOUBLE, q.y * 32.0)) AS d FROM pixels p, points q) SELECT pix, arg_min(idx, (d, idx)) AS owner FROM s GROUP BY pix")
def viewer_owner(spark: SparkSession, d: str) -> DataFrame:
    """J1'': pixels sampled at whole coordinates."""
    points = X.points(spark, d)
    return N.assign_nearest(X.empty_grid(spark), points, *SIZE, points.count(), offset=0.0).select("pix", "owner")


@query(f"WITH {X.PIXELS}, {X.POINTS}, s AS (SELECT pix, idx, (p.x + 0.5::DOUBLE - least(31.999::DOUBLE, q.x * 32.0)) * (p.x + 0.5::DOUBLE - least(31.999::DOUBLE, q.x * 32.0)) + (p.y + 0.5::DOUBLE - least(31.999::DOUBLE, q.y * 32.0)) * (p.y + 0.5::DOUBLE - least(31.999::DOUBLE, q.y * 32.0)) - (idx % 5) * 0.25::DOUBLE AS d FROM pixels p, points q) SELECT pix, arg_min(idx, (d, idx)) AS owner FROM s GROUP BY pix")
def power_owner(spark: SparkSession, d: str) -> DataFrame:
    """J10."""
    points = X.points(spark, d).withColumn("w", F.col("idx") % 5 * 0.25)
    return N.assign_nearest(X.pixels(spark, d), points, *SIZE, points.count(), penalty="w", most_penalty=1.0).select("pix", "owner")


def _flood_sql(side: int = 32) -> str:
    """The rounds of jump flooding, one after the other, and the recovery; over seeds (idx, px, py)."""
    near = lambda s, p: f"(({p}.x + 0.5::DOUBLE - {s}.px) * ({p}.x + 0.5::DOUBLE - {s}.px) + ({p}.y + 0.5::DOUBLE - {s}.py) * ({p}.y + 0.5::DOUBLE - {s}.py))"
    out = f", snapped AS (SELECT *, floor(px)::INTEGER AS x, floor(py)::INTEGER AS y FROM seeds), f0 AS (SELECT x, y, arg_min(idx, ({near('s', 's')}, idx)) AS idx FROM snapped s GROUP BY x, y)"
    for k, step in enumerate(J.schedule(side, side)):
        out += f", o{k} AS (SELECT f.x + a * {step} AS x, f.y + b * {step} AS y, s.idx, s.px, s.py FROM f{k} f JOIN seeds s USING (idx), (VALUES (-1), (0), (1)) u(a), (VALUES (-1), (0), (1)) v(b)), f{k + 1} AS (SELECT x, y, arg_min(idx, ({near('o', 'o')}, idx)) AS idx FROM o{k} o WHERE x BETWEEN 0 AND {side - 1} AND y BETWEEN 0 AND {side - 1} GROUP BY x, y)"
    out += f", flooded AS (SELECT p.pix, p.x, p.y, f.idx AS owner, {near('s', 'p')} AS d2 FROM pixels p LEFT JOIN f{k + 1} f ON f.x = p.x AND f.y = p.y LEFT JOIN seeds s ON s.idx = f.idx)"
    out += ", lost AS (SELECT * FROM seeds WHERE idx NOT IN (SELECT owner FROM flooded WHERE owner IS NOT NULL) OR EXISTS (SELECT 1 FROM flooded WHERE owner IS NULL))"
    return out + f", recovered AS (SELECT p.pix, p.owner AS first, p.d2 AS d1, arg_min(l.idx, ({near('l', 'p')}, l.idx)) AS other, min({near('l', 'p')}) AS d3 FROM flooded p LEFT JOIN lost l ON true GROUP BY p.pix, p.owner, p.d2), jumped AS (SELECT pix, first, CASE WHEN d3 IS NOT NULL AND (d1 IS NULL OR d3 < d1) THEN other ELSE first END AS owner, CASE WHEN d3 IS NOT NULL AND (d1 IS NULL OR d3 < d1) THEN d3 ELSE d1 END AS d2 FROM recovered)"


@query(_CELLS + _flood_sql() + " SELECT pix, first, owner, round(d2, 6) + 0.0 AS d2 FROM jumped")
def jump_flooding(spark: SparkSession, d: str) -> DataFrame:
    """J1': the owners after the rounds and after the recovery."""
    points, pixels = X.points(spark, d), X.pixels(spark, d)
    flooded = N.scratch(J.flood(points, *SIZE), "flooded")
    found = J.recover(flooded, pixels, points, *SIZE, points.count())
    return found.join(flooded.select("image_id", "pix", F.col("owner").alias("first")), ["image_id", "pix"], "left").select("pix", "first", "owner", *r6(d2=F.col("d2")))


@query(_CELLS + _flood_sql() + " SELECT count(*) AS n_pixels, count(*) FILTER (j.d2 > o.d2 + 1e-9) AS farther, count(*) FILTER (j.d2 < o.d2 - 1e-9) AS nearer, count(DISTINCT j.owner) - count(DISTINCT j.first) AS recovered FROM jumped j JOIN owned o USING (pix)")
def jump_flooding_error(spark: SparkSession, d: str) -> DataFrame:
    """J1' against J1: pixels with a farther point than the nearest, and points that the recovery put back."""
    exact = _owned(spark, d).select("pix", F.col("d2").alias("least"))
    points, pixels = X.points(spark, d), X.pixels(spark, d)
    flooded = N.scratch(J.flood(points, *SIZE), "flooded")
    both = J.recover(flooded, pixels, points, *SIZE, points.count()).join(exact, "pix").join(flooded.select("pix", F.col("owner").alias("first")), "pix", "left")
    return both.agg(F.count(F.lit(1)).alias("n_pixels"), F.count(F.when(F.col("d2") > F.col("least") + 1e-9, 1)).alias("farther"), F.count(F.when(F.col("d2") < F.col("least") - 1e-9, 1)).alias("nearer"), (F.countDistinct("owner") - F.countDistinct("first")).alias("recovered"))


@query(_CELLS + ", c AS (SELECT owner, sum(density) AS m, sum(density * (x + 0.5)) AS mx, sum(density * (y + 0.5)) AS my FROM owned GROUP BY owner) SELECT idx, " + _r(x="CASE WHEN m > 1e-8 THEN greatest(0.0, least(1.0, mx / m / 32)) ELSE x END", y="CASE WHEN m > 1e-8 THEN greatest(0.0, least(1.0, my / m / 32)) ELSE y END") + " FROM points LEFT JOIN c ON owner = idx")
def lloyd_step(spark: SparkSession, d: str) -> DataFrame:
    """A7, M5."""
    return A.lloyd_centroids(X.points(spark, d), _owned(spark, d), *SIZE).select("idx", *r6(x=F.col("x"), y=F.col("y")))


@query(_CELLS + """, t AS (SELECT owner AS idx, x + 0.5::DOUBLE AS px, y + 0.5::DOUBLE AS py, CASE WHEN sum(density) OVER (PARTITION BY owner) > 1e-12 THEN density ELSE 1.0 END AS w FROM owned),
m AS (SELECT idx, count(*) AS n_pixels, sum(w * px) / sum(w) AS m_x, sum(w * py) / sum(w) AS m_y, sum(w * px * px) / sum(w) AS xx, sum(w * py * py) / sum(w) AS yy, sum(w * px * py) / sum(w) AS xy FROM t GROUP BY idx)
SELECT idx, n_pixels, """ + _r("m_x", "m_y", var_x="greatest(xx - m_x * m_x, 0.0)", var_y="greatest(yy - m_y * m_y, 0.0)", cov_xy="xy - m_x * m_y") + " FROM m")
def cell_moments(spark: SparkSession, d: str) -> DataFrame:
    """A14."""
    return A.cell_moments(_owned(spark, d)).select("idx", "n_pixels", *r6(**{c: F.col(c) for c in ("m_x", "m_y", "var_x", "var_y", "cov_xy")}))


@query("SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99, max(value) AS top, avg((value > 10.0)::DOUBLE) AS share_over FROM events GROUP BY event_type".replace("quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99", ", ".join(f"round(quantile_cont(value, {q}), 6) AS {n}" for q, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99")))).replace("avg((value > 10.0)::DOUBLE)", "round(avg((value > 10.0)::DOUBLE), 6)"))
def quantile_envelope(spark: SparkSession, d: str) -> DataFrame:
    """A15."""
    q = A.quantile_envelope(X.table(spark, d, "events"), "value", ["event_type"], 10.0)
    return q.select("event_type", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")], "top", F.round("share_over", 6).alias("share_over"))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS top, round(stddev_pop(value), 6) AS deviation, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.9), 6) AS p90, max(value) FILTER (k = ceil(n * 0.99::DOUBLE)) AS p99 FROM r GROUP BY event_type""")
def latency_stats(spark: SparkSession, d: str) -> DataFrame:
    """A16, T4."""
    q = A.latency_stats(X.table(spark, d, "events"), "value", ["event_type"])
    return q.select("event_type", "low", "top", "p99", *[F.round(c, 6).alias(c) for c in ("mean", "deviation", "median", "p10", "p90")])


# ---------------------------------------------------------------- joins and ranks

_PAIRS = ", pairs AS (SELECT DISTINCT src, dst FROM (SELECT a.owner AS src, b.owner AS dst FROM owned a JOIN owned b ON (b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1) UNION ALL SELECT b.owner, a.owner FROM owned a JOIN owned b ON (b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1)) WHERE src <> dst)"


@query(_CELLS + _PAIRS + " SELECT src, dst FROM pairs")
def cell_adjacency(spark: SparkSession, d: str) -> DataFrame:
    """J3 and its set operations."""
    return N.adjacency(_owned(spark, d)).select("src", "dst")


@query(_CELLS + _PAIRS + " SELECT src, dst, (rank - 1)::INTEGER AS rank FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY mass, dst) AS rank FROM pairs JOIN cells ON idx = dst) WHERE rank <= 8")
def lightest_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """W7."""
    owned = _owned(spark, d)
    cells = A.cell_mass(X.points(spark, d), owned)
    return N.lightest_neighbours(N.adjacency(owned), cells).select("src", "dst", "rank")


@query(_CELLS + " SELECT idx, row_number() OVER (ORDER BY mass, idx) - 1 AS rank FROM cells")
def priority_rank(spark: SparkSession, d: str) -> DataFrame:
    """W6, T1, T2."""
    return N.priority_rank(_cells(spark, d)).select("idx", "rank")


@query(_CELLS + " SELECT idx FROM cells WHERE n_pixels = 0")
def points_without_pixels(spark: SparkSession, d: str) -> DataFrame:
    """J2, J8, A17."""
    return N.without_pixels(X.points(spark, d), _owned(spark, d)).select("idx")


@query(_CELLS + ", r AS (SELECT *, row_number() OVER (PARTITION BY mass <= 1e-8 ORDER BY idx) AS k FROM cells) SELECT idx, mass FROM r WHERE NOT (mass <= 1e-8 AND k <= 40)")
def drop_empty_cells(spark: SparkSession, d: str) -> DataFrame:
    """P6, P7."""
    return M.drop_empty(_cells(spark, d), 40).select("idx", "mass")


@query(f"WITH {X.POINTS}, c AS (SELECT idx, x, y, floor(x / 0.05)::INTEGER AS cx, floor(y / 0.05)::INTEGER AS cy FROM points), r AS (SELECT a.idx, b.idx AS neighbour, row_number() OVER (PARTITION BY a.idx ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.idx) AS rank FROM c a JOIN c b ON a.idx <> b.idx AND abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1) SELECT idx, neighbour, rank::INTEGER AS rank FROM r WHERE rank <= 4 UNION ALL SELECT idx, idx, 1 FROM points WHERE idx NOT IN (SELECT idx FROM r)")
def bucket_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """J9."""
    return N.k_nearest(X.points(spark, d), 0.05, 4).select("idx", "neighbour", "rank")


@query(_CELLS + ", r AS (SELECT q.idx, o.pix, row_number() OVER (PARTITION BY q.idx ORDER BY (o.x + 0.5 - (q.x * 32 + 1)) * (o.x + 0.5 - (q.x * 32 + 1)) + (o.y + 0.5 - q.y * 32) * (o.y + 0.5 - q.y * 32), o.pix) AS k FROM points q JOIN owned o ON o.owner = q.idx) SELECT idx, pix FROM r WHERE k = 1")
def owned_pixel_nearest(spark: SparkSession, d: str) -> DataFrame:
    """J11."""
    targets = X.points(spark, d).select("image_id", "idx", (F.col("x") * 32 + 1).alias("tx"), (F.col("y") * 32).alias("ty"))
    return N.nearest_owned_pixel(targets, _owned(spark, d)).select("idx", "pix")


@query(_CELLS + ", r AS (SELECT q.idx, o.pix, row_number() OVER (PARTITION BY q.idx ORDER BY (o.x + 0.5 - q.x * 32) * (o.x + 0.5 - q.x * 32) + (o.y + 0.5 - q.y * 32) * (o.y + 0.5 - q.y * 32), o.pix) AS k FROM points q JOIN owned o ON o.owner = q.idx) SELECT a.idx, a.pix AS parent, b.pix AS child FROM r a LEFT JOIN r b ON b.idx = a.idx AND b.k = 2 WHERE a.k = 1")
def owned_pixel_pairs(spark: SparkSession, d: str) -> DataFrame:
    """J11 with a forbidden pixel: the two pixels of each cell that are nearest to its point; null where it has only one."""
    owned = _owned(spark, d)
    targets = X.points(spark, d).select("image_id", "idx", (F.col("x") * 32).alias("tx"), (F.col("y") * 32).alias("ty"))
    parent = N.scratch(N.nearest_owned_pixel(targets, owned).withColumnRenamed("pix", "parent"), "parents")
    child = N.nearest_owned_pixel(targets.join(parent, ["image_id", "idx"]), owned, F.col("parent")).select("image_id", "idx", F.col("pix").alias("child"))
    return parent.join(child, ["image_id", "idx"], "left").select("idx", "parent", "child")


@query(_CELLS + " SELECT idx, target FROM (SELECT s.idx, a.idx AS target, row_number() OVER (PARTITION BY s.idx ORDER BY (s.x - a.x) * (s.x - a.x) + (s.y - a.y) * (s.y - a.y), a.idx) AS k FROM cells s, cells a WHERE s.n_pixels = 0 AND a.n_pixels > 0) WHERE k = 1")
def nearest_survivor(spark: SparkSession, d: str) -> DataFrame:
    """J6."""
    cells = _cells(spark, d).withColumn("alive", F.col("n_pixels") > 0)
    return N.nearest_alive(cells.where("not alive"), cells).select("idx", "target")


@query(f"WITH {X.PIXELS}, {X.POINTS}, t AS (SELECT idx, px::INTEGER AS px, py::INTEGER AS py, w FROM (SELECT idx, floor(x * 32 - 0.5) + dx AS px, floor(y * 32 - 0.5) + dy AS py, CASE WHEN dx = 1 THEN x * 32 - 0.5 - floor(x * 32 - 0.5) ELSE 1 - (x * 32 - 0.5 - floor(x * 32 - 0.5)) END * CASE WHEN dy = 1 THEN y * 32 - 0.5 - floor(y * 32 - 0.5) ELSE 1 - (y * 32 - 0.5 - floor(y * 32 - 0.5)) END AS w FROM points, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) c(dx, dy))) SELECT idx, " + _r(density="sum(w * density)", lc_xx="sum(w * lc_xx)", map_r="sum(w * map_r)") + " FROM t JOIN pixels p ON p.x = px AND p.y = py GROUP BY idx")
def bilinear_attributes(spark: SparkSession, d: str) -> DataFrame:
    """J4."""
    found = R.bilinear(X.points(spark, d), X.pixels(spark, d), ["density", "lc_xx", "map_r"], *SIZE)
    return found.select("idx", *r6(**{c: F.col(c) for c in ("density", "lc_xx", "map_r")}))


@query("SELECT p_partkey AS id, c_acctbal AS before FROM part LEFT JOIN customer ON c_custkey = p_partkey")
def history_lookup(spark: SparkSession, d: str) -> DataFrame:
    """What is known of each part's slot; parts beyond the last customer have no history."""
    history = X.table(spark, d, "customer").select(F.col("c_custkey").alias("slot"), F.col("c_acctbal").alias("before"))
    return N.look_up(X.table(spark, d, "part").select(F.col("p_partkey").alias("slot")), history).select(F.col("slot").alias("id"), "before")


@query(f"WITH {X.POINTS}, {X.SPLATS} SELECT DISTINCT round(x, 6) AS x, round(y, 6) AS y FROM points EXCEPT SELECT round(x + 1e-9, 6), round(y, 6) FROM points WHERE idx % 2 = 0")
def point_difference(spark: SparkSession, d: str) -> DataFrame:
    """J12."""
    p = X.points(spark, d).select("x", "y", "idx")
    return N.points_not_in(p, p.where("idx % 2 = 0").withColumn("x", F.col("x") + 1e-9))


# ---------------------------------------------------------------- rendering

_RENDER = _SHAPE.replace("1e-16", "1e-12").replace("CASE WHEN radius <= 1e-8 THEN 0.0 ELSE atan2(2.0 * lc_xy, lc_xx - lc_yy) * -0.5 END", "atan2(2.0 * lc_xy, lc_xx - lc_yy) * -0.5") + f""", {X.PIXELS}, pr AS (
  SELECT *, x * 32 AS cx, y * 32 AS cy, s_xx * s_yy - s_xy * s_xy AS det, ceil(3.0 * sqrt((s_xx + s_yy) / 2.0 + sqrt(greatest(0.1, ((s_xx + s_yy) / 2.0) * ((s_xx + s_yy) / 2.0) - (s_xx * s_yy - s_xy * s_xy))))) AS reach FROM cv
), bx AS (
  SELECT *, least(2, greatest(0, trunc((cx - reach) / 16))) AS tx0, least(2, greatest(0, trunc((cx + reach) / 16 + 1))) AS tx1, least(2, greatest(0, trunc((cy - reach) / 16))) AS ty0, least(2, greatest(0, trunc((cy + reach) / 16 + 1))) AS ty1 FROM pr
), al AS (
  SELECT p.pix, r, g, b, weight, (s_yy / det * (cx - p.x) * (cx - p.x) + s_xx / det * (cy - p.y) * (cy - p.y)) * 0.5 - s_xy / det * (cx - p.x) * (cy - p.y) AS power
  FROM pixels p JOIN bx ON p.x // 16 >= tx0 AND p.x // 16 < tx1 AND p.y // 16 >= ty0 AND p.y // 16 < ty1
), shown AS (
  SELECT p.pix, least(1.0, coalesce(sum(a * r * weight), 0.0)) AS r, least(1.0, coalesce(sum(a * g * weight), 0.0)) AS g, least(1.0, coalesce(sum(a * b * weight), 0.0)) AS b
  FROM pixels p LEFT JOIN (SELECT *, exp(-power) AS a FROM al WHERE power >= 0 AND exp(-power) >= 1 / 255.0::DOUBLE) s USING (pix) GROUP BY p.pix)
"""


def _shown(spark: SparkSession, d: str) -> DataFrame:
    return R.render(X.splats(spark, d), X.empty_grid(spark), *SIZE)


@query(_RENDER + "SELECT pix, " + _r("r", "g", "b") + " FROM shown")
def splat_render(spark: SparkSession, d: str) -> DataFrame:
    """F2', F7, F8, J5, A10."""
    return _shown(spark, d).select("pix", *r6(**{c: F.col(c) for c in "rgb"}))


#: A splat for each part; every fiftieth covers most of a picture of 128 x 128.
_LARGE = "CASE WHEN p_partkey % 50 = 0 THEN 6.5::DOUBLE ELSE 0.0 END"
_LARGE_RENDER = _RENDER.replace("(p_partkey % 7) * 0.25::DOUBLE - 0.5::DOUBLE", f"(p_partkey % 7) * 0.25::DOUBLE - 0.5::DOUBLE + {_LARGE}").replace("(p_partkey % 11) * 0.125::DOUBLE - 0.5::DOUBLE", f"(p_partkey % 11) * 0.125::DOUBLE - 0.5::DOUBLE + {_LARGE}").replace("x * 32 AS cx, y * 32 AS cy", "x * 128 AS cx, y * 128 AS cy").replace("least(2, greatest", "least(8, greatest").replace(f", {X.PIXELS}", ", pixels AS (SELECT g::INTEGER AS pix, (g % 128)::INTEGER AS x, (g // 128)::INTEGER AS y FROM range(16384) t(g))")


@query(_LARGE_RENDER + "SELECT pix, " + _r("r", "g", "b") + " FROM shown")
def large_splat_render(spark: SparkSession, d: str) -> DataFrame:
    """Footprints over 32 tiles come from the pixels' side."""
    more = F.when(F.col("idx") % 50 == 0, 6.5).otherwise(0.0)
    splats = X.splats(spark, d).withColumns({"lc_xx": F.col("lc_xx") + more, "lc_yy": F.col("lc_yy") + more})
    return R.render(splats, X.empty_grid(spark, 128, 128), 128, 128).select("pix", *r6(**{c: F.col(c) for c in "rgb"}))


@query(_RENDER + "SELECT CASE WHEN part = 0 THEN 'all' ELSE 'crop' END AS area, round(sum(e), 4) AS squared_error, round(-10 * log10(greatest(sum(e) / (count(*) * 3), 1e-10)), 4) AS psnr FROM (SELECT pix, (r - pix % 8 / 8.0::DOUBLE) ** 2 + (g - pix % 16 / 16.0::DOUBLE) ** 2 + (b - pix % 32 / 32.0::DOUBLE) ** 2 AS e FROM shown), range(2) t(part) WHERE part = 0 OR (pix % 32 < 20 AND pix // 32 < 12) GROUP BY part")
def image_scores(spark: SparkSession, d: str) -> DataFrame:
    """A11, A12, F18."""
    shown = N.scratch(_shown(spark, d), "shown")
    both = [A.image_error(shown, X.image(spark), where=w).withColumn("area", F.lit(n)) for n, w in (("all", None), ("crop", (F.col("x") < 20) & (F.col("y") < 12)))]
    return both[0].union(both[1]).select("area", F.round("squared_error", 4).alias("squared_error"), F.round("psnr", 4).alias("psnr"))


@query(f"WITH {X.PIXELS}, {X.SPLATS}, t AS (SELECT idx, px::INTEGER AS px, py::INTEGER AS py, w FROM (SELECT idx, floor(x * 32 - 0.5) + dx AS px, floor(y * 32 - 0.5) + dy AS py, CASE WHEN dx = 1 THEN x * 32 - 0.5 - floor(x * 32 - 0.5) ELSE 1 - (x * 32 - 0.5 - floor(x * 32 - 0.5)) END * CASE WHEN dy = 1 THEN y * 32 - 0.5 - floor(y * 32 - 0.5) ELSE 1 - (y * 32 - 0.5 - floor(y * 32 - 0.5)) END AS w FROM splats, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) c(dx, dy))), dl AS (SELECT idx, " + ", ".join(f"sum(w * ((pix * {i + 3}) % 9 - 4) * 0.0078125) AS d{i}" for i in range(8)) + " FROM t JOIN pixels p ON p.x = px AND p.y = py GROUP BY idx) SELECT idx, " + _r(lc_xx="lc_xx + d0", lc_xy="lc_xy + d1", lc_yy="lc_yy + d2", r="greatest(0.0, least(1.0, r + d3))", g="greatest(0.0, least(1.0, g + d4))", b="greatest(0.0, least(1.0, b + d5))", x="greatest(0.0, least(1.0, x + d6 * 2.56 / 32))", y="greatest(0.0, least(1.0, y + d7 * 2.56 / 32))") + " FROM splats JOIN dl USING (idx)")
def correction_update(spark: SparkSession, d: str) -> DataFrame:
    """M8."""
    new = R.update(X.splats(spark, d), X.deltas(spark, 1).drop("k"), *SIZE)
    return new.select("idx", *r6(**{c: F.col(c) for c in ("lc_xx", "lc_xy", "lc_yy", "r", "g", "b", "x", "y")}))


_CORNERS = "t AS (SELECT idx, px::INTEGER AS px, py::INTEGER AS py, w FROM (SELECT idx, floor(x * 32 - 0.5) + dx AS px, floor(y * 32 - 0.5) + dy AS py, CASE WHEN dx = 1 THEN x * 32 - 0.5 - floor(x * 32 - 0.5) ELSE 1 - (x * 32 - 0.5 - floor(x * 32 - 0.5)) END * CASE WHEN dy = 1 THEN y * 32 - 0.5 - floor(y * 32 - 0.5) ELSE 1 - (y * 32 - 0.5 - floor(y * 32 - 0.5)) END AS w FROM splats, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) c(dx, dy)))"


def _rounds_sql(states: int) -> str:
    """The renders, scores and updates of :func:`correction_rounds`, one state after the other."""
    steps = _RENDER[_RENDER.index("base AS (") : _RENDER.index(", pixels AS (")].rstrip() + ", " + _RENDER[_RENDER.index("pr AS (") :].rstrip()
    of = lambda text, k: re.sub(r"\b(splats|base|sr|cv|pr|bx|al|shown|t|dl)\b(?!\()", rf"\g<1>{k}", text)
    parts, scores = [X.SPLATS.replace("splats AS", "splats0 AS", 1), X.PIXELS], []
    clamp = lambda e: f"greatest(0.0, least(1.0, {e}))"
    for k in range(states):
        parts.append(of(steps, k))
        scores.append(f"SELECT {k} AS k, round(sum(e), 3) AS squared_error, round(-10 * log10(greatest(sum(e) / (count(*) * 3), 1e-10)), 3) AS psnr FROM (SELECT (r - pix % 8 / 8.0::DOUBLE) ** 2 + (g - pix % 16 / 16.0::DOUBLE) ** 2 + (b - pix % 32 / 32.0::DOUBLE) ** 2 AS e FROM shown{k})")
        if k + 1 < states:
            parts.append(of(_CORNERS, k))
            parts.append(f"dl{k} AS (SELECT idx, " + ", ".join(f"sum(w * ((pix * {i + 3} + {k}) % 9 - 4) * 0.0078125) AS d{i}" for i in range(8)) + f" FROM t{k} JOIN pixels p ON p.x = px AND p.y = py GROUP BY idx)")
            parts.append(f"splats{k + 1} AS (SELECT image_id, idx, {clamp('x + d6 * 2.56 / 32')} AS x, {clamp('y + d7 * 2.56 / 32')} AS y, lc_xx + d0 AS lc_xx, lc_xy + d1 AS lc_xy, lc_yy + d2 AS lc_yy, {clamp('r + d3')} AS r, {clamp('g + d4')} AS g, {clamp('b + d5')} AS b, weight FROM splats{k} JOIN dl{k} USING (idx))")
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(scores)


@query(_rounds_sql(4))
def correction_rounds(spark: SparkSession, d: str) -> DataFrame:
    """M7, M9, A11 by state."""
    _, scores = R.correction_rounds(X.splats(spark, d), X.image(spark), X.deltas(spark, 3), 4, *SIZE)
    return scores.select("k", F.round("squared_error", 3).alias("squared_error"), F.round("psnr", 3).alias("psnr"))


@query("WITH all_states AS (" + _rounds_sql(4).replace("round(sum(e), 3)", "sum(e)").replace("round(-10 * log10(greatest(sum(e) / (count(*) * 3), 1e-10)), 3)", "-10 * log10(greatest(sum(e) / (count(*) * 3), 1e-10))") + """), t AS (SELECT (min(psnr) + max(psnr)) / 2 AS target, (max(psnr) - min(psnr)) / 100 AS gain FROM all_states
), s AS (SELECT k, squared_error, psnr, psnr - lag(psnr) OVER (ORDER BY k) AS more FROM all_states)
SELECT 'target' AS rule, k, round(squared_error, 3) AS squared_error, round(psnr, 3) AS psnr FROM s, t WHERE k <= coalesce((SELECT min(k) FROM s, t WHERE psnr >= target), 3)
UNION ALL SELECT 'gain', k, round(squared_error, 3), round(psnr, 3) FROM s WHERE k <= coalesce((SELECT min(k) FROM s, t WHERE more < gain), 3)""")
def adaptive_rounds(spark: SparkSession, d: str) -> DataFrame:
    """M9: rounds that end with the first state at or over a target, half-way between the worst and the best of four, or with the first that gains less than a hundredth of that range."""
    splats, image, deltas = X.splats(spark, d), X.image(spark), X.deltas(spark, 3)
    _, every = R.correction_rounds(splats, image, deltas, 4, *SIZE)
    low, high = every.agg(F.min("psnr"), F.max("psnr")).first()
    out = None
    for rule, limits in (("target", {"target": (low + high) / 2}), ("gain", {"least_gain": (high - low) / 100})):
        _, scores = R.correction_rounds(splats, image, deltas, 4, *SIZE, **limits)
        part = scores.select(F.lit(rule).alias("rule"), "k", F.round("squared_error", 3).alias("squared_error"), F.round("psnr", 3).alias("psnr"))
        out = part if out is None else out.union(part)
    return out


@query(f"WITH RECURSIVE {X.PIXELS}, {X.SPLATS}, {_CORNERS}, dl AS (SELECT idx, k, " + ", ".join(f"sum(w * ((pix * {i + 3} + k) % 9 - 4) * 0.0078125) AS d{i}" for i in (3, 4, 5)) + " FROM t JOIN pixels p ON p.x = px AND p.y = py, range(3) s(k) GROUP BY idx, k), st AS (SELECT idx, 0 AS k, r, g, b FROM splats UNION ALL SELECT st.idx, st.k + 1, greatest(0.0, least(1.0, r + d3)), greatest(0.0, least(1.0, g + d4)), greatest(0.0, least(1.0, b + d5)) FROM st JOIN dl ON dl.idx = st.idx AND dl.k = st.k) SELECT idx, k, " + _r("r", "g", "b") + " FROM st")
def latent_replay(spark: SparkSession, d: str) -> DataFrame:
    """M10."""
    first = X.splats(spark, d)
    looked = None
    for k in range(3):
        part = R.bilinear(first, X.deltas(spark, 3).where(F.col("k") == k).drop("k"), ["d3", "d4", "d5"], *SIZE).select("image_id", "idx", F.lit(k).alias("k"), "d3", "d4", "d5")
        looked = part if looked is None else looked.union(part)
    return R.replay_latent(first, looked).select("idx", "k", *r6(**{c: F.col(c) for c in "rgb"}))


@query(_RENDER + f", {X.POINTS}, c AS (SELECT (least(31, greatest(0, floor(y * 32))) * 32 + least(31, greatest(0, floor(x * 32))))::INTEGER AS pix, count(*)::DOUBLE AS n FROM points GROUP BY 1), i AS (SELECT pix, pix % 8 / 8.0::DOUBLE AS r, pix % 16 / 16.0::DOUBLE AS g, pix % 32 / 32.0::DOUBLE AS b FROM pixels) SELECT p.pix, " + _r(r="i.r", g="i.g", b="i.b", render_r="s.r", render_g="s.g", render_b="s.b", diff_r="i.r - s.r", diff_g="i.g - s.g", diff_b="i.b - s.b", density="p.density", lc_xx="p.lc_xx", lc_xy="p.lc_xy", lc_yy="p.lc_yy", map_r="p.map_r", map_g="p.map_g", map_b="p.map_b", n_points="coalesce(c.n, 0.0)") + " FROM pixels p JOIN i USING (pix) JOIN shown s USING (pix) LEFT JOIN c USING (pix)")
def feature_stack(spark: SparkSession, d: str) -> DataFrame:
    """All 17 columns."""
    pixels = X.pixels(spark, d).join(X.image(spark).select("image_id", "pix", "r", "g", "b"), ["image_id", "pix"])
    counts = A.hard_counts(X.points(spark, d), X.empty_grid(spark), G.pixel_of(F.col("x"), F.col("y"), *SIZE))
    found = R.features(pixels, _shown(spark, d), counts)
    return found.select("pix", *r6(**{c: F.col(c) for c in found.columns if c not in ("image_id", "pix")}))


# ---------------------------------------------------------------- placement and streams


def _matching_sql() -> str:
    """Eight columns of proposals, one after the other: of those to one cell the lightest wins."""
    found = SQL["lightest_neighbours"]
    at = found.rindex("SELECT src, dst, (rank - 1)")
    out = found[:at] + f", near AS ({found[at:]}), ranked AS (SELECT idx, row_number() OVER (ORDER BY mass, idx) - 1 AS rk, count(*) OVER () // 3 AS most FROM cells WHERE n_pixels > 0), m0 AS (SELECT idx, idx AS target FROM ranked WHERE false)"
    for c in range(8):
        out += f""", m{c + 1} AS (SELECT * FROM m{c} UNION ALL SELECT idx, dst FROM (SELECT idx, dst, row_number() OVER (PARTITION BY dst ORDER BY rk) AS k FROM ranked JOIN near ON src = idx AND rank = {c}
  WHERE rk < most AND idx NOT IN (SELECT idx FROM m{c}) AND dst NOT IN (SELECT idx FROM m{c})) WHERE k = 1)"""
    return out + " SELECT idx, target FROM m8"


@query(_matching_sql())
def merge_matching(spark: SparkSession, d: str) -> DataFrame:
    """M2."""
    owned = _owned(spark, d)
    cells = N.scratch(A.cell_mass(X.points(spark, d), owned).where("n_pixels > 0"), "cells")
    table = N.lightest_neighbours(N.adjacency(owned), cells)
    return M.match_round(cells, table, cells.count() // 3).select("idx", "target")


@query()
def equal_mass_placement(spark: SparkSession, d: str) -> DataFrame:
    """M1 to M6 (no SQL: an iteration)."""
    return M.equal_mass_voronoi(X.pixels(spark, d), 100, *SIZE, SEED).select("idx", "x", "y", "mass", "weight")


_BATCH = """WITH p AS (SELECT l_suppkey % 3 AS image_id, l_orderkey % 1024 AS pix, sum(CASE WHEN l_suppkey % 3 <> 2 OR l_orderkey % 1024 < 200 THEN l_quantity ELSE 0 END) AS density FROM lineitem GROUP BY 1, 2)"""


@query(_BATCH + " SELECT image_id, (40 + 25 * image_id)::BIGINT AS n_points, sum(density) AS mass, round(40 + 25 * image_id, 6)::DOUBLE AS weight, 0::BIGINT AS outside FROM p GROUP BY image_id")
def placement_of_a_batch(spark: SparkSession, d: str) -> DataFrame:
    """M3, M4, M6: images of different density with counts and seeds of their own; the counts are exact, and the cells keep all of the mass."""
    pixels, counts = X.batch(spark, d)
    placed = M.equal_mass_voronoi(pixels, counts, *SIZE)
    outside = ~(F.col("x").between(0.0, 1.0) & F.col("y").between(0.0, 1.0))
    return placed.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_points"), F.sum("mass").alias("mass"), F.round(F.sum("weight"), 6).alias("weight"), F.sum(outside.cast("long")).alias("outside"))


@query()
def sampled_splats(spark: SparkSession, d: str) -> DataFrame:
    """The composite of placement, look-up, renders and corrections (no SQL: iterations)."""
    states, _ = sampler.sample(X.pixels(spark, d), X.image(spark), *SIZE, X.deltas(spark, 6))
    return sampler.label_states(states).select("label", "idx", "x", "y", "lc_xx", "lc_xy", "lc_yy", *"rgb", "weight")


@query("""WITH RECURSIVE c AS (SELECT date_diff('day', DATE '2024-01-01', ts::DATE)::BIGINT AS frame, count(DISTINCT user_id) AS n FROM events GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY frame) AS k FROM c),
w AS (SELECT k, frame, n, n::DOUBLE AS s FROM o WHERE k = 1 UNION ALL SELECT o.k, o.frame, o.n, 0.9::DOUBLE * w.s + (1 - 0.9::DOUBLE) * o.n FROM w JOIN o ON o.k = w.k + 1)
SELECT frame, n, round(s, 6) AS smoothed, greatest(1, round_even(s, 0))::BIGINT AS n_target FROM w""")
def smoothed_counts(spark: SparkSession, d: str) -> DataFrame:
    """V2."""
    return tracks.smooth_counts(X.daily_counts(spark, d)).select("frame", "n", F.round("smoothed", 6).alias("smoothed"), "n_target")


@query()
def track_frames(spark: SparkSession, d: str) -> DataFrame:
    """V1, V3 to V13, W9, W10 over four streams (no SQL: state)."""
    return tracks.track_frames(X.frames(spark, d), 16, 16)


@query("""WITH f AS (SELECT user_id % 4 AS stream_id, date_diff('day', DATE '2024-01-01', ts::DATE)::BIGINT AS frame FROM events WHERE user_id IS NOT NULL GROUP BY 1, 2)
SELECT stream_id, frame, true AS ids_differ, true AS slots_differ, true AS weights_fit, true AS kept_fit FROM f""")
def track_invariants(spark: SparkSession, d: str) -> DataFrame:
    """V3, V4, V7 to V12 by what holds of every frame: ids and slots are one track's own, weights average 1, and survivors, kills and births of neighbouring frames agree with its count."""
    found = tracks.track_frames(X.frames(spark, d), 16, 16)
    n = F.count(F.lit(1))
    frames = found.groupBy("stream_id", "frame").agg(n.alias("n"), (F.countDistinct("track_id") == n).alias("ids_differ"), (F.countDistinct("slot") == n).alias("slots_differ"), ((F.abs(F.sum("weight") - n) < 1e-6) | (F.sum("mass") <= 0)).alias("weights_fit"), F.first("survivors").alias("s"), F.first("kills_for_next").alias("k"), F.first("births_for_next").alias("b"))
    before = W.partitionBy("stream_id").orderBy("frame")
    left = F.lag(F.col("n") - F.col("k")).over(before)
    fit = (F.col("s") == F.coalesce(left, F.lit(0))) & (F.col("n") == F.coalesce(left + F.lag("b").over(before), F.col("n")))
    return frames.withColumn("kept_fit", fit).select("stream_id", "frame", "ids_differ", "slots_differ", "weights_fit", "kept_fit")


@query(_CELLS + " SELECT idx, mass::BIGINT AS mass, n_pixels FROM cells WHERE mass > 0")
def stats_lines(spark: SparkSession, d: str) -> DataFrame:
    """K4, K5: written as JSON lines and read again."""
    lines = manifests.json_lines(_cells(spark, d).select("idx", F.col("mass").cast("long").alias("mass"), "n_pixels"))
    row = F.from_json("value", "idx int, mass bigint, n_pixels bigint").alias("v")
    return lines.select(row).select("v.*").where("mass > 0")


def entry(spark: SparkSession, d: str) -> DataFrame:
    return cell_masses(spark, d)
