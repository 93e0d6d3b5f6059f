"""The opN_ queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import covering_simhash, decontaminate, exact_dedup, jaccard_join, lm_score, mixing, periodic_runs, pii, repeated_bytes, sharding, toxicity, url_filter, whitening
from tessera.llm.common import SPACES, doc_crc, materialize, positions, read


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(read(spark, sf_dir, "pages"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    narrow = materialize(sharding.with_keys(docs).withColumn("text_crc32", crc).drop("text"), "shard-keys")
    placed = narrow.withColumn("shard", sharding.shard_of(sharding.plan_shards(narrow, 8)))
    numbered = positions(placed, ["shard"], sharding.spread_of(), ["__key", "__sub_key"], out="slot")
    return numbered.select("doc_id", F.col("__size").alias("size"), "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix_sources(docs)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(read(spark, sf_dir, "documents"), 3, 90, 100).select("doc_id", "n_shingles", "component_id")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_bytes.find_repeats(read(spark, sf_dir, "documents"))
    removed = F.col("n_bytes") - F.length("kept")
    return found.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_duplicates(read(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(read(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(joined(of(*pii.BASE)).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held = lm_score.held_out(F.col("doc_id"))
    scored = lm_score.score_texts(docs, docs.where(~held))
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text; in a tenth of the rows, by crc32 of the doc_id, the words from a place on repeat with a period. Rows without a doc_id stay as they are."""
    chosen = F.col("doc_id").isNotNull() & (doc_crc(F.col("doc_id")) % 10 == 0)
    words = docs.select("doc_id", "text", F.when(chosen, F.filter(F.split("text", SPACES), lambda w: w != "")).alias("w"))
    sized = words.withColumns({"n": F.size("w"), "g": F.floor(doc_crc(F.col("doc_id")) / 10)})
    placed = sized.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    period = placed.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    repeats = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    tail = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), repeats))
    changed = F.array_join(F.slice(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), F.lit(1), F.col("n")), " ")
    return period.select("doc_id", F.when(F.col("n") > 0, changed).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(planted_periods(read(spark, sf_dir, "documents")))
    longest = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("a"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    best = found.withColumns({"best": F.when(F.size("runs") > 0, longest), "lines": lines})
    length = -F.col("best.a")
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
        F.floor(length * 1000 / F.col("best.period")).alias("exponent_milli"), F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op13_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = covering_simhash.simhash_components(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_url_filters, op2_sharding, op3_mixing, op4_jaccard_join, op5_decontamination, op6_repeated_bytes, op7_exact_dedup, op8_pii, op9_toxicity, op10_lm_score, op11_periodic_runs, op12_whitening, op13_simhash_dedup]
    return {f.__name__: f for f in found}


#: Host and path as the contract defines them.
_URL_PARTS = r"""
WITH parts AS (
  SELECT page_id,
         CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN ''
              ELSE regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*', 0, 's') END AS raw_host,
         CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN ''
              ELSE regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*(/[^?#]*)?', 1, 's') END AS path
  FROM pages
), split AS (
  SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parts
), ruled AS (
  SELECT *,
         CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
              WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
              WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
              WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM split
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
            WHEN rule IN ('example.com/de/', 'net/') THEN 'block'
            WHEN regexp_matches(host || path, 'spam|pills|casino|xxx|/ad[^/]/|/track[^/]*/[^/]*\.gif$|^[^/]*\.biz/|^ads[^/]*\.[^/]*\.[^/]*/', 's') THEN 'block'
            ELSE 'allow' END AS verdict
FROM ruled
"""

_EXACT_DEDUP = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""


_DECONTAMINATION = r"""
WITH words AS (
  SELECT 0 AS kind, doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents
  UNION ALL
  SELECT 1, item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') FROM benchmark
), shingles AS (
  SELECT DISTINCT kind, id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT kind, id, w, unnest(range(1, len(w) - 3)) AS i FROM words)
  UNION
  SELECT kind, id, array_to_string(w, ' ') FROM words WHERE kind = 1 AND len(w) BETWEEN 1 AND 4
), items AS (SELECT id AS item_id, s, count(*) OVER (PARTITION BY id) AS n_item FROM shingles WHERE kind = 1)
SELECT d.id AS doc_id, item_id, n_item, count(*) AS n_shared, count(*)::DOUBLE / n_item AS containment
FROM shingles d JOIN items ON d.kind = 0 AND d.s = items.s
GROUP BY d.id, item_id, n_item
HAVING count(*) >= ceil(n_item * 0.8 - 1e-9)
"""



_SHARDING = """
WITH crc_table AS (
  SELECT list(v ORDER BY i) AS crc FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, r: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) t(i))
), keyed AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 1 AS size, hex(encode(coalesce(text, ''))) AS h,
         ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS k, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS s
  FROM documents
), whole AS (SELECT sum(size)::DOUBLE AS total, count(*) AS n FROM keyed
), by_text AS (SELECT k, sum(size)::DOUBLE AS b FROM keyed GROUP BY k
), groups AS (SELECT k, b, sum(b) OVER (ORDER BY k) - b AS low FROM by_text
), by_row AS (SELECT k, s, sum(size)::DOUBLE AS b FROM keyed GROUP BY k, s
), rows_of AS (SELECT k, s, b, sum(b) OVER (PARTITION BY k ORDER BY s) - b AS low FROM by_row
), cuts AS (
  SELECT i, k, total / 8 * i - low AS under, low + b - total / 8 * i AS above, total / 8 * 0.005 AS near
  FROM whole, range(1, 8) r(i), groups WHERE low <= total / 8 * i AND total / 8 * i < low + b
), splitters AS (
  SELECT CASE WHEN c.under = 0 OR (c.under <= c.above AND c.under <= near) THEN c.k WHEN c.above <= near THEN c.k + 1 ELSE c.k END AS k,
         CASE WHEN c.under = 0 OR least(c.under, c.above) <= near THEN 0 WHEN c.under - r.low <= r.low + r.b - c.under THEN r.s ELSE r.s + 1 END AS s
  FROM cuts c JOIN rows_of r ON r.k = c.k AND r.low <= c.under AND c.under < r.low + r.b
), dealt AS (
  SELECT keyed.*, (SELECT count(*) FROM splitters p WHERE keyed.k > p.k OR (keyed.k = p.k AND keyed.s >= p.s)) AS shard FROM keyed
)
SELECT doc_id, size::BIGINT AS size,
       xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(size - 1), lambda j: ('0x' || substr(h, 2 * j + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]))) AS text_crc32,
       'bytes' AS law, shard::INTEGER AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY (k + s) % greatest(256, ceil(n / 20000.0)::BIGINT), k, s) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM dealt, whole, crc_table
"""

_JACCARD = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, hash(w[i : i + 2]) AS h, md5(array_to_string(w[i : i + 2], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT x.doc_id AS u, y.doc_id AS v FROM shingles x JOIN shingles y ON x.h = y.h AND x.s = y.s AND x.doc_id <> y.doc_id
    JOIN sizes a ON a.doc_id = x.doc_id JOIN sizes b ON b.doc_id = y.doc_id
  WHERE a.n * 10 >= b.n * 9 AND b.n * 10 >= a.n * 9
  GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS u, doc_id AS v FROM documents
  UNION SELECT reach.u, links.v FROM reach JOIN links ON links.u = reach.v
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.c AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN (SELECT u, min(v) AS c FROM reach GROUP BY u) r ON r.u = d.doc_id
"""

_REPEATS = """
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), windows AS (
  SELECT doc_id, p, md5(substr(h, 2 * p + 1, 400)) AS w FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - 199)) AS p FROM texts WHERE length(h) >= 400)
), hits AS (SELECT doc_id, p FROM windows QUALIFY count(*) OVER (PARTITION BY w) > 1
), edges AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 200 THEN 0 ELSE 1 END AS fresh FROM hits
), runs AS (
  SELECT doc_id, min(p) AS a, max(p) + 200 AS b FROM (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM edges) GROUP BY doc_id, g
), cuts AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM runs
), kept AS (
  SELECT t.doc_id, count(c.a) AS n_spans, coalesce(sum(c.b - c.a), 0) AS n_removed,
         coalesce(string_agg(substr(t.h, 2 * c.since + 1, 2 * (c.a - c.since)), '' ORDER BY c.a), '') || substr(any_value(t.h), 2 * coalesce(max(c.b), 0) + 1) AS rest, any_value(length(t.h)) // 2 AS n
  FROM texts t LEFT JOIN cuts c ON c.doc_id = t.doc_id GROUP BY t.doc_id
)
SELECT doc_id, n::BIGINT AS n_bytes, n_removed::BIGINT AS n_removed, n_spans::BIGINT AS n_spans, sha256(unhex(rest)) AS kept_sha256 FROM kept
"""


#: Matches are set between two private characters, so that the lengths of what lies between give their places.
_PII = r"""
WITH kinds(kind, ord, pattern, marked) AS (VALUES
  ('email', 0, '([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)', '<\1>'),
  ('ip', 1, '([0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+))', '<\1>'),
  ('card', 2, '([0-9](?:[\x20-]?[0-9])+)', '<\1>'),
  ('phone', 3, '(\+[0-9][\x20().0-9-]+[0-9])', '<\1>'),
  ('url', 4, '([\p{L}]+://[^\s/?#@:]+:[^\s/?#@]+@[A-Za-z0-9.-]+)', '<\1>'),
  ('account', 5, '(^|[^\p{L}\p{N}])((?i:iban|ssn|account|acct|passport|token|secret|api_key|password)[\x20]{0,3}(?:number|no\.?|key)?[\x20]{0,3}[:=#]?[\x20]{0,3}["'']?)([A-Za-z0-9](?:[A-Za-z0-9_.+/~-]*[A-Za-z0-9])?={0,2})', '\1\2<\3>')
), pieces AS (
  SELECT doc_id, kind, ord, string_split(regexp_replace(coalesce(text, ''), pattern, replace(replace(marked, '<', chr(57344)), '>', chr(57345)), 'g'), chr(57344)) AS p FROM documents, kinds
), places AS (
  SELECT doc_id, kind, ord, split_part(p[i], chr(57345), 1) AS m, length(p[1]) + coalesce(list_sum(list_transform(p[2 : i - 1], lambda x: length(x) - 1)), 0) AS a
  FROM (SELECT *, unnest(range(2, len(p) + 1)) AS i FROM pieces)
), digits AS (SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS d FROM places
), valid AS (
  SELECT * FROM digits WHERE CASE kind
    WHEN 'ip' THEN len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(ltrim(x, '0') AS INTEGER), 0) > 255)) = 0
    WHEN 'card' THEN length(d) BETWEEN 14 AND 19 AND list_sum(list_transform(range(length(d)), lambda j: CASE WHEN j % 2 = 0 THEN substr(d, length(d) - j, 1)::INTEGER ELSE substr(d, length(d) - j, 1)::INTEGER * 2 - CASE WHEN substr(d, length(d) - j, 1)::INTEGER > 4 THEN 9 ELSE 0 END END)) % 10 = 0
    WHEN 'phone' THEN length(d) BETWEEN 10 AND 15
    WHEN 'account' THEN length(m) >= 6 AND d <> '' ELSE true END
), named AS (SELECT doc_id, kind, ord, a, kind || ':' || a || ':' || (a + length(m)) AS s FROM valid
), held AS (
  SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
         string_agg(s, ',' ORDER BY a, ord) FILTER (ord < 4) AS base, string_agg(s, ',' ORDER BY a, ord) AS spans FROM named GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN held h ON h.doc_id = d.doc_id
"""


#: The runs are the islands, among all pairs of equal words a lag apart, that are long enough.
_PERIODIC_RUNS = r"""
WITH crc_table AS (
  SELECT list(v ORDER BY i) AS crc FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, r: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) t(i))
), words AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]))) AS h
  FROM documents, crc_table
), sized AS (SELECT doc_id, w, len(w) AS n, h // 10 AS g, h % 10 = 0 AND len(w) > 0 AS chosen FROM words
), placed AS (SELECT *, CASE WHEN chosen THEN g % n END AS a FROM sized
), period AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM placed
), texts AS (
  SELECT doc_id, n, CASE WHEN chosen THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) ELSE w END AS w FROM period
), tokens AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS x FROM texts
), pairs AS (SELECT a.doc_id, b.i - a.i AS q, a.i FROM tokens a JOIN tokens b ON a.doc_id = b.doc_id AND a.x = b.x AND b.i > a.i AND b.i - a.i <= a.n // 4
), lags AS (SELECT doc_id, q FROM pairs GROUP BY doc_id, q HAVING count(*) >= greatest(6 - q, 3 * q)
), numbered AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM pairs SEMI JOIN lags USING (doc_id, q)
), islands AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS len FROM numbered GROUP BY doc_id, q, g HAVING count(*) + q >= greatest(6, 4 * q)
), runs AS (SELECT doc_id, s, len, min(q) AS q FROM islands GROUP BY doc_id, s, len
), dropped AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM runs
), kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM tokens ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id
), held AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(concat(s, ',', len, ',', q, chr(10)), '' ORDER BY s, q) AS lines,
         list({'s': s, 'len': len, 'q': q} ORDER BY len DESC, s, q)[1] AS best
  FROM runs GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.len::BIGINT AS length, best.q::BIGINT AS period,
       (1000 * best.len // best.q)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM documents d LEFT JOIN held USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_periodic_runs": _PERIODIC_RUNS, "op8_pii": _PII, "op2_sharding": _SHARDING, "op4_jaccard_join": _JACCARD, "op6_repeated_bytes": _REPEATS, "op5_decontamination": _DECONTAMINATION, "op1_url_filters": _URL_PARTS, "op7_exact_dedup": _EXACT_DEDUP}
