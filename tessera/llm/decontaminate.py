"""Benchmark decontamination by size-partitioned MinHash containment search, with DataFrame operations only.

An item is contained in a document that has at least ceil(threshold * n) of its n
shingles, so at most m = n - ceil(threshold * n) are missing.

1. Items are partitioned by size (powers of two). The signature of an item is its
   k = min(n, 2 m + 1) least hashes: k MinHash values under one hash function. A
   document that contains the item has at least k - m of them.
2. The signature of a document for a partition is all its hashes up to the largest
   that an item of the partition has in its signature, so long documents have long
   signatures and no short item is lost in them. Signatures meet by value; pairs
   with at least k - m common values are candidates. All pairs sought are among
   them, and few others.
3. Candidates are verified: the shingles of the candidate documents alone are
   gathered again, and those shared with the candidate items are counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, placed, scratch_scope

WIDTH, THRESHOLD = 5, 0.8
#: Signature values of all items, and candidate documents, that are broadcast at most; more are shuffled.
BROADCAST_VALUES = 1_000_000


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles_of(words: str, width: int) -> Column:
    """Hashes of the ``width``-word shingles of the array column ``words``; none if it has fewer words."""
    parts = ", ".join(f"{words}[i + {k}]" for k in range(width))
    return F.expr(f"transform(slice(sequence(0, greatest(size({words}) - {width}, 0)), 1, greatest(size({words}) - {width - 1}, 0)), i -> xxhash64({parts}))")


def at_most(values: Column, bound: int) -> Column:
    return F.filter(values, lambda v: v <= F.lit(bound))


def small(df: DataFrame) -> DataFrame:
    """``df``, a table on disk, broadcast if its rows, all of a few longs, are few enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_VALUES else df


def signatures(benchmark: DataFrame, width: int, threshold: float) -> DataFrame:
    """Rows (item_id, len, n_item, least, part, item, signature): an item's shingles, how many words each has, and its MinHash values, ``least`` of which a document that contains it has."""
    items = benchmark.where("item_id is not null").select("item_id", words_of(F.coalesce("text", F.lit(""))).alias("__w"))
    items = items.withColumn("len", F.least(F.size("__w"), F.lit(width))).where("len > 0")
    of_item = F.lit(None).cast("array<bigint>")
    for n in range(1, width + 1):
        of_item = F.when(F.col("len") == n, shingles_of("__w", n)).otherwise(of_item)
    shingles = items.select("item_id", "len", F.explode(of_item).alias("shingle"))
    held = shingles.groupBy("item_id").agg(F.max("len").alias("len"), F.sort_array(F.collect_set("shingle")).alias("item")).withColumn("n_item", F.size("item"))
    missing = F.col("n_item") - F.ceil(F.col("n_item") * F.lit(threshold) - 1e-9)
    k = F.least(F.col("n_item"), 2 * missing + 1).cast("int")
    return held.select("item_id", "len", "n_item", (k - missing).cast("int").alias("least"), F.floor(F.log2(F.col("n_item").cast("double"))).cast("int").alias("part"), "item", F.slice("item", F.lit(1), k).alias("signature"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, key: str = "doc_id") -> DataFrame:
    """Pairs (doc_id, item_id, n_item, n_shared, containment) of documents that hold at least ``threshold`` of an item's shingles.

    ``docs`` has ``key`` (named doc_id in the result) and text, ``benchmark`` item_id
    and text; other columns are not read. Words are lower-case runs of letters and
    digits, shingles distinct ``width``-word runs; an item with fewer words is one
    shingle of its own length. Null, empty and wordless texts have no shingles and
    appear in no pair; nor do rows with a null id. Rows that repeat an id are one
    document, with the shingles of all of them, and likewise for items. Empty
    tables give an empty result.
    """
    items = materialize(signatures(benchmark, width, threshold), "items")
    # one row for each size partition and shingle length: at most 31 * width
    bounds = items.groupBy("part", "len").agg(F.max(F.array_max("signature")).alias("bound")).collect()
    values = small(materialize(items.select("item_id", "least", F.explode("signature").alias("value")), "signatures"))

    lengths = {n: max(r["bound"] for r in bounds if r["len"] == n) for n in sorted({r["len"] for r in bounds})}
    split = docs.where(F.col(key).isNotNull() & F.col("text").isNotNull()).select(F.col(key).alias("doc_id"), words_of(F.col("text")).alias("__w"))

    def of_doc(bounded: bool) -> Column:
        """A document's shingles, or its signature: those that some partition asks for."""
        parts = [at_most(shingles_of("__w", n), bound) if bounded else shingles_of("__w", n) for n, bound in lengths.items()]
        return F.array_distinct(F.concat(*parts)) if parts else F.array().cast("array<bigint>")

    met = split.select("doc_id", F.explode(of_doc(True)).alias("value")).join(values, "value")
    common = met.groupBy("doc_id", "item_id").agg(F.countDistinct("value").alias("common"), F.max("least").alias("least"))
    candidates = materialize(common.where("common >= least").select("doc_id", "item_id"), "candidates")

    asked = small(materialize(candidates.select("doc_id").distinct(), "candidate-documents"))
    wanted = candidates.join(items.select("item_id", "n_item", F.explode("item").alias("shingle")), "item_id")
    vocabulary = small(materialize(items.select(F.explode("item").alias("shingle")).distinct(), "vocabulary"))
    held = split.join(asked, "doc_id", "left_semi").select("doc_id", F.explode(of_doc(False)).alias("shingle")).join(vocabulary, "shingle", "left_semi")
    shared = held.distinct().join(wanted, ["doc_id", "shingle"]).groupBy("doc_id", "item_id", "n_item").agg(F.count(F.lit(1)).alias("n_shared"))
    checked = shared.where(F.col("n_shared") >= F.ceil(F.col("n_item") * F.lit(threshold) - 1e-9))
    return checked.select("doc_id", "item_id", F.col("n_item").cast("long").alias("n_item"), "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose text holds at least ``threshold`` of an item's shingles, see :func:`find_contamination`.

    Every row is judged by its own text, with or without an id, and repeated rows
    alike; all columns stay.
    """
    rows = placed(docs)
    with scratch_scope(docs.sparkSession) as scope:
        found = find_contamination(rows, benchmark, width, threshold, "__place").select(F.col("doc_id").alias("__found")).distinct()
        found = scope.keep(materialize(found, "contaminated"))
    return rows.join(small(found), F.col("__place") == F.col("__found"), "left_anti").select(*docs.columns)
