"""The corpus pipeline: toxicity, near-duplicates, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept. ``docs`` is read more than once by a stage, so it should be a table on
disk; :func:`run` writes what each stage returns and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, jaccard_join, mixing, sharding, toxicity
from tessera.llm.common import materialize, read

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores under the toxicity threshold; null and empty texts, and all rows where no labels of both classes are, stay."""
    learned = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, learned).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of links (five-word shingles, similarity 0.8 or more): the one with the least doc_id, null last, and of several the first; texts without words all stay."""
    return jaccard_join.drop_near_copies(docs, 5, 80, 100).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds less than 0.8 of the five-word shingles of every benchmark item; null and empty texts stay."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, in the order in which the sources are mixed: rows lie in that order, in files and across them. A null source is one of its own, and repeated rows have a place each."""
    return mixing.in_mix_order(docs).select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard (0 to 7, near equal in bytes, a null text counting as none) and slot; the slots of a shard follow the mixed order."""
    return sharding.shard_documents(docs, 8, keep_order=True).select(*COLUMNS, "shard", "slot")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix),
    ("sharding", shard),
]

#: The toxicity model and the hashes that order rows and shards are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
