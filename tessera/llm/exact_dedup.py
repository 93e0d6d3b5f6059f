"""Exact dedup with a heavy-hitter split.

The JVM digests every text; only digests go on. A pass over these keeps a
Misra-Gries summary for each task. The digests that the merged summaries name are
counted exactly (verified), and the verified ones, at most ``counters`` of them,
are broadcast: rows with such a digest are settled where they are read. All other
digests are shuffled, summed up before that.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, in_worker, materialize, placed, scratch_scope

COUNTERS = 1024


class MisraGries:
    """Counts that are too low by at most n / (counters + 1)."""

    def __init__(self, counters: int):
        self.counters, self.held = counters, Counter()

    def add(self, keys: list) -> None:
        self.held.update(keys)
        if len(self.held) > self.counters:
            cut = sorted(self.held.values(), reverse=True)[self.counters]
            self.held = Counter({k: n - cut for k, n in self.held.items() if n > cut})


def digest_of(text: Column) -> Column:
    """SHA-256 of the text after lower-casing A-Z; null is the empty text."""
    return F.unhex(F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256))


def summaries(rows: DataFrame, counters: int) -> DataFrame:
    """(digest, n) of the summary of each task."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = MisraGries(counters)
        for batch in batches:
            seen.add(batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(list(seen.held), pa.binary()), pa.array(list(seen.held.values()), pa.int64())], names=["digest", "n"])

    return rows.select("digest").mapInArrow(in_worker(summarise), "digest binary, n long")


def grouped(rows: DataFrame, rank: Column, counters: int) -> DataFrame:
    """``rows`` (digest and others; a table on disk) with ``best``, the highest ``rank`` of the rows with the same digest, and ``group_size``."""
    columns = rows.columns
    named = summaries(rows, counters).groupBy("digest").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "digest").limit(counters).select("digest")
    total = [F.max(rank).alias("best"), F.count(F.lit(1)).alias("group_size")]
    heavy = materialize(rows.join(F.broadcast(named), "digest", "left_semi").groupBy("digest").agg(*total).where("group_size > 1"), "heavy")
    small = F.broadcast(heavy)  # at most ``counters`` short rows
    rest = rows.join(small, "digest", "left_anti")
    settled = rows.join(small, "digest").unionByName(rest.join(rest.groupBy("digest").agg(*total), "digest"))
    return settled.select(*columns, "best", "group_size")


def mark_duplicates(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text), with the group of equal texts it is in.

    Returns doc_id, keep_id, group_size, kept, text_sha256. Texts are equal when
    identical after lower-casing A-Z; null counts as empty, and empty texts are
    equal to each other. The largest doc_id of a group stays (a null doc_id only
    in a group of nulls). Rows that repeat a doc_id and its text are one document
    and are marked alike. An empty table gives an empty result; other columns are
    not read.
    """
    rows = materialize(docs.select("doc_id", digest_of(F.col("text")).alias("digest")), "digests")
    best = F.col("best.doc_id")
    return grouped(rows, F.struct("doc_id"), counters).select("doc_id", best.alias("keep_id"), "group_size", F.col("doc_id").eqNullSafe(best).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """``docs`` with one row of each group of equal texts; all columns stay.

    The row with the largest doc_id stays (null is the least), of several the first
    in the table. Rows that share a doc_id but not a text are different documents.
    """
    rows = placed(docs)
    with scratch_scope(docs.sparkSession) as scope:
        held = materialize(rows.select("doc_id", "__place", digest_of(F.col("text")).alias("digest")), "digests")
        marked = grouped(held, F.struct("doc_id", (-F.col("__place")).alias("first")), counters)
        lost = scope.keep(materialize(marked.where(F.col("__place") != -F.col("best.first")).select(F.col("__place").alias("__lost")), "duplicates"))
    return rows.join(lost, F.col("__place") == F.col("__lost"), "left_anti").select(*docs.columns)
