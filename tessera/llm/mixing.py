"""Mixing sources to target weights by Pfair scheduling.

The rows of a source are dealt, in a seeded random order, into blocks. Block j
of a source with weight w is released at slot floor(j / w) and due by
ceil((j + 1) / w); of the released blocks, the one with the earliest deadline
takes the next slot. Weights are exact rationals and nothing is rounded to a
period: at every slot of a segment, however long, each source is less than one
block away from its weight's share of it.

When a source has no blocks left, a new segment begins in which the others
share its weight in proportion. Every row gets exactly one position.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import chain
from math import floor, gcd, lcm

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, placed, positions, scratch_path

BLOCK = 16
#: Target weights are (rows of a source) ** TEMPERATURE, scaled to sum to 1, unless weights are given.
TEMPERATURE = 0.5
#: Blocks of a source in one row of the schedule's table, and blocks that the driver writes at once.
RUN, WRITTEN_AT_ONCE = 1024, 1 << 21


def shares(weights: dict[str, float], period: int) -> dict[str, int]:
    """Whole shares of the period, at least 1 each, by largest remainder."""
    total, period = sum(weights.values()), max(period, len(weights))
    exact = {s: w / total * period for s, w in weights.items()}
    out = {s: max(1, floor(x)) for s, x in exact.items()}
    left = period - sum(out.values())
    order = sorted(exact, key=lambda s: (out[s] - exact[s], s))
    while left > 0:
        for s in order[:left]:
            out[s] += 1
        left = period - sum(out.values())
    while left < 0:
        largest = max(out, key=lambda s: (out[s] - exact[s] if out[s] > 1 else -period, s))
        out[largest] -= 1
        left += 1
    return out


def whole_weights(weights: dict[str, float]) -> dict[str, int]:
    """Integers in exactly the proportion of the weights."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    if any(w <= 0 for w in exact.values()):
        raise ValueError("weights must be above 0")
    common = lcm(*(w.denominator for w in exact.values()))
    whole = {s: int(w * common) for s, w in exact.items()}
    divisor = gcd(*whole.values())
    return {s: w // divisor for s, w in whole.items()}


def schedule(blocks: dict[str, int], weights: dict[str, float]) -> Iterator[str]:
    """The source of each slot, for all blocks. A segment ends where a source is due that has no blocks left.

    What is held is one entry a source, however many blocks there are.
    """
    left = {s: n for s, n in blocks.items() if n}
    whole = whole_weights({s: weights[s] for s in left}) if left else {}
    while left:
        total = sum(whole[s] for s in left)
        waiting = [(0, s, 0) for s in sorted(left)]  # (release, source, block)
        ready: list[tuple[int, str, int]] = []
        slot = 0
        while True:
            while waiting and waiting[0][0] <= slot:
                _, s, j = heapq.heappop(waiting)
                heapq.heappush(ready, (-(-(j + 1) * total // whole[s]), s, j))
            _, s, j = heapq.heappop(ready)
            if not left[s]:
                break
            yield s
            left[s] -= 1
            slot += 1
            heapq.heappush(waiting, ((j + 1) * total // whole[s], s, j + 1))
        left = {s: n for s, n in left.items() if n}


def pfair(share: dict[str, int]) -> list[str]:
    """The source of each slot of one period (the sum of the shares)."""
    return list(schedule(share, share))


def schedule_table(spark: SparkSession, counts: dict[str, int], weights: dict[str, float], block: int) -> DataFrame:
    """Rows (source, part, slots, starts): slots and first positions of RUN blocks of a source, written in pieces.

    A source's last block may be short: later blocks start earlier by what it lacks.
    """
    left = {s: -(-n // block) for s, n in counts.items()}
    path, schema = scratch_path(spark, "schedule"), pa.schema([("source", pa.string()), ("part", pa.int64()), ("slots", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64()))])
    held: dict[str, tuple[list[int], list[int]]] = {s: ([], []) for s in counts}
    parts = dict.fromkeys(counts, 0)
    done: list[tuple[str, int, list[int], list[int]]] = []
    at = size = 0

    def write() -> None:
        columns = zip(*done) if done else ([], [], [], [])
        table = pa.table([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)
        spark.createDataFrame(table).coalesce(1).write.mode("append").parquet(path)

    for slot, s in enumerate(chain(schedule(left, weights), [None])):
        if s is not None:
            slots, starts = held[s]
            slots.append(slot)
            starts.append(at)
            left[s] -= 1
            at += block if left[s] else counts[s] - (-(-counts[s] // block) - 1) * block
            if len(slots) == RUN or not left[s]:
                done.append((s, parts[s], slots, starts))
                size += len(slots)
                held[s], parts[s] = ([], []), parts[s] + 1
        if size >= WRITTEN_AT_ONCE or s is None:
            write()
            done, size = [], 0
    return spark.read.schema("source string, part long, slots array<long>, starts array<long>").parquet(path)


def pooled(sizes: DataFrame, weigh: Callable[[Column, Column], Column], pools: int) -> dict[str, tuple[int, float]]:
    """Rows and weight of each pool of sources, of ``sizes`` (__source, count): at most ``pools``."""
    pool = pool_of(F.col("__source"), pools)
    rows = sizes.groupBy(pool.alias("pool")).agg(F.sum("count").alias("n"), F.sum(weigh(F.col("__source"), F.col("count"))).alias("w")).collect()
    return {r["pool"]: (r["n"], r["w"]) for r in rows}


def pool_of(source: Column, pools: int) -> Column:
    return F.concat(F.lit("pool:"), F.pmod(F.xxhash64(source), F.lit(pools)))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, period: int | None = None, seed: int = 17, max_sources: int | None = None) -> DataFrame:
    """``docs`` and the columns mix_block (slot of the row's block, gapless from 0) and mix_position (gapless from 0).

    ``weights`` maps a source to its target weight; sources without one get the
    smallest weight given. Without weights, see ``TEMPERATURE``. Weights are kept
    exactly, unless a ``period`` is given, to whole shares of which they are then
    rounded. A null source is a source of its own. Rows that repeat are placed one
    by one. Every source has its own share, however many there are; the driver holds
    an entry for each. Only a caller who gives ``max_sources`` has more of them dealt
    into as many pools; a pool's weight is the sum of its sources', and in a pool rows
    come in a random order, so in proportion to their sources' sizes. An empty table
    gives an empty result. Columns of the new names are replaced.
    """
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c.lower() not in ("mix_block", "mix_position")]
    docs = placed(docs, keep)
    spread = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.col("__place"), F.lit(seed)), 2)
    name = F.coalesce(F.concat(F.lit("s:"), F.col("source")), F.lit("null"))
    sizes = docs.groupBy(name.alias("__source")).count()
    counts = {r[0]: r[1] for r in (sizes if max_sources is None else sizes.limit(max_sources + 1)).collect()}
    least = min(weights.values()) if weights is not None else None
    if max_sources is not None and len(counts) > max_sources:
        given = F.create_map(*[F.lit(x) for s, w in (weights or {}).items() for x in ("null" if s is None else f"s:{s}", float(w))]) if weights else None
        weigh = lambda s, n: n ** F.lit(TEMPERATURE) if given is None else F.coalesce(given[s], F.lit(float(least)))
        found = pooled(sizes, weigh, max_sources)
        counts, target = {s: n for s, (n, _) in found.items()}, {s: w for s, (_, w) in found.items()}
        name = pool_of(name, max_sources)
    elif weights is None:
        target = {s: n**TEMPERATURE for s, n in counts.items()}
    else:
        target = {s: weights.get(s[2:] if s != "null" else None, least) for s in counts}
    if period is not None and counts:
        target = shares(target, period)
    table = schedule_table(spark, counts, target, block).toDF("__t_source", "__t_part", "__t_slots", "__t_starts")  # so that no column of docs has one of these names

    numbered = positions(docs.withColumn("__source", name), ["__source"], spread, [spread, F.col("__place")], out="__n")
    numbered = numbered.withColumns({"__part": F.expr(f"__n div {block * RUN}"), "__at": F.expr(f"int(__n div {block} % {RUN})")})
    met = numbered.join(table, (F.col("__source") == F.col("__t_source")) & (F.col("__part") == F.col("__t_part")))
    start = F.get("__t_starts", F.col("__at"))
    return met.select(*keep, F.get("__t_slots", F.col("__at")).alias("mix_block"), (start + F.expr(f"__n % {block}")).cast("long").alias("mix_position"))


def in_mix_order(docs: DataFrame, **options) -> DataFrame:
    """``docs`` in mixed order: rows lie in the order of the mix, in files and across them."""
    columns = docs.columns
    mixed = materialize(mix_sources(docs, **options), "mixed")
    return mixed.repartitionByRange("mix_position").sortWithinPartitions("mix_position").select(*columns)
