"""Running sums, ranks and recurrences over groups of any size, by blocks: no group is ever in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.session import scratch

#: Rows of a group that are scanned in one task.
BLOCK = 4096
#: Steps of a recurrence that are folded together, as an array.
FOLD = 256

Totals = dict[str, tuple[Callable[[Column], Column], Column]]


def running(rows: DataFrame, group: list[str], order: str, totals: Totals, most: int, exclusive: bool = False, block: int = BLOCK) -> DataFrame:
    """``rows`` with a running total for each name of ``totals``: (F.sum or F.max, column), in the order of the long ``order``.

    ``order`` is unique in its group and lies in 0 to ``most``. Blocks of it are totalled
    where they are, the totals of all earlier blocks are joined back, found in
    the same way over the blocks; only within a block is there a window. ``exclusive``
    leaves the row itself out; what has nothing before it is null then. ``rows`` is
    evaluated twice.
    """
    of = f"__{order}_block"
    keys = [*group, of]
    dealt = rows.withColumn(of, F.expr(f"{order} div {block}").cast("long"))
    within = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1 if exclusive else 0)
    inner = dealt.withColumns({name: f(c).over(within) for name, (f, c) in totals.items()})
    if most < block:
        return inner.drop(of)
    whole = dealt.groupBy(*keys).agg(*[f(c).alias(f"__{name}") for name, (f, c) in totals.items()])
    before = running(whole, group, of, {f"__{name}": (f, F.col(f"__{name}")) for name, (f, _) in totals.items()}, most // block, exclusive=True, block=block)
    both = inner.join(before, keys, "left")
    for name, (f, _) in totals.items():
        mine, past = F.col(name), F.col(f"__{name}")
        joined = F.greatest(mine, past) if f is F.max else F.coalesce(mine + past, mine, past)
        both = both.withColumn(name, joined).drop(f"__{name}")
    return both.drop(of)


def ranked(rows: DataFrame, group: list[str], order: list[Column | str], out: str = "rank") -> DataFrame:
    """``rows`` with their place in the group from 0 by ``order``, which has to tell the rows of a group apart.

    Rows are dealt to ranges of (group, order), of which Spark samples the bounds, and
    numbered within; each range starts at the count of the group's earlier ones.
    """
    names = [f"__o{i}" for i in range(len(order))]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.withColumns({n: F.col(c) if isinstance(c, str) else c for n, c in zip(names, order)})
    dealt = scratch(keyed.repartitionByRange(parts, *group, *names).withColumn("__part", F.spark_partition_id().cast("long")), "ranges")
    counts = dealt.groupBy(*group, "__part").agg(F.count(F.lit(1)).alias("__n"))
    starts = running(counts, group, "__part", {"__start": (F.sum, F.col("__n"))}, parts, exclusive=True).select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__part").alias("__of"), "__start")
    on = F.col("__part") == F.col("__of")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    within = W.partitionBy(*group, "__part").orderBy(*names)
    numbered = dealt.withColumn(out, F.row_number().over(within) - 1).join(starts, on)
    place = (F.col(out) + F.coalesce("__start", F.lit(0))).cast("long")
    return numbered.withColumn(out, place).drop(*names, "__part", "__of", "__start", *[f"__g{i}" for i in range(len(group))])


def recurrence(rows: DataFrame, group: list[str], order: str, most: int, out: str = "s", fold: int = FOLD) -> DataFrame:
    """``rows`` (group, order, a, b) with s: a times the s of the row before plus b, from 0, in the order of the long ``order`` (0, 1, 2, ... in each group, up to ``most``).

    Such maps compose: those of a block are folded into one, the blocks' maps are
    scanned in the same way, and each block is unrolled from the s before it.
    """
    of, start = f"__{order}_block", f"__{order}_from"
    keys = [*group, of]
    steps = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b")))).alias("__steps")
    blocks = rows.select(*group, order, "a", "b", F.expr(f"{order} div {fold}").cast("long").alias(of)).groupBy(*keys).agg(steps)
    if most < fold:
        started = blocks.withColumn(start, F.lit(0.0))
    else:
        one = F.aggregate("__steps", F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b")), lambda m, v: F.struct((m["a"] * v["a"]).alias("a"), (m["b"] * v["a"] + v["b"]).alias("b")))
        whole = blocks.withColumn("__map", one).select(*keys, F.col("__map.a").alias("a"), F.col("__map.b").alias("b"))
        after = recurrence(whole, group, of, most // fold, start, fold)
        started = blocks.join(after.select(*group, (F.col(of) + 1).alias(of), start), keys, "left").fillna(0.0, [start])
    unrolled = F.aggregate("__steps", F.array(start), lambda acc, v: F.concat(acc, F.array(v["a"] * F.element_at(acc, -1) + v["b"])))
    found = started.select(*group, F.explode(F.arrays_zip(F.col("__steps.o").alias("o"), F.slice(unrolled, F.lit(2), F.size("__steps")).alias("s"))).alias("__v"))
    return rows.join(found.select(*group, F.col("__v.o").alias(order), F.col("__v.s").alias(out)), [*group, order])
