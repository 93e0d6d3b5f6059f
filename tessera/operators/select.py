"""Exact order statistics by radix: histograms of ever longer prefixes of an order-preserving key, instead of a sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.session import scratch

#: Bits that a round adds to the prefix: a group has at most 2^DIGIT bins under one prefix.
DIGIT = 16
#: Rows under a prefix that are ranked in one task.
FEW = 4096
#: Prefixes that are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 100_000
LEAST_NORMAL, MOST = 2.0**-1022, 1.7e308


def with_double_key(rows: DataFrame, value: Column, out: str) -> DataFrame:
    """``rows`` with a long that orders like a double: its bits, with those of negative numbers turned; minus zero is zero, NaN the largest.

    The parts are found one after the other, so that none is computed twice.
    """
    power = lambda e: F.pow(F.lit(2.0), e)
    v, size, guess, exponent = (F.col(c) for c in ("__d", "__size", "__guess", "__exponent"))
    sized = rows.withColumn("__d", value).withColumn("__size", F.abs(v))
    guessed = sized.withColumn("__guess", F.greatest(F.lit(-1022), F.least(F.lit(1023), F.floor(F.log2(F.greatest(F.least(size, F.lit(MOST)), F.lit(LEAST_NORMAL)))).cast("int"))))
    right = guessed.withColumn("__exponent", F.when((guess > -1022) & (size < power(guess)), guess - 1).when((guess < 1023) & (size >= power(guess + 1)), guess + 1).otherwise(guess))
    normal = F.shiftleft((exponent + 1023).cast("long"), 52) + ((size / power(exponent) - 1.0) * 2.0**52).cast("long")
    top = F.lit(2047 << 52)
    bits = F.when(F.isnan(v), top + 1).when(size == float("inf"), top).when(size < LEAST_NORMAL, (size * 2.0**537 * 2.0**537).cast("long")).otherwise(normal)
    keyed = right.withColumn("__bits", bits)
    return keyed.withColumn(out, F.when((v < 0) & ~F.isnan(v), -F.col("__bits")).otherwise(F.col("__bits"))).drop("__d", "__size", "__guess", "__exponent", "__bits")


def _keyed(rows: DataFrame, whole: Column, value: str) -> DataFrame:
    """(__g, __v, __key) of the values that are not null."""
    held = rows.where(F.col(value).isNotNull()).select(whole.alias("__g"), F.col(value).alias("__v"))
    if rows.schema[value].dataType.typeName() in ("byte", "short", "integer", "long"):
        return held.withColumn("__key", F.col("__v").cast("long"))
    return with_double_key(held, F.col("__v").cast("double"), "__key")


def _hint(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df


def at_ranks(rows: DataFrame, group: list[str], value: str, ranks: DataFrame) -> DataFrame:
    """``ranks`` (group, rank from 1) with value, the rank-th least of the group; below, how many values are less; and same, how many are equal to it.

    Nulls don't count. A rank that the group has not is left out. Every round counts
    the values under each prefix that is still open by the next 16 bits of their keys,
    where they lie; what moves is a histogram. A prefix with one value only is settled, one
    with few rows by ranking these, and all after four rounds.
    """
    whole = F.struct(*[F.col(g).alias(f"g{i}") for i, g in enumerate(group)]) if group else F.struct(F.lit(0).alias("g0"))  # structs of nulls are equal
    keyed = _keyed(rows, whole, value)
    state = scratch(ranks.select(whole.alias("__g"), F.col("rank").cast("long").alias("rank")).distinct().select("*", F.lit(0).cast("long").alias("__prefix"), F.col("rank").alias("__need"), F.lit(0).cast("long").alias("__below")), "ranks")
    few = state.count() <= MOST_BROADCAST
    done = None
    for shift in range(64 - DIGIT, -1, -DIGIT):
        under = keyed.withColumn("__prefix", F.lit(0).cast("long") if shift == 64 - DIGIT else F.shiftright("__key", shift + DIGIT))
        under = under.join(_hint(state.select("__g", "__prefix"), few), ["__g", "__prefix"], "left_semi")
        bins = under.groupBy("__g", "__prefix", F.shiftright("__key", shift).alias("__bin")).agg(F.count(F.lit(1)).alias("same"), F.min("__v").alias("value"), F.max("__v").alias("__top"))
        past = W.partitionBy("__g", "__prefix").orderBy("__bin").rowsBetween(W.unboundedPreceding, -1)
        bins = bins.withColumn("__past", F.coalesce(F.sum("same").over(past), F.lit(0)))
        met = bins.join(_hint(state, few), ["__g", "__prefix"]).where("__past < __need and __need <= __past + same")
        state = scratch(met.select("__g", "rank", F.col("__bin").alias("__prefix"), (F.col("__need") - F.col("__past")).alias("__need"), (F.col("__below") + F.col("__past")).alias("__below"), "same", "value", "__top"), "ranks")
        one = F.col("value") == F.col("__top") if shift else F.lit(True)
        settled = state.where(one).select("__g", "rank", "value", F.col("__below").alias("below"), "same")
        done = settled if done is None else done.unionByName(settled)
        if not shift:
            break
        open_ = state.where(~one)
        seen = open_.agg(F.count(F.when(F.col("same") <= FEW, 1)).alias("few"), F.count(F.when(F.col("same") > FEW, 1)).alias("many")).first()
        if seen["few"]:
            done = done.unionByName(_ranked_bins(keyed, open_.where(F.col("same") <= FEW), shift, few))
        if not seen["many"]:
            break
        state = open_.where(F.col("same") > FEW).drop("same", "value", "__top")
    return done.select(*[F.col(f"__g.g{i}").alias(g) for i, g in enumerate(group)], "rank", "value", "below", "same")


def _ranked_bins(keyed: DataFrame, state: DataFrame, shift: int, few: bool) -> DataFrame:
    """The values wanted under prefixes that few rows have."""
    inside = keyed.withColumn("__prefix", F.shiftright("__key", shift)).join(_hint(state.select("__g", "__prefix"), few), ["__g", "__prefix"], "left_semi")
    bin_ = W.partitionBy("__g", "__prefix").orderBy("__key")
    each = inside.withColumns({"__rn": F.row_number().over(bin_), "__less": F.rank().over(bin_) - 1, "__same": F.count(F.lit(1)).over(W.partitionBy("__g", "__prefix", "__key"))})
    met = each.join(_hint(state.drop("same", "value", "__top"), few), ["__g", "__prefix"]).where("__rn = __need")
    return met.select("__g", "rank", F.col("__v").alias("value"), (F.col("__below") + F.col("__less")).alias("below"), F.col("__same").alias("same"))


def mark_least(rows: DataFrame, group: list[str], value: str, tie: str, need: DataFrame, out: str = "taken") -> DataFrame:
    """``rows`` with a boolean ``out``: whether a row is among the first ``need`` (a table group, need) of its group by (value, tie).

    A need of 0 or a group without one takes nothing, a need beyond the group's size all
    of it. Groups may not be null; ``tie`` is a number that tells rows of equal value apart.
    """
    wanted = scratch(need.where("need > 0").select(*group, F.col("need").cast("long").alias("__need")), "needs")
    few = wanted.count() <= MOST_BROADCAST
    cut = scratch(at_ranks(rows, group, value, wanted.withColumnRenamed("__need", "rank")).select(*group, F.col("value").alias("__cut"), (F.col("rank") - F.col("below")).alias("__left"), "same"), "cuts")
    torn = cut.where("__left < same")
    last = torn.select(*group, F.lit(None).cast("long").alias("__last"))
    if not torn.isEmpty():
        ties = rows.join(_hint(torn, few), group).where(F.col(value) == F.col("__cut")).select(*group, tie)
        last = at_ranks(ties, group, tie, torn.select(*group, F.col("__left").alias("rank"))).select(*group, F.col("value").alias("__last"))
    bounds = scratch(wanted.join(cut.select(*group, "__cut"), group, "left").join(last, group, "left"), "bounds")
    met = rows.join(_hint(bounds, few), group, "left")
    inside = (F.col(value) < F.col("__cut")) | ((F.col(value) == F.col("__cut")) & (F.col("__last").isNull() | (F.col(tie) <= F.col("__last"))))
    taken = F.col("__need").isNotNull() & F.coalesce(inside, F.col("__cut").isNull())
    return met.withColumn(out, taken).drop("__need", "__cut", "__last")


def quantiles(rows: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(group, name of each share): exact quantiles, between the two nearest values where a share falls between them; null where a group has no values."""
    counts = rows.groupBy(*group).agg(F.count(value).alias("__n"))
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), ((F.col("__n") - 1) * F.lit(float(p))).alias("at")) for k, p in enumerate(shares.values())]))
    low = F.floor("__q.at")
    wanted = scratch(counts.select(*group, at.alias("__q")).select(*group, F.col("__q.k").alias("__k"), (low + 1).alias("__low"), (F.ceil("__q.at") + 1).alias("__high"), (F.col("__q.at") - low).alias("__part")), "quantiles")
    found = at_ranks(rows, group, value, wanted.select(*group, F.explode(F.array("__low", "__high")).alias("rank")))
    whole = lambda: F.struct(*group) if group else F.struct(F.lit(0))  # noqa: E731  structs of nulls are equal
    by_rank = found.groupBy(whole().alias("__g")).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("__at"))
    met = wanted.withColumn("__g", whole()).join(by_rank, "__g", "left")
    low, high = F.try_element_at("__at", F.col("__low")), F.try_element_at("__at", F.col("__high"))
    each = met.select(*group, "__k", (low + (high - low) * F.col("__part")).alias("__value"))
    return each.groupBy(*group).agg(*[F.max(F.when(F.col("__k") == k, F.col("__value"))).alias(name) for k, name in enumerate(shares)])
