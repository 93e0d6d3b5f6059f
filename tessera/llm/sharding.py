"""Sharding by histogram sort, with DataFrame operations only.

Rows are ordered by (digest of the text, digest of the doc_id), so that equal
texts are neighbours. The splitters between shards are found by counting the exact
bytes below candidate boundaries, in rounds: each round divides the bracket of
every splitter into ``probes`` bins and keeps the bin that holds its target.
Rows then move once, to their final shard.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, placed, positions

BITS = 60  # of a key: under half the range of a long, so that differences of keys fit


@dataclass
class Splitter:
    """Rows at or above (key, sub_key) go to later shards."""

    key: int
    sub_key: int = 0


def key_of(text: Column) -> Column:
    """The first BITS bits of the MD5 of a text."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def with_keys(docs: DataFrame) -> DataFrame:
    """``docs`` and the columns __key, __sub_key and __size (bytes of the text plus 1)."""
    return docs.withColumns({
        "__key": key_of(F.coalesce("text", F.lit(""))),
        "__sub_key": key_of(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))),
        "__size": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1,
    })


def find_splitters(keyed: DataFrame, column: str, targets: list[float], tolerance: float, probes: int, group_tolerance: float) -> list[tuple[int, bool, float]]:
    """For each target (bytes below the splitter) a value of ``column``, whether the target lies inside that one value, and the bytes below it.

    Only ``probes`` rows for each open bracket reach the driver in a round.
    """
    open_, done = {i: (0, 1 << BITS, 0.0) for i in range(len(targets))}, {}
    while open_:
        brackets = sorted({b for b in open_.values()})
        bins = F.lit(None).cast("long")
        where = F.lit(False)
        for k, (lo, hi, _) in enumerate(brackets):
            step = -(-(hi - lo) // probes)
            inside = (F.col(column) >= F.lit(lo)) & (F.col(column) < F.lit(hi))
            bins = F.when(inside, F.lit(k * probes) + F.expr(f"({column} - {lo}L) div {step}L")).otherwise(bins)
            where = where | inside
        counted = keyed.where(where).groupBy(bins.alias("bin")).agg(F.sum("__size").alias("bytes"), F.min(column).alias("low"), F.max(column).alias("high")).collect()
        by_bracket: dict[int, list] = {}
        for r in sorted(counted, key=lambda r: r["bin"]):
            by_bracket.setdefault(r["bin"] // probes, []).append(r)
        left = {}
        for i, b in open_.items():
            lo, hi, below = b
            step = -(-(hi - lo) // probes)
            k = brackets.index(b)
            for r in by_bracket.get(k, []):
                start = lo + (r["bin"] - k * probes) * step
                if below + r["bytes"] <= targets[i]:
                    below += r["bytes"]
                    continue
                under, over = targets[i] - below, below + r["bytes"] - targets[i]
                if under <= tolerance:
                    done[i] = (r["low"], False, below)
                elif over <= tolerance:
                    done[i] = (r["high"] + 1, False, below + r["bytes"])
                elif r["low"] == r["high"]:
                    if min(under, over) <= group_tolerance:
                        done[i] = (r["low"], False, below) if under <= over else (r["low"] + 1, False, below + r["bytes"])
                    else:
                        done[i] = (r["low"], True, below)
                else:
                    left[i] = (max(start, r["low"]), min(start + step, r["high"] + 1), below)
                break
            else:
                done[i] = (hi, False, below)
        open_ = left
    return [done[i] for i in range(len(targets))]


def plan_shards(keyed: DataFrame, n_shards: int, tolerance: float = 0.0, group_tolerance: float = 0.005, probes: int = 256) -> list[Splitter]:
    """The splitters of ``keyed`` (with the columns of :func:`with_keys`), one fewer than shards.

    A splitter is final when the bytes below it are within ``tolerance`` of a
    shard's share; with 0, when its bin holds one text. It moves to the edge of a group of equal texts if that costs
    at most ``group_tolerance`` of a share; a larger group is divided by the hash
    of its doc_ids, in the same way.
    """
    total = keyed.agg(F.sum("__size")).first()[0] or 0
    share = total / n_shards
    targets = [share * i for i in range(1, n_shards)]
    if not total:
        return [Splitter(1 << BITS) for _ in targets]
    found = find_splitters(keyed, "__key", targets, tolerance * share, probes, group_tolerance * share)
    splitters = [Splitter(key) for key, _, _ in found]
    for key in {key for key, cut, _ in found if cut}:
        mine = [i for i, (k, cut, _) in enumerate(found) if cut and k == key]
        group = keyed.where(F.col("__key") == F.lit(key))
        inner = find_splitters(group, "__sub_key", [targets[i] - found[i][2] for i in mine], tolerance * share, probes, total)
        for i, (sub_key, _, _) in zip(mine, inner):
            splitters[i] = Splitter(key, sub_key)
    return splitters


def shard_of(splitters: list[Splitter]) -> Column:
    shard = F.lit(0)
    for s in splitters:
        above = (F.col("__key") > F.lit(s.key)) | ((F.col("__key") == F.lit(s.key)) & (F.col("__sub_key") >= F.lit(s.sub_key)))
        shard = shard + F.when(above, 1).otherwise(0)
    return shard.cast("int")


def in_order(docs: DataFrame, per_bucket: int = 20_000) -> DataFrame:
    """``docs`` and the columns __place (see :func:`placed`) and __bucket (stretches of ``per_bucket`` places)."""
    return placed(docs).withColumn("__bucket", F.floor(F.col("__place") / per_bucket).cast("long"))


def spread_of() -> Column:
    """An even hash of a row, by which the slots of a shard are numbered in parts."""
    return F.col("__key") + F.col("__sub_key")


def shard_documents(docs: DataFrame, n_shards: int = 8, tolerance: float = 0.0, keep_order: bool = False) -> DataFrame:
    """``docs`` and the columns shard (0 to n_shards - 1) and slot (gapless from 0 in each shard).

    The law is `bytes`: the shards' sums of UTF-8 bytes plus 1 a row are as near
    to equal as whole rows (and small groups of equal texts) allow. A null text
    counts as no bytes, and as equal to an empty one; rows that repeat both a
    doc_id and a text are placed one by one but only divided where all of them
    end. An empty table gives an empty result, and there may be fewer rows than
    shards. Columns named shard or slot in ``docs`` are replaced; others stay. With
    ``keep_order`` the slots of a shard follow the order of ``docs`` (see
    :func:`in_order`), else that of the keys.
    """
    keep = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    if keep_order:
        keyed = with_keys(in_order(docs).select(*keep, "__place", "__bucket"))
        order, spread = ["__place"], F.col("__bucket")
    else:
        keyed = with_keys(docs.select(*keep))
        order, spread = ["__key", "__sub_key"], spread_of()
    narrow = materialize(keyed.select("__key", "__sub_key", "__size"), "shard-keys")
    dealt = keyed.withColumn("shard", shard_of(plan_shards(narrow, n_shards, tolerance)))
    # There are at least as many of positions()' sub-buckets as stretches of places, so that those stay in order.
    return positions(dealt, ["shard"], spread, order, out="slot").select(*keep, "shard", "slot")
