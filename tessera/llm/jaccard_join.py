"""N-gram Jaccard join by set-relation skipping, up to connected components.

Sets hold 64-bit hashes of shingles:

1. Sets that are equal are one class; only classes are compared.
2. Index lists, skipped by position. The hash range of a set is cut into blocks
   at fixed positions, one more than two linked sets of that size may have
   differing shingles (and more for blocks that may be empty), so linked sets
   have the same block at the same position at least once: lists are exact. A
   list holds the sets with one block at one position. Lists with one class are
   skipped whole: a bitmap of bounded size tells which lists are left, and only
   sets on those lists are carried any further. Small sets are listed under
   single shingles, the least ones of the set (prefix filter).
3. Answers from a similar set. The least class on a list is its pivot, and the
   sets of all lists with one pivot meet in groups around it. The pivot's answers
   (its overlap with every set of the group) are computed first. The answers of
   another set X follow from them: a set Y that the pivot overlaps by o overlaps X
   by o, less what X lacks of the pivot, plus the differences from the pivot that
   X and Y have in common. Bounds of these decide most answers without a look;
   the rest are counted along the index lists of X's differences alone, which are
   ordered by the size of their sets, so that their blocks of too small sets are
   skipped by position.
4. Most lists meet by a shared passage only. So before sets move, the members of a
   group are held against each other by short histograms of their shingles: these
   differ by no more than the sets do, and a set that differs from all others of
   its group by more than a link may is skipped. Groups too large for one task are
   held against each other in pieces, by classes of sizes that may link.
5. A large group is dealt into parts, each with the pivot. Only the sets that are
   not connected to the pivot in their part meet the other parts, so a group of
   near copies costs work in proportion to its size, however large it is.
6. The links that were found are joined to components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bitmaps import KeyBitmaps
from tessera.llm.common import in_worker, materialize, placed, scratch_scope
from tessera.llm.components import connected_components
from tessera.llm.kernels import U64, chunks, mix, mix_one, shingle_sets

#: Sets, and shingles of sets, in one part of a group.
GROUP, GROUP_SHINGLES = 2_048, 4 << 20
#: Buckets of a set's histogram, for sets under and from MANY shingles, and rows of members whose histograms are compared at once.
FEW_BUCKETS, BUCKETS, MANY, COMPARED = 128, 2_048, 512, 4_096


@cache
def level_starts(num: int, den: int) -> list[int]:
    """Sizes s_0 < s_1 < ...: sets that may link have sizes in the same class [s_c, s_c+1) or in neighbouring ones."""
    out = [1]
    while out[-1] < 1 << 31:
        out.append(max(out[-1] + 1, -(-out[-1] * den // num)))
    return out


@cache
def level_plan(level: int, num: int, den: int) -> tuple[int, int]:
    """(blocks, empty blocks allowed for) of the sets in classes level and level + 1.

    No blocks: single shingles. (0, -1): only equal sets link. At a level, a set
    of its class is to meet what it links with in the class and the next one, so
    the smaller set has fewer than s_(level+1) shingles, and the two differ in
    that many times (den - num) / num at most. There is one block more than that,
    and more for blocks that are empty by chance, so an untouched block with
    shingles is left; a set with more empty blocks gets an extra list.
    """
    starts = level_starts(num, den)
    small, differ = starts[level], (starts[level + 1] - 1) * (den - num) // num
    if not differ:
        return 0, -1
    for empty in range(differ // 4 + 1):
        blocks = differ + 1 + empty
        mean = blocks * (1 - 1 / blocks) ** small
        if empty >= mean + 4 * mean**0.5:
            return blocks, empty
    return 0, 0


def list_keys(shingles: np.ndarray, num: int, den: int) -> np.ndarray:
    """The index lists of a set, as hashes."""
    n = len(shingles)
    out = []
    c = int(np.searchsorted(level_starts(num, den), n, "right")) - 1
    for level in (c - 1, c):
        if level < 0:
            continue
        blocks, empty = level_plan(level, num, den)
        if empty < 0:
            continue
        salt = U64(mix_one(level * 1_000_003 + 7))
        if not blocks:
            take = n - -(-num * n // den) + 1
            out.append(mix(np.sort(mix(shingles ^ U64(0xA5A5A5A5)))[:take] + salt))
            continue
        block = (mix(shingles + salt) >> U64(32)) * U64(blocks) >> U64(32)
        order = np.argsort(block, kind="stable")
        block, sums = block[order], np.cumsum(mix(shingles[order]))
        last = np.flatnonzero(np.diff(block, append=U64(blocks)))
        content = np.diff(sums[last], prepend=U64(0))
        out.append(mix(content + mix(block[last] + salt)))
        if blocks - len(last) > empty:  # more empty blocks than allowed for: a list of such sets
            out.append(mix(np.array([salt], U64)))
    return np.concatenate(out) if out else np.zeros(0, U64)


def class_of(shingles: np.ndarray) -> int:
    """An identity of the set, as a signed long."""
    h = mix(np.sum(mix(shingles ^ U64(0x5DEECE66D)), dtype=U64, keepdims=True) + mix(np.array([len(shingles)], U64)))
    return int(h.view(np.int64)[0])


def _index(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Rows (list, class): each class of a task once."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, texts in chunks(batch.column(0)):
                keys, owners = [], []
                for s in shingle_sets(texts, width):
                    if len(s) and (c := class_of(s)) not in seen:
                        seen.add(c)
                        k = list_keys(s, num, den)
                        keys.append(k)
                        owners.append(np.full(len(k), c))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owners).astype(np.int64))], names=["list", "class"])

    return docs.select("text").mapInArrow(in_worker(index), "list long, class long")


def _carry(docs: DataFrame, width: int, num: int, den: int, bitmaps, key: str) -> DataFrame:
    """Rows (doc_id, key, class, n, carrier, lists, sketch, shingles): each document; the last four only where the set, the first of its class in the task, is on a list that is left. ``carrier`` tells rows apart."""

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        left_over, carrier = bitmaps.value, TaskContext.get().partitionId() << 40
        seen: set[int] = set()
        for batch in batches:
            for start, texts in chunks(batch.column(1)):
                classes, sizes, carriers, lists, sketches, sets = [], [], [], [], [], []
                for s in shingle_sets(texts, width):
                    c = class_of(s) if len(s) else None
                    left = bytes_of = by = sketch = None
                    if c is not None and c not in seen:
                        seen.add(c)
                        k = list_keys(s, num, den).view(np.int64)
                        k = k[left_over.passes(k)]
                        if len(k):
                            left, bytes_of, by, sketch = k.tolist(), s.tobytes(), carrier, histogram(s)
                            carrier += 1
                    classes.append(c)
                    sizes.append(len(s))
                    carriers.append(by)
                    lists.append(left)
                    sketches.append(sketch)
                    sets.append(bytes_of)
                ids = batch.column(0).cast(pa.int64()).slice(start, len(texts))
                keys = batch.column(2).cast(pa.int64()).slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([ids, keys, pa.array(classes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(carriers, pa.int64()), pa.array(lists, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), pa.array(sets, pa.binary())], names=["doc_id", "key", "class", "n", "carrier", "lists", "sketch", "shingles"])

    return docs.select("doc_id", "text", F.col(key).cast("long").alias("key")).mapInArrow(in_worker(carry), "doc_id long, key long, class long, n long, carrier long, lists array<long>, sketch binary, shingles binary")


def histogram(shingles: np.ndarray) -> bytes:
    """How many shingles have the same last bits."""
    buckets = FEW_BUCKETS if len(shingles) < MANY else BUCKETS
    return np.minimum(np.bincount((shingles & U64(buckets - 1)).astype(np.int64), minlength=buckets), 0xFFFF).astype("<u2").tobytes()


def with_partner(sizes: np.ndarray, sketches: list[bytes], num: int, den: int, below: int | None = None) -> np.ndarray:
    """Which sets of a group may link with another, as far as sizes and histograms tell; with ``below``, in pairs whose smaller set has fewer shingles than that."""
    order = np.argsort(sizes, kind="stable")
    sizes, fine = sizes[order], [np.frombuffer(sketches[i], "<u2").astype(np.int32) for i in order]
    coarse = np.array([v.reshape(-1, FEW_BUCKETS).sum(axis=0) for v in fine])
    keep = np.zeros(len(sizes), bool)
    stop = len(sizes) if below is None else int(np.searchsorted(sizes, below))
    for i in range(1, len(sizes)):
        low, high = int(np.searchsorted(sizes, -(-num * sizes[i] // den))), min(i, stop)
        if low >= high or (keep[i] and keep[low:high].all()):
            continue
        total = sizes[low:high] + sizes[i]
        most = total - 2 * -(-num * total // (den + num))
        near = low + np.flatnonzero(np.abs(coarse[low:high] - coarse[i]).sum(axis=1) <= most)
        if len(fine[i]) == BUCKETS:
            near = np.array([j for j in near if len(fine[j]) < BUCKETS or np.abs(fine[j] - fine[i]).sum() <= most[j - low]], np.int64)
        keep[near] = True
        keep[i] |= len(near) > 0
    out = np.empty_like(keep)
    out[order] = keep
    return out


def link_group(sets: list[np.ndarray], pivot: int, left: np.ndarray, right: np.ndarray, known: np.ndarray, num: int, den: int, look_all: bool = False) -> np.ndarray:
    """Labels of the components of the links between two blocks of sets (masks; the same for one block). ``known`` are labels from the outset.

    See the module's text: the answers of ``pivot`` come first, all others are
    derived from them. ``look_all`` counts every answer along the lists instead
    of deciding by bounds where these suffice.
    """
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    p, sets = sets[pivot], [sets[i] for i in order]
    sizes, left, right, known = sizes[order], left[order], right[order], known[order]
    g = len(sets)
    lacks, extras = [], []
    for s in sets:
        at = np.searchsorted(p, s)
        at[at == len(p)] = 0
        here, lacked = p[at] == s, np.ones(len(p), bool)
        lacked[at[here]] = False
        lacks.append(np.flatnonzero(lacked))
        extras.append(s[~here])
    n_lack, n_extra = (np.array([len(x) for x in part]) for part in (lacks, extras))
    answers = len(p) - n_lack  # of the pivot: its overlap with each set
    differ = n_lack + n_extra

    # index lists of the differences that two or more sets share, each in the order of the sets' sizes
    _, number = np.unique(np.concatenate(extras), return_inverse=True)
    items = np.concatenate([*lacks, number + len(p)]).astype(np.int64)
    owners = np.concatenate([np.repeat(np.arange(g), n_lack), np.repeat(np.arange(g), n_extra)])
    shared = np.bincount(items, minlength=1)[items] > 1
    items, owners = items[shared], owners[shared]
    own = np.argsort(owners, kind="stable")
    own_items, own_ends = items[own], np.searchsorted(owners[own], np.arange(g + 1))
    places = np.sort(items * g + owners)  # (item, set) as one number: a list is a stretch of these

    _, label = np.unique(known, return_inverse=True)
    for i in range(1, g):
        # a set is compared with those before it, which are no larger: sizes bound the stretch
        low = int(np.searchsorted(sizes, -(-num * sizes[i] // den)))
        before = np.arange(low, i)
        before = before[((left[low:i] & right[i]) | (right[low:i] & left[i])) & (label[low:i] != label[i])]
        if not len(before):
            continue
        least = answers[before] - n_lack[i]
        need = -(-num * (sizes[before] + sizes[i]) // (den + num))
        linked = least >= need
        unsure = ~linked & (least + np.minimum(differ[before], differ[i]) >= need)
        if look_all:
            linked, unsure = np.zeros_like(linked), np.ones_like(unsure)
        if unsure.any():
            lists = own_items[own_ends[i] : own_ends[i + 1]] * g
            first, stop = np.searchsorted(places, lists + low), np.searchsorted(places, lists + i)
            count = stop - first
            at = np.arange(count.sum()) + np.repeat(first - (np.cumsum(count) - count), count)
            common = np.bincount(places[at] % g, minlength=g)[before]
            linked |= unsure & (least + common >= need)
        if linked.any():
            joined = np.unique(np.append(label[before[linked]], label[i]))
            label[np.isin(label, joined)] = joined[0]
    first_of = np.full(label.max() + 1, -1)
    first_of[label[::-1]] = np.arange(g)[::-1]
    out = np.empty(g, np.int64)
    out[order] = order[first_of[label]]
    return out


def _in_parts(members: DataFrame) -> DataFrame:
    """(pivot, parts, most) of each group of two sets or more. Parts are of even size by count, and by shingles as far as hashing deals these evenly."""
    parts = F.ceil(F.greatest(F.col("count") / GROUP, F.col("total") / GROUP_SHINGLES)).cast("int")
    sizes = members.groupBy("pivot").agg(F.count(F.lit(1)).alias("count"), F.sum("n").alias("total")).where("count > 1")
    return sizes.select("pivot", parts.alias("parts"), F.ceil(F.col("count") / parts).cast("int").alias("most"))


def _close_in_large(large: DataFrame, sets: DataFrame, num: int, den: int, n_tasks: int) -> DataFrame:
    """Of ``large`` (class, by, pivot, n), members of groups of any size, those that may link in their group, and the pivots of these.

    A set meets those of its own class of sizes and of the next, where the two differ
    in what may link; each such meeting is dealt into pieces, of which any two are
    held against each other in a task.
    """
    starts = level_starts(num, den)
    level = F.size(F.filter(F.array(*[F.lit(s) for s in starts]), lambda s: s <= F.col("n"))) - 1
    cells = large.select("class", "by", "pivot", "n", F.explode(F.array(level - 1, level)).alias("cell"))
    pieces = cells.groupBy("pivot", "cell").agg(F.ceil(F.count(F.lit(1)) / COMPARED).cast("int").alias("pieces"), F.min("n").alias("least"))
    pieces = pieces.where(F.col("least") < F.element_at(F.array(*[F.lit(s) for s in starts]), F.col("cell") + 2)).drop("least")  # some set is of the lower class
    dealt = cells.where("cell >= 0").join(pieces.where("cell >= 0"), ["pivot", "cell"]).withColumn("piece", F.pmod(F.xxhash64("class", F.lit("piece")), F.col("pieces")).cast("int"))
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), lambda other: F.struct(F.least("piece", other).alias("a"), F.greatest("piece", other).alias("b")))).alias("pair")
    met = dealt.select("class", "by", "pivot", "n", "cell", pairs).select("class", "by", "pivot", "n", "cell", "pair.a", "pair.b")
    met = met.join(sets.select("carrier", "sketch"), F.col("by") == F.col("carrier")).drop("carrier", "by")

    def plausible(pdf):
        keep = with_partner(pdf["n"].to_numpy(), pdf["sketch"].tolist(), num, den, starts[int(pdf["cell"].iloc[0]) + 1])
        return pdf.loc[keep, ["class", "pivot"]]

    keys = ["pivot", "cell", "a", "b"]
    found = materialize(met.repartition(n_tasks, *keys).groupBy(*keys).applyInPandas(plausible, "class long, pivot long").distinct(), "plausible")
    return large.join(found.unionByName(found.select(F.col("pivot").alias("class"), "pivot")).distinct(), ["class", "pivot"], "left_semi")


def _links(carried: DataFrame, multi: DataFrame, num: int, den: int) -> DataFrame:
    """Links (u, v) between classes, enough to connect all that are connected."""
    spark = carried.sparkSession
    n_tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sets = carried.where("carrier is not null")
    on_lists = sets.select("class", "n", F.explode("lists").alias("list"))
    met = materialize(on_lists.join(multi, "list").select("class", "n", "pivot").distinct(), "pivots")
    sizes = materialize(_in_parts(met), "pivot-sizes")
    first = sets.groupBy(F.col("class").alias("__class")).agg(F.min("carrier").alias("by"))  # tasks may carry the same class
    members = met.join(sizes, "pivot").join(first, F.col("class") == F.col("__class"))
    own = F.pmod(F.xxhash64("class"), F.col("parts")).cast("int").alias("own")
    members = materialize(members.select("class", "by", "pivot", "parts", "most", "n", own), "members")

    def plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of members in the order of their pivots, those that may link in their group, and the pivots of these."""
        names = ["class", "by", "pivot", "parts", "most", "n", "own"]

        def settle(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            pivot, c, n, sketches = rows["pivot"].to_numpy(), rows["class"].to_numpy(), rows["n"].to_numpy(), rows["sketch"].to_pylist()
            bounds = [0, *(np.flatnonzero(np.diff(pivot)) + 1).tolist(), len(pivot)]
            keep = np.zeros(len(pivot), bool)
            for a, b in zip(bounds, bounds[1:]):
                own = with_partner(n[a:b], sketches[a:b], num, den)
                keep[a:b] = own | ((c[a:b] == pivot[a:b]) & own.any())
            return rows.filter(pa.array(keep)).select(names)

        held, size, last = [], 0, None
        for batch in batches:
            pivot = batch["pivot"].to_numpy()
            at = 0
            for edge in [*(np.flatnonzero(np.diff(pivot, prepend=pivot[:1] if last is None else [last]))).tolist(), len(pivot)]:
                if edge > at:
                    held.append(batch.slice(at, edge - at))
                    size += edge - at
                    at = edge
                if edge < len(pivot) and size >= COMPARED:
                    yield settle(held)
                    held, size = [], 0
            last = pivot[-1] if len(pivot) else last
        if held:
            yield settle(held)

    sketched = members.where("parts = 1").join(sets.select("carrier", "sketch"), F.col("by") == F.col("carrier")).drop("carrier")
    fields = "class long, by long, pivot long, parts int, most int, n long, own int"
    close = sketched.repartition(n_tasks, "pivot").sortWithinPartitions("pivot").mapInArrow(in_worker(plausible), fields)
    if not sizes.where("parts > 1").isEmpty():
        large = materialize(_close_in_large(members.where("parts > 1").select("class", "by", "pivot", "n"), sets, num, den, n_tasks), "close-in-large")
        large = large.join(_in_parts(large), "pivot")
        close = close.unionByName(large.select("class", "by", "pivot", "parts", "most", "n", own))
    members = materialize(close, "close-members")

    # Only sets that some group needs are moved: all others but a few stop at a bitmap where they are read.
    used = members.select("by").distinct()
    needed = spark.sparkContext.broadcast(KeyBitmaps(used.withColumn("key", F.xxhash64("by")), "key", used.count()))

    def only_needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = needed.value
        for batch in batches:
            yield batch.select(["carrier", "shingles"]).filter(pa.array(known.passes(batch.column(2).to_numpy(zero_copy_only=False))))

    few = sets.select("carrier", "shingles", F.xxhash64("carrier").alias("key")).mapInArrow(in_worker(only_needed), "carrier long, shingles binary")

    def in_part(pdf):
        """(pivot, own, most, class, root): each set of a part and the one that stands for its component, the pivot where it can be."""
        import pandas as pd

        c, pivot = pdf["class"].to_numpy(), pdf["pivot"].iloc[0]
        everything = np.ones(len(pdf), bool)
        at = int(np.flatnonzero(c == pivot)[0])
        label = link_group([np.frombuffer(s, U64) for s in pdf["shingles"]], at, everything, everything, np.arange(len(pdf)), num, den)
        label[label == label[at]] = at
        return pd.DataFrame({"pivot": pivot, "parts": pdf["parts"], "most": pdf["most"], "own": pdf["own"], "class": c, "root": c[label]})

    is_pivot = F.col("class") == F.col("pivot")
    own = F.explode(F.when(is_pivot, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("own")))
    rows = members.select("class", "by", "pivot", "parts", "most", own.alias("own")).join(few, F.col("by") == F.col("carrier")).drop("carrier")
    found = rows.repartition(n_tasks, "pivot", "own").groupBy("pivot", "own").applyInPandas(in_part, "pivot long, parts int, most int, own int, class long, root long")
    found = materialize(found, "in-parts")
    links = found.where("class <> root").select(F.col("class").alias("u"), F.col("root").alias("v"))

    apart = found.where("parts > 1")
    loose = materialize(apart.where("root <> pivot").groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / F.first("most")).cast("int").alias("blocks")), "loose")
    if loose.isEmpty():
        needed.unpersist()
        return links

    def across(pdf):
        """Links between the loose sets of a block and the sets of a part."""
        import pandas as pd

        c, is_loose = pdf["class"].to_numpy(), pdf["loose"].to_numpy()
        _, known = np.unique(pdf["root"].to_numpy(), return_inverse=True)
        sets = [np.frombuffer(s, U64) for s in pdf["shingles"]]
        label = link_group(sets, max(range(len(sets)), key=lambda i: len(sets[i])), is_loose, ~is_loose, known, num, den)
        return pd.DataFrame({"u": c, "v": c[label]})[c != c[label]]

    wide = apart.join(loose, "pivot").where((F.col("class") != F.col("pivot")) | (F.col("own") == 0))
    block = F.pmod(F.xxhash64("class", F.lit("block")), F.col("blocks")).cast("int")
    ours = wide.where("root <> pivot").select("pivot", "class", "root", F.lit(True).alias("loose"), block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("own"))
    theirs = wide.select("pivot", "class", "root", F.lit(False).alias("loose"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "own")
    both = ours.unionByName(theirs).join(first, F.col("class") == F.col("__class")).drop("__class").join(few, F.col("by") == F.col("carrier"))
    more = materialize(both.repartition(n_tasks, "pivot", "block", "own").groupBy("pivot", "block", "own").applyInPandas(across, "u long, v long"), "across-parts")
    needed.unpersist()
    return links.unionByName(more)


def jaccard_components(docs: DataFrame, width: int = 3, num: int = 90, den: int = 100, key: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, key (another column of ``docs``, a long), n_shingles, class, component, component_id.

    Words are runs of anything but spaces and the control characters from tab to
    carriage return, A-Z lower-cased. A set holds the distinct ``width``-word
    shingles of the whole text; with fewer words, the sequence as one; null, empty
    and wordless texts have an empty set (class and component null), are linked
    with nothing and keep their doc_id as component_id. Two documents link when
    den * |intersection| >= num * |union|; component_id is the least doc_id that
    links lead to. Repeated rows are equal sets. Null doc_ids count last and only
    name a component if it has no other. An empty table gives an empty result;
    other columns are not read.
    """
    spark = docs.sparkSession
    with scratch_scope(spark) as scope:
        multi = _index(docs, width, num, den).groupBy("list").agg(F.min("class").alias("pivot"), F.max("class").alias("high")).where("pivot <> high").select("list", "pivot")
        multi = materialize(multi, "lists")
        bitmaps = spark.sparkContext.broadcast(KeyBitmaps(multi, "list", multi.count()))
        carried = materialize(_carry(docs, width, num, den, bitmaps, key), "sets")
        bitmaps.unpersist()
        components = connected_components(_links(carried, multi, num, den))
        rows = scope.keep(materialize(carried.select("doc_id", "key", F.col("n").alias("n_shingles"), "class"), "rows"))
        classes = rows.where("class is not null").groupBy(F.col("class").alias("node")).agg(F.min("doc_id").alias("least"))
        named = materialize(classes.join(components, "node", "left").withColumn("component", F.coalesce("component", "node")), "classes")
        least = named.groupBy("component").agg(F.min("least").alias("component_id"))
        least = scope.keep(materialize(named.join(least, "component").select("node", "component", "component_id"), "class-components"))
    met = rows.join(least, F.col("class") == F.col("node"), "left")
    return met.select("doc_id", "key", "n_shingles", "class", "component", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def near_copies(rows: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The places (__lost) of rows of a :func:`placed` table to drop: of each group of linked rows one stays.

    That is the row with the least doc_id, of several the first in the table; null
    doc_ids come last. Rows without words are in no group, so all of them stay.
    """
    found = jaccard_components(rows, width, num, den, "__place").where("component is not null")
    place = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("key").alias("place"))
    first = found.groupBy("component").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("component").alias("__of"), F.col("first.place").alias("stays"))
    return found.join(first, F.col("component") == F.col("__of")).where("key <> stays").select(F.col("key").alias("__lost"))


def drop_near_copies(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` without the rows that :func:`near_copies` names; all columns stay, and repeated rows count as copies of each other. An empty table stays empty."""
    rows = placed(docs)
    with scratch_scope(docs.sparkSession) as scope:  # sets and lists go as soon as it is known what is lost
        lost = scope.keep(materialize(near_copies(rows, width, num, den), "near-copies"))
    return rows.join(lost, F.col("__place") == F.col("__lost"), "left_anti").select(*docs.columns)
