"""SimHash fingerprints of texts, and all links within a radius by covering locality-sensitive hashing.

Every bit of the fingerprint has a vector of radius + 1 bits. For each of the
2^(radius + 1) - 1 other than zero there is a table, keyed by those fingerprint
bits whose vector has an odd product with it. The vectors of at most ``radius``
differing bits do not span the space, so some table ignores them all: every pair
within the radius shares a key there, always.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import in_worker, materialize, scratch_scope
from tessera.llm.components import connected_components
from tessera.llm.kernels import SPACE, chunks

BITS, RADIUS = 64, 3
WIDTH, SEED = 3, 42
U64 = np.uint64
#: Buckets of at least HOT fingerprints, and at least 1 / MOST_HOT of all entries of the tables, are dealt out once more: so there are at most MOST_HOT of them.
HOT, MOST_HOT = 1024, 100_000
#: Fingerprints of which all pairs are compared; larger sets are divided by covering masks of the bits in which they differ.
PAIRS = 256
#: Bytes of a text that are shingled together, shingles whose bits are counted together, and keys that a task compares at once.
PART, COUNTED, KEYS = 1 << 20, 1 << 16, 1 << 18


def masks(bits: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """One mask a table over these bit numbers; the vectors of the bits run through all but zero in turn."""
    tables = (1 << radius + 1) - 1
    vector = np.arange(len(bits)) % tables + 1
    odd = np.array([[bin(v & t).count("1") & 1 for v in vector] for t in range(1, tables + 1)], U64).reshape(tables, len(bits))
    return (odd << bits.astype(U64)).sum(axis=1, dtype=U64) if len(bits) else np.zeros(tables, U64)


def bit_majority(hashes: Iterator[np.ndarray]) -> int:
    """The bits that are set in more than half of all hashes."""
    counts, n = np.zeros(BITS, np.int64), 0
    for part in hashes:
        for k in range(0, len(part), COUNTED):
            some = part[k : k + COUNTED]
            counts += np.unpackbits(some.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(part)
    return sum(1 << b for b in np.flatnonzero(2 * counts > n).tolist())


def shingle_hashes(text: bytes, width: int = WIDTH) -> Iterator[np.ndarray]:
    """XXH64 of every shingle of a text, repeats included, in parts: words are lower-cased in A-Z and joined by one space; fewer words than ``width`` are one shingle."""
    digest, at, before = xxhash.xxh64_intdigest, 0, []
    while at < len(text):
        end = SPACE.search(text, at + PART) if at + PART < len(text) else None
        stop = end.end() if end else len(text)
        words = before + text[at:stop].lower().split()  # bytes.lower changes A-Z only, bytes.split divides at 0x09 to 0x0D and 0x20
        at = stop
        if len(words) >= width:
            joined = memoryview(b" ".join(words))
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate([[0], ends[: len(words) - width] + 1])
            yield np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist())), U64, len(starts))
            before = words[len(words) - width + 1 :] if width > 1 else []
        else:
            if at >= len(text) and words:
                yield np.array([digest(b" ".join(words), SEED)], U64)
            before = words


def fingerprint_of(text: bytes) -> int:
    """The fingerprint of a text; zero without words."""
    return bit_majority(shingle_hashes(text))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the 64 bits as a long) of every row of ``docs`` (doc_id, text); null counts as empty."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint_of(t) for _, texts in chunks(batch.column(1)) for t in texts), U64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(in_worker(scan), "doc_id long, fp long")


def stars(prints: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links of distinct fingerprints to the first of their group, for groups that pairs within the radius connect; of large sets, links of parts that together connect the same."""
    differing = int(np.bitwise_or.reduce(prints ^ prints[0]))
    bits = np.array([b for b in range(BITS) if differing >> b & 1])
    if len(prints) > PAIRS and len(bits) > 1 << radius:  # so that every mask divides the set; fewer bits have 256 values at most
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        for mask in masks(bits, radius):
            key = prints & mask
            order = np.argsort(key, kind="stable")
            cuts = np.flatnonzero(np.diff(key[order])) + 1
            for part in np.split(prints[order], cuts):
                if len(part) > 1:
                    ends.append(stars(part, radius))
        return np.concatenate([u for u, _ in ends] or [prints[:0]]), np.concatenate([v for _, v in ends] or [prints[:0]])
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= radius
    root = np.full(len(prints), -1)
    for first in range(len(prints)):
        if root[first] < 0:
            reached = near[first].copy()
            while True:
                more = near[reached].any(axis=0)
                if (more == reached).all():
                    break
                reached = more
            root[reached] = first
    inner = root != np.arange(len(prints))
    return prints[inner], prints[root[inner]]


def _bucket_links(radius: int):
    """A function for mapInArrow over (key, fp) sorted by both: the links of each bucket. Buckets are whole within a partition."""

    def links_of(keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(first, len(keys)))
        two = first[sizes == 2]
        two = two[np.bitwise_count(prints[two] ^ prints[two + 1]) <= radius]
        us, vs = [prints[two + 1]], [prints[two]]
        for a, n in zip(first[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            u, v = stars(prints[a : a + n], radius)
            us.append(u)
            vs.append(v)
        return np.concatenate(us), np.concatenate(vs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, prints = np.zeros(0, np.int64), np.zeros(0, U64)

        def out(k: np.ndarray, p: np.ndarray) -> Iterator[pa.RecordBatch]:
            u, v = links_of(k, p)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        held_k, held_p, size = [keys], [prints], 0
        for batch in batches:
            held_k.append(batch.column(0).to_numpy())
            held_p.append(batch.column(1).to_numpy().view(U64))
            size += batch.num_rows
            if size < KEYS:
                continue
            keys, prints = np.concatenate(held_k), np.concatenate(held_p)
            last = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on
            yield from out(keys[:last], prints[:last])
            held_k, held_p, size = [keys[last:]], [prints[last:]], 0
        keys, prints = np.concatenate(held_k), np.concatenate(held_p)
        if len(keys):
            yield from out(keys, prints)

    return run


def _keyed(prints: DataFrame, of_bucket: bool = False) -> DataFrame:
    """(key, fp) for every table: the key is a hash of the table's number and the fingerprint's masked bits; with ``of_bucket``, of the key it had and of other masks."""
    vectors = np.arange(BITS) if not of_bucket else np.arange(BITS) * 23 % BITS  # other bits share a vector
    each = [F.xxhash64(*([F.col("key")] if of_bucket else []), F.lit(t), F.col("fp").bitwiseAND(F.lit(int(m.view(np.int64))))) for t, m in enumerate(masks(vectors))]
    return prints.select(F.explode(F.array(*each)).alias("key"), "fp")


def near_links(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """Links (u, v) that connect all distinct fingerprints ``prints`` (fp) that differ in at most RADIUS bits, and no others.

    Buckets that hold ``hot`` or more are dealt out by further covering masks before any is
    brought to a task; what shares both keys has 46 bits in common or more, so
    a bucket then has at most 262,144 members.
    """
    spark = prints.sparkSession
    keyed = _keyed(prints)
    counts = keyed.groupBy("key").count()
    least = max(hot, 15 * prints.count() // MOST_HOT + 1)
    large = F.broadcast(materialize(counts.where(F.col("count") >= least).select("key"), "hot-keys"))  # at most MOST_HOT rows
    again = _keyed(keyed.join(large, "key"), of_bucket=True)
    dealt = keyed.join(large, "key", "left_anti").union(again)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_keys = dealt.repartition(parts, "key").sortWithinPartitions("key", "fp")
    return sorted_keys.mapInArrow(in_worker(_bucket_links(RADIUS)), "u long, v long").distinct()


def simhash_components(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, fp (long), component_id.

    A text's shingles are its runs of three words, A-Z lower-cased and joined by one
    space, repeats included; of fewer words it is the whole. A bit of fp is set if
    it is in more than half of their XXH64 hashes (seed 42). Rows link when their
    fp differ in at most three bits; component_id is the least doc_id that links
    reach, the row's own included (null only where all of them are null).

    Null, empty and blank texts have fp 0 and link as any other. Rows that share a
    doc_id are linked by their texts only. An empty table gives an empty result;
    other columns are not read.
    """
    spark = docs.sparkSession
    rows = materialize(fingerprints(docs), "fingerprints")
    with scratch_scope(spark) as scope:
        classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("size")), "fingerprint-classes")
        reached = connected_components(near_links(classes.select("fp"))).select(F.col("node").alias("fp"), "component")
        named = classes.join(reached, "fp", "left").select("fp", "least", "size", F.coalesce("component", "fp").alias("component"))
        best = named.groupBy("component").agg(F.min("least").alias("component_id"))
        settled = scope.keep(materialize(named.join(best, "component").select("fp", "size", "component_id"), "fingerprint-components"))
    # At most 1,000 classes hold a thousandth of all rows each: these meet the rows by broadcast, the others by a shuffle.
    common = F.col("size") * 1000 >= max(1, rows.count())
    large = F.broadcast(settled.where(common).select("fp", "component_id"))
    rest = rows.join(large, "fp", "left_anti").join(settled.where(~common).select("fp", "component_id"), "fp")
    return rows.join(large, "fp").unionByName(rest).select("doc_id", "fp", "component_id")
