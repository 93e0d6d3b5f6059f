"""Language-model scores from a log-frequency Bloom filter.

Counts of words and word pairs of the training texts are gathered exactly. The
filter holds, for each of them, one key for every step of its quantised count:
probing a word with step 1, 2, ... until a probe fails gives its count's step.
The filter is built by the executors in segments, and its size follows the number
of keys. Up to ``MOST_SEGMENTS`` segments it goes to every executor as a file, which
its workers map; a larger one stays spread over the executors, and the keys of the texts go to the segments that answer for them.
Both ways give the same scores.

A word w after v has the probability (d(v, w) + T(v) p(w)) / (S(v) + T(v)). d(v, w) stands
for c(v, w) - 1 and depends on the quantised count of the pair only; S(v) is the sum of
d(v, w) over all w; T(v) is the number of different words after v, so what absolute
discounting takes from the pairs goes to the single words; p(w) = (q(w) + 1) / Z with the
quantised counts q(w), and Z makes p sum to 1 over all words and one unknown. So the
probabilities after v sum to 1 whatever the steps of pairs, words and T(v): only the
steps of S(v) matter, which are exact up to FINE and 1/FINE of an octave beyond.
Pairs seen once add nothing and are not held, nor is T(v) where S(v) is 0; there, and
after a word never seen, p(w) holds. A pair that the filter claims wrongly would add to
the sum after v, and the more so the more words there are: a pair's first step has as
many probes as keep the expected number of such words under a fourth.

The base score needs exact counts of single words: those of the most frequent
words, at most ``FREQUENT``, are broadcast; the others are joined.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import ceil, log2, log10

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import doc_crc, drop_materialized, in_worker, materialize
from tessera.llm.kernels import U64, chunks, mix, word_hashes

#: Probes of every step but a pair's first (see :func:`pair_probes`), and bits for each, at which half of the filter is set.
PROBES, BITS_A_PROBE = 8, 1.4427
SEGMENT_BITS = 1 << 23
#: Bounds of what every executor has: 128 MB of filter, and 8 MB of exact counts. Segments that the driver holds at once.
MOST_SEGMENTS, FREQUENT, SHIPPED_AT_ONCE = 128, 1 << 19, 8
#: Bytes of text whose distinct keys are asked for together where the filter is not broadcast, but for a longer single text.
ASKED_AT_ONCE = 8 << 20
TOKENS_AT_ONCE = 1 << 21
#: Bytes of text that are scored together, but for a longer single text: words that they share are looked up once.
SCORED_AT_ONCE = 2 << 20

#: Answers of the filter that a worker remembers, and keys that are probed in one segment together.
REMEMBERED, PROBED_AT_ONCE, STEPS_AT_ONCE = 1 << 21, 1 << 20, 1 << 14

#: Keys of words are 63 bits; those of pairs have the top bit and 63 more; T(v) and S(v) are under v's key with a mark in its low 20 bits, so in v's segment.
WORD_BITS, PAIR_BIT = U64((1 << 63) - 1), U64(1 << 63)
TYPE_MARK, SUM_MARK = 0x5A5A5, 0xC3C3C
#: The step of a word that occurs twice: words below it are in no repeated pair.
TWICE = 3
#: S(v) up to FINE is exact; beyond, an octave has FINE steps.
FINE = 32
#: More steps than any count has.
MOST_STEPS = 4096
END = mix(np.array([0xE0D], U64)) & WORD_BITS
START = mix(np.array([0x57A], U64)) & WORD_BITS


def pair_keys(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (mix(before * U64(3) + mix(words)) & WORD_BITS) | PAIR_BIT


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the texts' words with an end after each text, of what is before each token, and the text of each token."""
    words, bounds = word_hashes(texts)
    own = np.repeat(np.arange(len(texts)), np.diff(bounds) + 1)
    ends = np.cumsum(np.diff(bounds) + 1) - 1
    out = np.empty(len(own), U64)
    is_end = np.zeros(len(own), bool)
    is_end[ends] = True
    out[~is_end] = words & WORD_BITS
    out[is_end] = END
    before = np.empty_like(out)
    before[1:], before[:1] = out[:-1], START
    before[1:][is_end[:-1]] = START
    return out, before, own


def gather(train: DataFrame) -> DataFrame:
    """Rows (key, context, n): exact counts of words (key from 0, no context) and of pairs (key below 0, context the first word's key) that occur twice or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(words: list[np.ndarray], befores: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            word, before = np.concatenate(words), np.concatenate(befores)
            pair, first, n = np.unique(pair_keys(before, word), return_index=True, return_counts=True)
            yield of(pair, pa.array(before[first].view(np.int64)), n)
            word, n = np.unique(word, return_counts=True)
            yield of(word, pa.nulls(len(word), pa.int64()), n)

        def of(key: np.ndarray, context: pa.Array, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), context, pa.array(n.astype(np.int64))], names=["key", "context", "n"])

        words: list[np.ndarray] = []
        befores: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for _, texts in chunks(batch.column(0)):
                word, before, _ = tokens(texts)
                words.append(word)
                befores.append(before)
                size += 2 * len(word)
                if size > TOKENS_AT_ONCE:
                    yield from out(words, befores)
                    words, befores, size = [], [], 0
        if words:
            yield from out(words, befores)

    counted = train.select("text").mapInArrow(in_worker(count), "key long, context long, n long").groupBy("key").agg(F.min("context").alias("context"), F.sum("n").alias("n"))
    return materialize(counted.where("key >= 0 or n > 1"), "counts")


def word_steps(n: Column) -> Column:
    """Words and T(v): 1 + floor(2 log2 n)."""
    return (F.floor(2 * F.log2(n.cast("double")) + 1e-12) + 1).cast("int")


def pair_steps(n: Column) -> Column:
    """Pairs: floor(log2 n)."""
    return F.floor(F.log2(n.cast("double")) + 1e-12).cast("int")


def sum_steps(s: Column) -> Column:
    """S(v): each value up to FINE, then FINE steps an octave."""
    return F.when(s <= FINE, s).otherwise(F.floor(FINE * F.log2(s / FINE) + 1e-9) + FINE).cast("int")


def filter_keys(counts: DataFrame) -> DataFrame:
    """Rows (key, step) of all that the filter holds: words, pairs, and T(v) and S(v) of all v with repeated pairs."""
    is_pair = F.col("key") < 0
    own = counts.select("key", F.when(is_pair, pair_steps(F.col("n"))).otherwise(word_steps(F.col("n"))).alias("step"))
    as_context = F.when(F.col("key") == int(END[0]), F.lit(int(START[0]))).otherwise(F.col("key"))  # as many starts as ends
    low = F.pow(F.lit(2.0), pair_steps(F.col("n")))
    less = F.floor(F.sqrt(low * (2 * low - 1)) + 0.5) - 1
    rows = counts.select(F.when(is_pair, F.col("context")).otherwise(as_context).alias("context"), F.when(is_pair, less).otherwise(0).alias("s"), F.when(is_pair, 1 - F.col("n")).otherwise(F.col("n")).alias("t"))
    after = rows.groupBy("context").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).where("s > 0 and t > 0")
    both = F.array(
        F.struct(F.col("context").bitwiseXOR(F.lit(SUM_MARK)).alias("key"), sum_steps(F.col("s")).alias("step")),
        F.struct(F.col("context").bitwiseXOR(F.lit(TYPE_MARK)).alias("key"), word_steps(F.col("t")).alias("step")),
    )
    return own.unionByName(after.select(F.inline(both)))


def pair_probes(vocabulary: int) -> int:
    """Probes of a pair's first step: of ``vocabulary`` words, a fourth of one at most is expected to pass for a follower of v."""
    return max(PROBES, ceil(log2(max(1, vocabulary))) + 2)


class Filter:
    """A log-frequency Bloom filter in segments of SEGMENT_BITS."""

    def __init__(self, segments: list[np.ndarray], first: int):
        self.first = first
        self.held = np.concatenate(segments) if segments else np.zeros(SEGMENT_BITS // 8, np.uint8)
        self.n = max(1, len(segments))

    @classmethod
    def shipped(cls, name: str, n: int, first: int) -> Filter:
        """The filter of a file that came with the job, mapped: the workers of a machine share its pages."""
        out = cls.__new__(cls)
        out.held, out.n, out.first = np.asarray(np.memmap(SparkFiles.get(name), np.uint8, "r")), n, first
        return out

    def has(self, keys: np.ndarray, step: int | np.ndarray, base: np.ndarray | None = None) -> np.ndarray:
        """Whether all probes of each key for this step (or a step of its own, from 2 on) succeed. ``base`` is where the keys' segments begin."""
        out = np.zeros(len(keys), bool)
        base = self.starts(keys) if base is None else base
        left, alive = np.arange(len(keys)), np.ones(len(keys), bool)
        h, d = hashed(keys, step)
        pairs = keys >= PAIR_BIT
        for i in range(self.first if np.ndim(step) == 0 and step == 1 else PROBES):
            if i == PROBES:  # more probes for pairs only
                out[left[alive & ~pairs]] = True
                alive &= pairs
            at = place(h, d, i)
            alive &= ((self.held[base + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
            n = np.count_nonzero(alive)
            if not n:
                return out
            if 4 * n < 3 * len(alive):
                left, base, h, d, pairs = (a[alive] for a in (left, base, h, d, pairs))
                alive = np.ones(n, bool)
        out[left[alive]] = True
        return out

    def starts(self, keys: np.ndarray) -> np.ndarray:
        return segment_of(keys, self.n) * (SEGMENT_BITS // 8)

    def steps(self, keys: np.ndarray) -> np.ndarray:
        """The quantised count of each key: the steps for which probes succeed, from 1 on."""
        out = np.zeros(len(keys), np.int64)
        segment = segment_of(keys, self.n)
        left = np.argsort(segment.astype(np.uint16) if self.n <= 1 << 16 else segment, kind="stable")  # probes of neighbours lie near each other
        keys, base = keys[left], segment[left] * (SEGMENT_BITS // 8)
        step = 1
        while len(left) and step < MOST_STEPS:
            many = 1 if step == 1 else max(1, min(64, STEPS_AT_ONCE // len(left)))  # of few keys several steps at once
            asked = np.tile(np.arange(step, step + many), len(left)) if many > 1 else step
            hit = self.has(np.repeat(keys, many), asked, np.repeat(base, many)).reshape(-1, many)
            held = np.where(hit.all(axis=1), many, hit.argmin(axis=1))
            out[left] += held
            more = held == many
            left, keys, base = left[more], keys[more], base[more]
            step += many
        return out


class Remembered:
    """The answers of ``look``, of which one for each of ``size`` slots of words and as many of pairs is kept, the last of those with the most steps: these took the most probes, and frequent words and pairs are looked up once."""

    def __init__(self, look: Callable[[np.ndarray], np.ndarray], size: int | None = None):
        self.look, self.size = look, size or REMEMBERED
        self.keys, self.held = np.zeros(2 * self.size, U64), np.zeros(2 * self.size, np.uint16)  # step 0: an empty slot

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = ((keys ^ (keys >> U64(32))) % U64(self.size)).astype(np.int64) + np.where(keys >= PAIR_BIT, self.size, 0)
        out = np.where(self.keys[slot] == keys, self.held[slot], 0).astype(np.int64)
        missed = np.flatnonzero(out == 0)
        out[missed] = self.look(keys[missed])
        found = missed[out[missed] > 0]
        found = found[out[found] >= self.held[slot[found]]]
        at = slot[found]
        self.keys[at] = keys[found]
        kept = self.keys[at] == keys[found]  # of several keys for a slot the one that was written last
        self.held[at[kept]] = out[found[kept]]
        return out


@lru_cache(maxsize=1)
def shipped_steps(name: str, n: int, first: int) -> Remembered:
    """The steps of keys by the filter of a file; a worker keeps its answers from task to task, until it reads another filter."""
    return Remembered(Filter.shipped(name, n, first).steps)


def hashed(keys: np.ndarray, step: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = mix(keys + U64(0x9E37) * np.asarray(step, U64))
    return h, mix(h) | U64(1)


def place(h: np.ndarray, d: np.ndarray, probe: int) -> np.ndarray:
    """The bit of a segment that a probe looks at."""
    return ((h + U64(probe) * d) & U64(SEGMENT_BITS - 1)).astype(np.int64)


def word_count(step: np.ndarray) -> np.ndarray:
    """The middle of the counts with this step."""
    low = np.ceil(2 ** ((step - 1) / 2) - 1e-9)
    high = np.maximum(low, np.ceil(2 ** (step / 2) - 1e-9) - 1)
    return np.where(step > 0, np.sqrt(low * high), 0.0)


def pair_less(step: np.ndarray) -> np.ndarray:
    """d(v, w): the middle of the counts with this step, rounded, less 1."""
    low = 2.0**step
    return np.where(step > 0, np.floor(np.sqrt(low * (2 * low - 1)) + 0.5) - 1, 0.0)


def sum_value(step: np.ndarray) -> np.ndarray:
    """S(v) of this step."""
    return np.where(step <= FINE, step, FINE * 2.0 ** ((step - FINE + 0.5) / FINE))


def probabilities(look: Callable[[np.ndarray], np.ndarray], scale: float, words: np.ndarray, word: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The model's probability of each token: ``word`` is its place in the distinct keys ``words``, ``before`` that of what is before it, or len(words) for the start of a text. ``look`` gives the steps of keys."""
    contexts = np.append(words, START)
    step = look(words)
    p = ((word_count(step) + 1) / scale)[word]
    sums, types = np.zeros(len(contexts)), np.zeros(len(contexts))
    often = np.append(step >= TWICE, True)
    asked = np.flatnonzero(often)
    sums[asked] = sum_value(look(contexts[asked] ^ U64(SUM_MARK)))
    asked = np.flatnonzero(sums > 0)
    types[asked] = word_count(look(contexts[asked] ^ U64(TYPE_MARK)))
    some = np.flatnonzero((types > 0)[before])
    s, t = sums[before[some]], types[before[some]]
    less, asked = np.zeros(len(some)), np.flatnonzero(often[word[some]])
    less[asked] = pair_less(look(pair_keys(contexts[before[some[asked]]], words[word[some[asked]]])))
    p[some] = (less + t * p[some]) / (s + t)
    return p


def segment_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> U64(20)) % U64(n)).astype(np.int64)


def filter_segments(stepped: DataFrame, first: int) -> tuple[int, DataFrame]:
    """How many segments the filter of all rows of ``stepped`` (key, step) has, and rows (segment, bits) of those that hold keys. ``first`` is the probes of a pair's first step."""
    probes = F.col("step") * PROBES + F.when(F.col("key") < 0, first - PROBES).otherwise(0)
    total = stepped.agg(F.sum(probes)).first()[0] or 0
    n = max(1, ceil(total * BITS_A_PROBE / SEGMENT_BITS))

    def build(pdf):
        import pandas as pd

        bits = np.zeros(SEGMENT_BITS, bool)
        keys, step = pdf["key"].to_numpy().view(U64), pdf["step"].to_numpy()
        for s in range(1, int(step.max()) + 1):
            keys, step = keys[step >= s], step[step >= s]
            h, d = hashed(keys, s)
            for i in range(PROBES):
                bits[place(h, d, i)] = True
            if s == 1:
                h, d = h[keys >= PAIR_BIT], d[keys >= PAIR_BIT]
                for i in range(PROBES, first):
                    bits[place(h, d, i)] = True
        return pd.DataFrame({"segment": [int(pdf["segment"].iloc[0])], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    placed = stepped.withColumn("segment", F.shiftrightunsigned("key", 20) % n)
    return n, placed.groupBy("segment").applyInPandas(build, "segment long, bits binary")


def collect_filter(n: int, segments: DataFrame, first: int) -> Filter:
    rows = {r["segment"]: r["bits"] for r in segments.collect()}
    return Filter([np.frombuffer(rows[i], np.uint8) if i in rows else np.zeros(SEGMENT_BITS // 8, np.uint8) for i in range(n)], first)


def build_filter(stepped: DataFrame, first: int = PROBES) -> Filter:
    """The whole filter of ``stepped``, on the driver."""
    return collect_filter(*filter_segments(stepped, first), first)


def ship_filter(n: int, segments: DataFrame) -> str:
    """Send the filter to the executors as a file, by Spark's own file service, and return its name; the driver holds SHIPPED_AT_ONCE segments at once."""
    spark, name = segments.sparkSession, f"filter-{uuid.uuid4().hex}"
    held = materialize(segments, "segments")
    path, size = os.path.join(tempfile.mkdtemp(), name), SEGMENT_BITS // 8
    with open(path, "wb") as out:
        out.truncate(n * size)
        for at in range(0, n, SHIPPED_AT_ONCE):
            for r in held.where(F.col("segment").between(at, at + SHIPPED_AT_ONCE - 1)).toLocalIterator():
                out.seek(r["segment"] * size)
                out.write(r["bits"])
    drop_materialized(held)
    spark.sparkContext.addFile(path)
    return name


def ask_segments(pieces: DataFrame, n: int, segments: DataFrame, first: int) -> DataFrame:
    """Rows (group, keys, steps) of all keys of the texts of each group of ``pieces`` (group, text) for which step 1 succeeds; a group may have several."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(group: int, held: list[np.ndarray]) -> pa.RecordBatch:
            keys = np.unique(np.concatenate(held))
            segment = segment_of(keys, n)
            order = np.argsort(segment, kind="stable")
            named, starts = np.unique(segment[order], return_index=True)
            parts = [part.tobytes() for part in np.split(keys[order], starts[1:])]
            return pa.RecordBatch.from_arrays([pa.array(named), pa.array(np.full(len(named), group)), pa.array(parts, pa.binary())], names=["segment", "group", "keys"])

        held: list[np.ndarray] = []
        size, now = 0, None
        for batch in batches:
            groups = batch.column(0).to_numpy()
            bounds = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(groups)]
            for a, b in zip(bounds, bounds[1:]):
                if a == b:
                    continue
                if held and (now != groups[a] or size > TOKENS_AT_ONCE):
                    yield out(now, held)
                    held, size = [], 0
                now = int(groups[a])
                for _, texts in chunks(batch.column(1).slice(a, b - a)):
                    words, before, _ = tokens(texts)
                    held += [np.append(np.unique(words), START), np.unique(pair_keys(before, words))]  # a word asks for T and S too
                    size += len(words)
        if held:
            yield out(now, held)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return probe_segments(batches, first)

    asked = pieces.select("group", "text").mapInArrow(in_worker(ask), "segment long, group long, keys binary")
    own = segments.select("segment", F.lit(-1).cast("long").alias("group"), F.col("bits").alias("keys"))
    met = own.unionByName(asked).repartition("segment").sortWithinPartitions("segment", "group")
    return met.mapInArrow(in_worker(probe), "group long, keys binary, steps binary")


def probe_segments(batches: Iterator[pa.RecordBatch], first: int) -> Iterator[pa.RecordBatch]:
    """Answers to rows (segment, group, keys), where each segment (group -1, its bits) comes before all who ask it. The keys of many groups are probed together, each once."""
    at, model, size = None, None, 0
    groups: list[int] = []
    held: list[np.ndarray] = []

    def out() -> Iterator[pa.RecordBatch]:
        keys, back = np.unique(np.concatenate(held), return_inverse=True)
        step = model.steps(keys)[back]
        bounds = np.cumsum([len(k) for k in held])[:-1]
        for group, keys, s in zip(groups, held, np.split(step, bounds)):
            keys, s = keys[s > 0], s[s > 0].astype(np.uint16)
            if len(keys):
                yield pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([keys.tobytes()], pa.binary()), pa.array([s.tobytes()], pa.binary())], names=["group", "keys", "steps"])

    for batch in batches:
        for k in range(batch.num_rows):
            segment, group = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
            if held and (segment != at or size > PROBED_AT_ONCE):
                yield from out()
                groups, held, size = [], [], 0
            if group < 0:
                at, model = segment, Filter([np.frombuffer(batch.column(2)[k].as_py(), np.uint8)], first)
            elif segment == at:
                keys = np.frombuffer(batch.column(2)[k].as_py(), U64)
                words = keys[keys < PAIR_BIT]
                groups.append(group)
                held.append(np.concatenate([keys, words ^ U64(TYPE_MARK), words ^ U64(SUM_MARK)]))
                size += len(held[-1])
    if held:
        yield from out()


def words_by_step(counts: DataFrame) -> list:
    """How many different words have each step, and how often these occur: some dozens of rows."""
    return counts.where("key >= 0").groupBy(word_steps(F.col("n")).alias("step")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).collect()


def frequent_words(counts: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and counts of the most frequent words: all above a count such that there are at most ``most``."""
    words = counts.where("key >= 0")
    by_step = sorted(((r["step"], r["words"]) for r in words_by_step(counts)), reverse=True)
    least, total = None, 0
    for step, n in by_step:
        if total + n > most:
            break
        least, total = step, total + n
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows = words.where(word_steps(F.col("n")) >= least).toArrow()
    key, n = rows["key"].to_numpy(), rows["n"].to_numpy()
    order = np.argsort(key)
    return key[order], n[order]


def score_texts(docs: DataFrame, train: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text), scored by a model of the texts of ``train``.

    Returns doc_id, n_tokens, n_known, train_tokens, base_score and score, both the
    log10 probability of the text. Words are runs of anything but spaces and the
    control characters from tab to carriage return, A-Z lower-cased; one end is
    counted after every text. Null is an empty text, whose only token is the end.
    Repeated rows count and score one by one. Without training texts every token
    has probability 1. An empty table gives an empty result; other columns are not
    read.
    """
    sc = docs.sparkSession.sparkContext
    counts = gather(train)
    by_step = words_by_step(counts)
    n_train, vocabulary = sum(r["n"] for r in by_step), sum(r["words"] for r in by_step)
    scale = float(n_train + vocabulary + 1)
    model_scale = 1 + sum(r["words"] * (float(word_count(np.array(r["step"]))) + 1) for r in by_step)
    first = pair_probes(vocabulary)
    n_segments, segments = filter_segments(filter_keys(counts), first)
    frequent = sc.broadcast(frequent_words(counts))

    def of_texts(rows: np.ndarray, ids: pa.Array, texts: list[bytes], look: Callable[[np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
        """A row for each text, and rows of its words that are not frequent; ``look`` gives the steps of keys."""
        known, times = frequent.value
        names = ["row", "doc_id", "n_tokens", "n_known", "base", "score", "key", "n"]
        words, _, own = tokens(texts)
        g = len(texts)
        distinct, back = np.unique(words, return_inverse=True)
        at = np.minimum(np.searchsorted(known, distinct.view(np.int64)), max(0, len(known) - 1))
        found = known[at] == distinct.view(np.int64) if len(known) else np.zeros(len(distinct), bool)
        exact = np.where(found, times[at], 0) if len(known) else np.zeros(len(distinct))
        base = np.bincount(own, np.log10(exact + 1.0)[back], g)
        n_known = np.bincount(own, found[back], g)

        before = np.empty(len(words), np.int64)
        before[1:] = back[:-1]
        before[np.flatnonzero(np.diff(own, prepend=-1))] = len(distinct)
        logs = np.log10(probabilities(look, model_scale, distinct, back, before)) if n_train else np.zeros(len(words))
        total = np.bincount(own, logs, g)

        nothing = pa.nulls(g, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(rows), ids, pa.array(np.bincount(own, minlength=g)), pa.array(n_known.astype(np.int64)), pa.array(base), pa.array(total), nothing, nothing], names=names)
        rare = np.flatnonzero(~found[back])
        if len(rare):
            pair, n = np.unique(own[rare] * len(distinct) + back[rare], return_counts=True)
            k = len(pair)
            blank, none = pa.nulls(k, pa.int64()), pa.nulls(k, pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(rows[pair // len(distinct)]), blank, blank, blank, none, none, pa.array(distinct[pair % len(distinct)].view(np.int64)), pa.array(n.astype(np.int64))], names=names)

    out = "row long, doc_id long, n_tokens long, n_known long, base double, score double, key long, n long"
    texts_of = docs.select("doc_id", "text")
    if n_segments <= MOST_SEGMENTS:
        shipped = ship_filter(n_segments, segments)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            row = TaskContext.get().partitionId() << 40
            look = shipped_steps(shipped, n_segments, first)
            for batch in batches:
                ids = batch.column(0).cast(pa.int64())
                for at, texts in chunks(batch.column(1), SCORED_AT_ONCE):
                    yield from of_texts(row + at + np.arange(len(texts)), ids.slice(at, len(texts)), texts, look)
                row += len(ids)

        scored = materialize(texts_of.mapInArrow(in_worker(score), out), "scored")
    else:

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            part = TaskContext.get().partitionId()
            row, size = part << 40, 0
            for batch in batches:
                text = batch.column(1).cast(pa.binary())
                ends = size + np.cumsum([len(t.as_py() or b"") for t in text], dtype=np.int64)
                group = (part << 40) + (np.concatenate([[size], ends[:-1]]) // ASKED_AT_ONCE if len(ends) else ends)
                yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(row + np.arange(len(text))), batch.column(0).cast(pa.int64()), text], names=["group", "row", "doc_id", "text"])
                row, size = row + len(text), int(ends[-1]) if len(ends) else size

        def score_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held, keys, step = None, [], np.zeros(0, U64), np.zeros(0, np.int64)

            def look(asked: np.ndarray) -> np.ndarray:
                if not len(keys):
                    return np.zeros(len(asked), np.int64)
                at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                return np.where(keys[at] == asked, step[at], 0)

            for batch in batches:
                groups, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                edges = np.flatnonzero((np.diff(groups) != 0) | ((rows[1:] < 0) != (rows[:-1] < 0))) + 1
                bounds = [0, *edges.tolist(), len(groups)]
                for a, b in zip(bounds, bounds[1:]):
                    if a == b:
                        continue
                    if groups[a] != now:
                        now, held, keys, step = groups[a], [], np.zeros(0, U64), np.zeros(0, np.int64)
                    if rows[a] < 0:  # answers come before the texts of their group
                        held += [(np.frombuffer(batch.column(4)[k].as_py(), U64), np.frombuffer(batch.column(5)[k].as_py(), np.uint16)) for k in range(a, b)]
                        continue
                    if held:
                        keys, at = np.unique(np.concatenate([k for k, _ in held]), return_index=True)
                        step, held = np.concatenate([s for _, s in held])[at].astype(np.int64), []
                    ids = batch.column(2).slice(a, b - a)
                    for at, texts in chunks(batch.column(3).slice(a, b - a)):
                        yield from of_texts(rows[a + at : a + at + len(texts)], ids.slice(at, len(texts)), texts, look)

        pieces = materialize(texts_of.mapInArrow(in_worker(deal), "group long, row long, doc_id long, text binary"), "pieces")  # so that both passes see the same groups
        answers = ask_segments(pieces, n_segments, segments, first)
        met = pieces.unionByName(answers.withColumn("row", F.lit(-1).cast("long")), allowMissingColumns=True).select("group", "row", "doc_id", "text", "keys", "steps")
        scored = materialize(met.repartition("group").sortWithinPartitions("group", "row").mapInArrow(in_worker(score_groups), out), "scored")
        drop_materialized(pieces)
    rare = scored.where("key is not null").select("row", "key", F.col("n").alias("here"))
    rare = rare.join(counts.where("key >= 0"), "key").groupBy("row").agg(F.sum(F.col("here") * F.log10(F.col("n") + 1.0)).alias("rare_base"), F.sum("here").alias("rare_known"))
    texts = scored.where("key is null").join(rare.withColumnRenamed("row", "__row"), F.col("row") == F.col("__row"), "left")
    frequent.unpersist()
    base = F.col("base") + F.coalesce("rare_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(log10(scale))
    return texts.select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def held_out(doc_id: Column, parts: int = 7, part: int = 2) -> Column:
    return F.pmod(doc_crc(doc_id), F.lit(parts)) == part
