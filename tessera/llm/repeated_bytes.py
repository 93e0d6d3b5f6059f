"""Removal of repeated byte strings by prefix-free parsing.

1. Parse. A rolling hash over 40-byte strings makes triggers: of every 200-byte
   window, the 40-byte string with the least hash (the leftmost of equals). Runs
   of windows with one trigger form a phrase, whose bytes overlap the next phrase's
   by 199, so every window lies in exactly one phrase, and equal windows have equal
   triggers at equal places, wherever they are. Triggers that are alone in the
   corpus are dropped early.
2. Dictionary and parse. The parse is the sequence of phrases of every text, the
   dictionary holds each phrase once, with the number of its places in the parse:
   all windows of a phrase that has two are repeats. As phrases overlap by a
   window less one byte, the order of suffixes of the parse, which prefix-free
   parsing needs for what lies beyond a phrase, is never asked for.
3. Edges. A phrase that occurs once may still share windows with others that have
   its trigger. It is divided where the trigger's place in the window passes a
   multiple of 40. Only pieces whose core (the bytes that all windows with the
   trigger at these places have) occurs twice can share windows.
4. Suffix arrays of the dictionary. Pieces with one core meet in one partition.
   There the suffixes of the dictionary that begin after the core are sorted, and
   so are the reversed prefixes that end before it, each with the length of what
   neighbours have in common; a window is an interval of both orders, and windows
   with the same two intervals are equal byte for byte. The windows of a core with
   more than ``HOT`` pieces are dealt out one by one instead.
5. The windows that were found are laid over the texts.

The corpus is parsed again in each of the four passes, as that takes less room than
keeping the parse. Long texts are parsed in pieces that overlap by 199 bytes. Equal
phrases are told by 64-bit digests, windows within a core by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bitmaps import KeyBitmaps
from tessera.llm.common import in_worker, materialize, placed, scratch_scope
from tessera.llm.kernels import CHUNK, U64, digests, mix, segments

LENGTH, TRIGGER = 200, 40
PLACES = 40
CORE = LENGTH - PLACES + 1
HOT = 50_000
BLOCK = 32_768  # pieces that are sorted at once, but for those of one core
BYTES = mix(np.arange(1, 257, dtype=U64))
BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, U64)
    steps[0] = 1
    return np.cumprod(steps, dtype=U64)


#: Powers of the rolling hash's base and of its inverse, for the bytes of one chunk.
UP, DOWN = _powers(BASE, CHUNK + 1), _powers(pow(BASE, -1, 1 << 64), CHUNK + 1)


def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, from block-wise running minima."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(U64).max, U64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


@dataclass
class Runs:
    """Runs of windows: the text of each, its start there and in the chunk, how many windows, trigger, place of the trigger and where the core begins."""

    doc: np.ndarray
    start: np.ndarray
    begin: np.ndarray
    windows: np.ndarray
    trigger: np.ndarray
    place: np.ndarray
    core: np.ndarray


class Parse:
    """The triggers of all windows of some texts, together at most CHUNK bytes, and the runs of windows that share them."""

    def __init__(self, texts: list[bytes]):
        self.data = b"".join(texts)
        raw = np.frombuffer(self.data, np.uint8)
        lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        n = len(raw)
        self.at, self.valid, self.grams = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, U64)
        if n < LENGTH:
            return
        sums = np.zeros(n + 1, U64)
        np.cumsum(BYTES[raw] * UP[:n], out=sums[1:])
        self.grams = mix((sums[TRIGGER:] - sums[:-TRIGGER]) * DOWN[: n - TRIGGER + 1])
        keys = (self.grams & U64(0xFFFFFFFF00000000)) | np.arange(len(self.grams), dtype=U64)
        self.at = (_sliding_least(keys, LENGTH - TRIGGER + 1) & U64(0xFFFFFFFF)).astype(np.int64)
        self.valid = np.zeros(len(self.at), bool)
        for a, b in zip(self.starts[lengths >= LENGTH], self.ends[lengths >= LENGTH]):
            self.valid[a : b - LENGTH + 1] = True

    def runs(self, divide: bool) -> Runs:
        """Phrases, or with ``divide`` their pieces."""
        at, valid = self.at, self.valid
        change = at[1:] != at[:-1]
        place = (at - np.arange(len(at))) // PLACES if divide else np.zeros(len(at), np.int64)
        if divide:
            change |= place[1:] != place[:-1]
        first, last = valid.copy(), valid.copy()
        first[1:] &= change | ~valid[:-1]
        last[:-1] &= change | ~valid[1:]
        begin, stop = np.flatnonzero(first), np.flatnonzero(last)
        doc = np.searchsorted(self.ends, begin, "right")
        return Runs(doc, begin - self.starts[doc], begin, stop - begin + 1, self.grams[at[begin]], place[begin], at[begin] - place[begin] * PLACES)

    def digests(self, runs: Runs, some: np.ndarray) -> np.ndarray:
        """Of the bytes of some of the runs."""
        return digests(self.data, runs.begin[some], runs.begin[some] + runs.windows[some] - 1 + LENGTH)

    def cores(self, runs: Runs, some: np.ndarray) -> np.ndarray:
        return digests(self.data, runs.core[some], runs.core[some] + CORE) ^ mix(runs.place[some].astype(U64))


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _triggers(texts: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, part in segments(batch.column(0), LENGTH - 1):
                key, n = np.unique(Parse(part).runs(False).trigger, return_counts=True)
                yield pa.RecordBatch.from_arrays([_long(key), pa.array(n.astype(np.int64))], names=["trigger", "n"])

    return texts.select("text").mapInArrow(in_worker(count), "trigger long, n long")


def _phrases(texts: DataFrame, repeated) -> DataFrame:
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = repeated.value
        names = ["key", "start", "windows", "phrase"]
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for rows, offsets, part in segments(batch.column(1), LENGTH - 1):
                p = Parse(part)
                runs = p.runs(False)
                keep = np.flatnonzero(known.passes(runs.trigger))
                doc = runs.doc[keep]
                yield pa.RecordBatch.from_arrays([pa.array(keys[rows[doc]]), pa.array(offsets[doc] + runs.start[keep]), pa.array(runs.windows[keep]), _long(p.digests(runs, keep))], names=names)

    return texts.mapInArrow(in_worker(parse), "key long, start long, windows long, phrase long")


def _pieces(p: Parse, triggers, once) -> tuple[Runs, np.ndarray, np.ndarray]:
    """The divided parse, which of its pieces have a repeated trigger, and which of them lie in a phrase that (nearly surely) occurs once."""
    whole, cut = p.runs(False), p.runs(True)
    keep = np.flatnonzero(triggers.passes(cut.trigger))
    if not len(keep):
        return cut, keep, np.zeros(0, bool)
    parent, back = np.unique(np.searchsorted(whole.begin, cut.begin[keep], "right") - 1, return_inverse=True)
    return cut, keep, once.passes(p.digests(whole, parent))[back]


def _cores(texts: DataFrame, triggers, once) -> DataFrame:
    def cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, part in segments(batch.column(0), LENGTH - 1):
                p = Parse(part)
                cut, keep, single = _pieces(p, triggers.value, once.value)
                core, at, n = np.unique(p.cores(cut, keep), return_inverse=True, return_counts=True)
                some = np.bincount(at, single, len(core)) > 0
                yield pa.RecordBatch.from_arrays([_long(core), pa.array(n.astype(np.int64)), pa.array(some)], names=["core", "n", "once"])

    return texts.select("text").mapInArrow(in_worker(cores), "core long, n long, once boolean")


def _edges(texts: DataFrame, triggers, once, wanted) -> DataFrame:
    """The bytes of all pieces with a wanted core, and how many of them lie before it; of pieces in repeated phrases one of each kind in a task, without a key, as a witness."""

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        names = ["core", "key", "start", "lead", "data"]
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for rows, offsets, part in segments(batch.column(1), LENGTH - 1):
                p = Parse(part)
                cut, keep, single = _pieces(p, triggers.value, once.value)
                core = p.cores(cut, keep)
                left = wanted.value.passes(core)
                keep, single, core = keep[left], single[left], core[left]
                known = ~single
                known[known] = [name in seen or seen.add(name) is not None for name in p.digests(cut, keep[~single]).tolist()]
                keep, single, core = keep[~known], single[~known], core[~known]
                if len(keep):
                    begin, doc = cut.begin[keep], cut.doc[keep]
                    data = [p.data[a:b] for a, b in zip(begin.tolist(), (begin + cut.windows[keep] - 1 + LENGTH).tolist())]
                    key = pa.array(keys[rows[doc]], mask=~single)
                    yield pa.RecordBatch.from_arrays([_long(core), key, pa.array(offsets[doc] + cut.start[keep]), pa.array((cut.core[keep] - begin).astype(np.int32)), pa.array(data, pa.binary())], names=names)

    return texts.mapInArrow(in_worker(edges), "core long, key long, start long, lead int, data binary")


def _sorted_contexts(raw: np.ndarray, first: np.ndarray, step: int, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the contexts (``size`` bytes from ``first`` on, forwards or backwards), and what each has in common with the one before it in that order."""
    j = np.arange(PLACES - 1)
    inside = j < size[:, None]
    held = np.where(inside, raw[np.where(inside, first[:, None] + step * j, 0)], 0)
    wide = np.zeros((len(first), PLACES), np.uint8)
    wide[:, : PLACES - 1] = held
    words = wide.view(">u8").astype(U64)
    order = np.lexsort(words.T[::-1])
    differ = wide[order[1:]] != wide[order[:-1]]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), PLACES)
    return order, np.concatenate([[0], common])


def equal_windows(data: list[bytes], lead: np.ndarray) -> np.ndarray:
    """For every piece and every of its at most PLACES windows, whether another piece has the same bytes there around the same core."""
    n = len(data)
    raw = np.frombuffer(b"".join(data), np.uint8)
    lengths = np.fromiter((len(t) for t in data), np.int64, n)
    core = np.cumsum(lengths) - lengths + lead
    tail = lengths - lead - CORE
    bytes_of = np.ascontiguousarray(raw[core[:, None] + np.arange(CORE)]).view(f"V{CORE}").ravel()
    _, group = np.unique(bytes_of, return_inverse=True)
    (left, left_common), (right, right_common) = _sorted_contexts(raw, core - 1, -1, lead), _sorted_contexts(raw, core + CORE, 1, tail)
    hit = np.zeros((n, PLACES), bool)
    before, after = np.empty(n, np.int64), np.empty(n, np.int64)
    for e in range(PLACES):  # windows with e bytes before the core
        has = np.flatnonzero((lead >= e) & (tail >= PLACES - 1 - e))
        if len(has) < 2:
            continue
        before[left], after[right] = np.cumsum(left_common < e), np.cumsum(right_common < PLACES - 1 - e)
        _, back, times = np.unique((group[has] * (n + 1) + before[has]) * (n + 1) + after[has], return_inverse=True, return_counts=True)
        hit[has, lead[has] - e] = times[back] > 1
    return hit


def _repeated_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, start, stop) of the runs of repeated windows of the pieces (core, key, start, lead, data), which come in the order of their cores."""

    def settle(key: list, start: list, lead: list, data: list) -> pa.RecordBatch:
        hit = equal_windows(data, np.array(lead, np.int64))
        hit[[k is None for k in key]] = False
        edge = np.diff(hit.view(np.int8), axis=1, prepend=0, append=0)
        piece, first = np.nonzero(edge == 1)
        _, stop = np.nonzero(edge == -1)
        begin = np.array(start, np.int64)[piece]
        return pa.RecordBatch.from_arrays([pa.array([key[k] for k in piece], pa.int64()), pa.array(begin + first), pa.array(begin + stop - 1 + LENGTH)], names=["key", "start", "stop"])

    held: list[list] = [[], [], [], []]
    last = None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if len(held[0]) >= BLOCK and row[0] != last:
                yield settle(*held)
                held = [[], [], [], []]
            last = row[0]
            for h, v in zip(held, row[1:]):
                h.append(v)
    if held[0]:
        yield settle(*held)


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of the pieces: (key, start, suffix)."""
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK // PLACES):
            _, key, start, _, data = (c.to_pylist() for c in batch.slice(a, BLOCK // PLACES).columns)
            windows = np.array([len(t) - LENGTH + 1 for t in data])
            own = np.repeat(np.arange(len(data)), windows)
            place = np.arange(len(own)) - np.repeat(np.cumsum(windows) - windows, windows)
            at = place + np.repeat(np.cumsum([0, *map(len, data)])[:-1], windows)
            yield pa.RecordBatch.from_arrays([pa.array([key[i] for i in own], pa.int64()), pa.array(np.array(start)[own] + place), _long(digests(b"".join(data), at, at + LENGTH))], names=["key", "start", "suffix"])


def repeated_intervals(texts: DataFrame, hot: int = HOT) -> DataFrame:
    """Rows (key, spans) for each text with repeats; spans are (start, stop) byte ranges that repeats cover, not merged. ``texts`` is (key, text) with keys of their own."""
    spark = texts.sparkSession
    sc = spark.sparkContext
    n_tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = materialize(_triggers(texts).groupBy("trigger").agg(F.sum("n").alias("n")).where("n > 1").select("trigger"), "triggers")
    triggers = sc.broadcast(KeyBitmaps(found, "trigger", found.count()))
    phrases = materialize(_phrases(texts, triggers), "phrases")
    dictionary = materialize(phrases.groupBy("phrase").agg(F.count(F.lit(1)).alias("n")), "dictionary")
    single = dictionary.where("n = 1").select("phrase")
    once = sc.broadcast(KeyBitmaps(single, "phrase", single.count()))
    whole = phrases.join(dictionary.where("n > 1").select("phrase"), "phrase").select("key", "start", (F.col("start") + F.col("windows") - 1 + LENGTH).alias("stop"))

    cores = _cores(texts, triggers, once).groupBy("core").agg(F.sum("n").alias("n"), F.max("once").alias("once"))
    cores = materialize(cores.where("n > 1 and once").select("core", "n"), "cores")
    wanted = sc.broadcast(KeyBitmaps(cores, "core", cores.count()))
    edges = _edges(texts, triggers, once, wanted)
    span = "key long, start long, stop long"
    large = materialize(cores.where(F.col("n") > hot).select("core"), "large-cores")
    settle = lambda rows: rows.repartition(n_tasks, "core").sortWithinPartitions("core").mapInArrow(in_worker(_repeated_suffixes), span)
    if large.isEmpty():
        found = whole.union(settle(edges))
    else:
        edges = materialize(edges, "edges")
        each = materialize(edges.join(large, "core", "left_semi").select(*edges.columns).mapInArrow(in_worker(_suffixes), "key long, start long, suffix long"), "suffixes")
        classes = materialize(each.groupBy("suffix").count().where("count > 1").select("suffix"), "suffix-classes")
        dealt = each.where("key is not null").join(classes, "suffix", "left_semi").select("key", "start", (F.col("start") + LENGTH).alias("stop"))
        found = whole.union(settle(edges.join(large, "core", "left_anti").select(*edges.columns))).union(dealt)
    found = materialize(found.groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("spans")), "spans")
    for held in (triggers, once, wanted):
        held.unpersist()
    return found


def merge(spans: list[dict]) -> list[tuple[int, int]]:
    """Sorted, disjoint and not touching."""
    out: list[list[int]] = []
    for a, b in sorted((s["start"], s["stop"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def find_repeats(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_bytes, spans (merged start and stop byte offsets of what repeats), kept (the other bytes).

    A byte repeats if a 200-byte string that covers it starts anywhere else in the
    table too, in the same text or another; strings never cross texts. Null counts
    as empty; texts under 200 bytes keep everything; rows that repeat a doc_id and
    text repeat each other. An empty table gives an empty result; other columns
    are not read.
    """
    rows = placed(docs, ["doc_id", "text"]).withColumnRenamed("__place", "key")
    with scratch_scope(docs.sparkSession) as scope:
        found = scope.keep(repeated_intervals(rows.select("key", "text")))
    found = found.withColumnRenamed("key", "__key")
    joined = rows.join(found, F.col("key") == F.col("__key"), "left").select("doc_id", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            sizes, spans, kept = [], [], []
            for text, found in zip(batch.column(1).cast(pa.binary()), batch.column(2)):
                text, merged = text.as_py() or b"", merge(found.as_py() or [])
                at, parts = 0, []
                for a, b in merged:
                    parts.append(text[at:a])
                    at = b
                parts.append(text[at:])
                sizes.append(len(text))
                spans.append([{"start": a, "stop": b} for a, b in merged])
                kept.append(b"".join(parts))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(spans, pair), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return joined.mapInArrow(in_worker(cut), "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")
