"""Stretches of words that repeat with a period, found by counting the matches of every lag.

A run needs at least three periods of matches at its lag, and five in all, so only
lags with as many are scanned. The matches of a lag are counted exactly: words that
are frequent in a text by the autocorrelation of their places (FFT), all others by
the differences of their places. A text is worked on whole, many short ones at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import in_worker
from tessera.llm.kernels import chunks

#: A run has at least four periods and six words.
PERIODS, WORDS = 4, 6
#: Differences of places that are held before they are counted, and values in one block of transforms.
HELD, BLOCK = 1 << 20, 1 << 20


def needed(lag: np.ndarray) -> np.ndarray:
    """Matches in a row that a run of this period has."""
    return np.maximum(WORDS - lag, (PERIODS - 1) * lag)


def _fast_size(n: int) -> int:
    """The least of 2^k, 3 * 2^k and 5 * 2^k that is n or more."""
    return min(odd << max(0, (-(-n // odd) - 1).bit_length()) for odd in (1, 3, 5))


def _is_heavy(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether a word with so many places in a text of n words costs less by a transform than by pairs."""
    size = 1.25 * n
    return counts.astype(float) ** 2 > 4000 + 0.4 * size * np.log2(size + 2)


def autocorrelation(places: list[np.ndarray], n: int, most: int) -> np.ndarray:
    """How many pairs of places of one word lie 0 to ``most`` apart, summed over the words; exact, as rounding errors stay far below a half."""
    size = _fast_size(n + most)
    rows = max(1, BLOCK // size)
    power = np.zeros(size // 2 + 1)
    for k in range(0, len(places), rows):
        part = places[k : k + rows]
        held = np.zeros((len(part), size))
        held[np.repeat(np.arange(len(part)), [len(p) for p in part]), np.concatenate(part)] = 1
        spectrum = np.fft.rfft(held, axis=1)
        power += (spectrum.real**2 + spectrum.imag**2).sum(axis=0)
    return np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)


def lag_matches(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts, base): counts[base[t] + q] is the number of words of text t that equal the word q places on, for q up to a quarter of its words.

    Words of text t are ids[bounds[t]:bounds[t + 1]].
    """
    sizes = np.diff(bounds)
    most = sizes // PERIODS
    base = np.concatenate([[0], np.cumsum(most + 1)])
    counts = np.zeros(base[-1], np.int64)
    if not len(ids):
        return counts, base
    text = np.repeat(np.arange(len(sizes)), sizes)
    key = text * (int(ids.max()) + 1) + ids
    places = np.argsort(key, kind="stable")
    key = key[places]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    n_of = np.diff(np.append(first, len(key)))
    owner = text[places[first]]
    heavy = _is_heavy(n_of, sizes[owner]) & (most[owner] > 0)
    # Frequent words, text by text.
    at = np.flatnonzero(heavy)
    for t in np.unique(owner[at]):
        mine = at[owner[at] == t]
        found = autocorrelation([places[first[w] : first[w] + n_of[w]] - bounds[t] for w in mine], int(sizes[t]), int(most[t]))
        counts[base[t] : base[t + 1]] += found
    # All others: the k-th next place of the same word, for k = 1, 2, ...
    after = np.repeat(n_of, n_of) - (np.arange(len(key)) - np.repeat(first, n_of)) - 1  # places of the word that follow
    after[np.repeat(heavy, n_of)] = 0
    live, k, held, size = np.flatnonzero(after > 0), 1, [], 0
    while len(live):
        lag = places[live + k] - places[live]
        near = lag <= most[text[places[live]]]
        live, lag = live[near], lag[near]
        held.append(base[text[places[live]]] + lag)
        size += len(lag)
        if size >= HELD:
            counts += np.bincount(np.concatenate(held), minlength=len(counts))
            held, size = [], 0
        k += 1
        live = live[after[live] >= k]
    if size:
        counts += np.bincount(np.concatenate(held), minlength=len(counts))
    return counts, base


def islands(words: np.ndarray, lag: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the stretches that keep the lag and are long enough for a run."""
    same = np.zeros(len(words) - lag + 2, bool)
    same[1:-1] = words[lag:] == words[:-lag]
    edges = np.flatnonzero(same[1:] != same[:-1])
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= needed(np.int64(lag))
    return zip(starts[long].tolist(), (ends - starts + lag)[long].tolist())


def runs_of(words: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period; ``counts`` are the matches by lag, 0 first, and are used up.

    A run of period p matches itself at 2p, 3p and so on as well. As no stretch of
    such a lag goes beyond a run longer than the lag, its matches are taken off
    there, and what is left shows if any other run can be.
    """
    found: dict[tuple[int, int], int] = {}
    lags = np.arange(1, len(counts))
    for q in (np.flatnonzero(counts[1:] >= needed(lags)) + 1).tolist():
        if counts[q] < max(WORDS - q, (PERIODS - 1) * q):
            continue
        for start, length in islands(words, q):
            if (start, length) not in found:  # else it has a shorter period
                found[start, length] = q
                end = min(length, len(counts))
                counts[2 * q : end : q] -= length - np.arange(2 * q, end, q)
    return sorted((s, n, q) for (s, n), q in found.items())


def find_in(texts: list[bytes]) -> Iterator[tuple[int, list[tuple[int, int, int]], bytes]]:
    """(number of words, runs, what is left when each run keeps its first period only) of each text."""
    split = [t.split() for t in texts]  # on the bytes 0x09 to 0x0D and 0x20
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for words in split for w in words), np.int64, int(sizes.sum()))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    counts, base = lag_matches(ids, bounds)
    lag = np.arange(len(counts)) - np.repeat(base[:-1], np.diff(base))
    hopeful = np.unique(np.searchsorted(base, np.flatnonzero((lag > 0) & (counts >= needed(lag))), "right") - 1)
    runs: dict[int, list] = {t: runs_of(ids[bounds[t] : bounds[t + 1]], counts[base[t] : base[t + 1]]) for t in hopeful.tolist()}
    for t, words in enumerate(split):
        mine = runs.get(t, [])
        if mine:
            dropped = np.zeros(len(words) + 1, np.int64)
            for start, length, period in mine:
                dropped[start + period] += 1
                dropped[start + length] -= 1
            words = [words[i] for i in np.flatnonzero(np.cumsum(dropped[:-1]) == 0).tolist()]
        yield int(sizes[t]), mine, b" ".join(words)


def find_runs(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_words, runs, collapsed.

    ``runs`` holds (start, length, period) of every run by start and then period, in
    words numbered from 0: a stretch of words with that smallest period, of at
    least four periods and six words, that no neighbouring word extends.
    ``collapsed`` is the text with each run cut to its first period, its words
    joined by one space; words that any run drops are dropped. Words are what lies
    between spaces and the control characters from tab to carriage return.

    Null, empty and blank texts have no words, no runs and an empty ``collapsed``.
    Repeated rows give repeated results, an empty table an empty one; other columns
    are not read. Nothing is shuffled; a task holds the texts of an Arrow batch and
    about 200 bytes a word of the longest text.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, offsets, flat, rest = [], [0], [], []
            for _, texts in chunks(batch.column(1)):
                for n, runs, collapsed in find_in(texts):
                    n_words.append(n)
                    flat += runs
                    offsets.append(len(flat))
                    rest.append(collapsed)
            table = np.array(flat, np.int64).reshape(-1, 3)
            spans = pa.StructArray.from_arrays([pa.array(table[:, k]) for k in range(3)], names=["start", "length", "period"])
            runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n_words, pa.int64()), runs, pa.array(rest, pa.binary())], names=["doc_id", "n_words", "runs", "collapsed"])

    found = docs.select("doc_id", "text").mapInArrow(in_worker(scan), "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def collapse(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, others) with each run of ``text`` cut to its first period; a null text stays null, a text without runs stays as it is, byte for byte."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            out: list[bytes | None] = []
            for _, texts in chunks(column):
                out += [c if runs else t for t, (_, runs, c) in zip(texts, find_in(texts))]
            new = pa.array([None if not v.is_valid else c for v, c in zip(column, out)], pa.binary()).cast(column.type)
            yield batch.set_column(batch.schema.get_field_index("text"), "text", new)

    return docs.mapInArrow(in_worker(cut), docs.schema)
