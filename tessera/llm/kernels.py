"""Vectorised text kernels over the bytes of many texts at once (numpy, and xxHash for long words)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
#: Bytes of text that are worked on together, but for a longer single text.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the public splitmix64 finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def mix_one(x: int) -> int:
    return int(mix(np.array([x & 0xFFFFFFFFFFFFFFFF], U64))[0])


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
SPACE = re.compile(rb"[\x20\x09-\x0d]")
#: What is left of eight bytes if only the first k count.
FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(8)], U64)
#: Words of fewer bytes are their own key; longer ones are digested.
SHORT = 8


def chunks(column: pa.Array, most: int | None = None) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, texts) of at most ``most`` (CHUNK) bytes or one text each; null is empty."""
    most = most or CHUNK
    held, size, first = [], 0, 0
    for i, t in enumerate(column.cast(pa.binary())):
        t = t.as_py() or b""
        if held and size + len(t) > most:
            yield first, held
            held, size, first = [], 0, i
        held.append(t)
        size += len(t)
    if held:
        yield first, held


def segments(column: pa.Array, overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(index of the text, offset in it, bytes) of pieces of texts, together at most CHUNK bytes; longer texts come in pieces that overlap by ``overlap`` bytes."""
    rows, offsets, held, size = [], [], [], 0
    for i, t in enumerate(column.cast(pa.binary())):
        t, at = t.as_py() or b"", 0
        while True:
            piece = t[at : at + CHUNK]
            if held and size + len(piece) > CHUNK:
                yield np.array(rows, np.int64), np.array(offsets, np.int64), held
                rows, offsets, held, size = [], [], [], 0
            rows.append(i)
            offsets.append(at)
            held.append(piece)
            size += len(piece)
            if at + CHUNK >= len(t):
                break
            at += CHUNK - overlap
    if held:
        yield np.array(rows, np.int64), np.array(offsets, np.int64), held


def digests(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The 64-bit xxHash of each stretch of ``data``."""
    digest, view = xxhash.xxh3_64_intdigest, memoryview(data)
    return np.fromiter((digest(view[a:b]) for a, b in zip(starts.tolist(), ends.tolist())), U64, len(starts))


def _words(part: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and keys of the words of ``part``. Words under SHORT bytes have keys of their own (their bytes and length, scrambled by a bijection)."""
    inside = ~IS_SPACE[np.frombuffer(part, np.uint8)]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    lengths = ends - starts
    eight = np.ndarray((len(part) + 1,), "<u8", buffer=part + bytes(8), strides=(1,))  # the eight bytes from every place on
    short = np.minimum(lengths, SHORT - 1)
    keys = mix((eight[starts] & FIRST_BYTES[short]) | (short.astype(U64) << U64(56)))
    long = np.flatnonzero(lengths >= SHORT)
    keys[long] = digests(part, starts[long], ends[long])
    return starts, keys


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased) of the texts in order, and the bounds of each text: words of text i are [bounds[i], bounds[i + 1]).

    A long text is worked through in windows that end at spaces, so besides the
    text only its words' hashes are held.
    """
    raw = b" ".join([*texts, b""]).lower()  # bytes.lower changes A-Z only
    starts, words, a = [], [], 0
    while a < len(raw):
        b = SPACE.search(raw, a + CHUNK).end() if a + CHUNK < len(raw) else len(raw)
        at, keys = _words(raw[a:b])
        starts.append(at + a)
        words.append(keys)
        a = b
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    found = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    bounds = np.searchsorted(found, np.concatenate([[0], np.cumsum(lengths)]))
    return np.concatenate(words) if words else np.zeros(0, U64), bounds


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's word n-grams; with fewer words, of the whole sequence."""
    words, bounds = word_hashes(texts)
    grams = mix(words + U64(1))
    whole = len(words) - width + 1
    if whole > 0:
        grams = grams[:whole].copy()
        for k in range(1, width):
            grams = mix(grams + words[k : whole + k] * U64(2 * k + 1))
    out = []
    for i in range(len(texts)):
        a, b = bounds[i], bounds[i + 1]
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        elif b > a:
            h = mix(words[a : a + 1] + U64(1))
            for k in range(1, b - a):
                h = mix(h + words[a + k : a + k + 1] * U64(2 * k + 1))
            out.append(mix(h + U64(b - a)))
        else:
            out.append(np.zeros(0, U64))
    return out
