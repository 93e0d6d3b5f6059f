"""URL filters: a bit-parallel wildcard automaton (multiword Shift-And).

All glob rules are packed into one bit vector, a bit for each pattern item, in
words of 64 bits. Every URL of a batch advances through the vector together:
one table look-up, one shift and one mask for each byte.

Glob syntax, over the canonical URL ``host + path``: ``*`` any run without a
slash, ``**`` any run, ``?`` any byte but a slash, everything else itself.
A pattern has to match the canonical URL as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import in_worker

#: (host, path, verdict); a host stands for itself and for all its subdomains.
HOST_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Globs that decide where no host rule fits; any match blocks.
BLOCK_GLOBS = ("**spam**", "**pills**", "**casino**", "**xxx**", "*.biz/**", "ads*.*.*/**", "**/ad?/**", "**/track*/*.gif")
DEFAULT_VERDICT = "allow"
#: URLs that advance together, and words of 64 pattern items that an automaton has unless one pattern is longer: bounds of a batch's memory.
STEP, WORDS = 2048, 64
#: Rules of a table at most: they are sent to all workers.
MOST_RULES = 100_000


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path; both empty for a null url or one without ``://``."""
    if not url or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    for i, c in enumerate(rest):
        if c in "?#":
            return lower_ascii(rest[:i]), ""
        if c == "/":
            ends = [k for k in (rest.find("?", i), rest.find("#", i)) if k >= 0]
            return lower_ascii(rest[:i]), rest[i : min(ends)] if ends else rest[i:]
    return lower_ascii(rest), ""


def lower_ascii(s: str) -> str:
    return s.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


class ShiftAnd:
    """All patterns in one automaton.

    Bit i stands for "the items up to i have been read". ``enter[c]`` holds the
    items that byte c may fill, ``stay[c]`` the wildcard items that byte c leaves
    active; ``skip`` marks wildcards, which may also be passed without a byte.
    """

    def __init__(self, patterns: list[str]):
        items: list[tuple[str, int | None]] = []
        first, last = [], []
        for pattern in patterns:
            raw, i = pattern.encode(), 0
            first.append(len(items))
            items.append(("start", None))
            while i < len(raw):
                if raw[i : i + 2] == b"**":
                    items.append(("any", None))
                    i += 1
                elif raw[i : i + 1] == b"*":
                    items.append(("label", None))
                elif raw[i : i + 1] == b"?":
                    items.append(("one", None))
                else:
                    items.append(("byte", raw[i]))
                i += 1
            last.append(len(items) - 1)
        self.words = -(-max(1, len(items)) // 64)
        self.last = last
        self.enter = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        self.skip = np.zeros(self.words, np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        self.longest_skip = 0
        run = 0
        for k, (kind, byte) in enumerate(items):
            word, bit = k // 64, np.uint64(1) << np.uint64(k % 64)
            wild = kind in ("any", "label")
            run = run + 1 if wild else 0
            self.longest_skip = max(self.longest_skip, run)
            if kind == "start":
                self.start[word] |= bit
            elif kind == "byte":
                self.enter[byte, word] |= bit
            else:
                for c in range(256):
                    if c != ord("/") or kind == "any":
                        self.enter[c, word] |= bit
                        if wild:
                            self.stay[c, word] |= bit
            if wild:
                self.skip[word] |= bit
        self.start = self._pass_wildcards(self.start[None])[0]

    def _shift(self, d: np.ndarray) -> np.ndarray:
        out = d << np.uint64(1)
        out[:, 1:] |= d[:, :-1] >> np.uint64(63)
        return out

    def _pass_wildcards(self, d: np.ndarray) -> np.ndarray:
        for _ in range(self.longest_skip):
            d = d | (self._shift(d) & self.skip)
        return d

    def match(self, keys: list[bytes]) -> np.ndarray:
        """A row for each key, a column for each pattern."""
        out = np.zeros((len(keys), len(self.last)), bool)
        order = sorted(range(len(keys)), key=lambda i: len(keys[i]))
        for at in range(0, len(order), STEP):
            part = order[at : at + STEP]
            lengths = np.array([len(keys[i]) for i in part])
            d = np.repeat(self.start[None], len(part), 0)
            alive = 0  # keys are in order of length: those before this one have ended
            block = 4096  # columns held at once
            for j in range(int(lengths[-1]) if len(part) else 0):
                if j % block == 0:
                    raw = np.frombuffer(b"".join(keys[i][j : j + block].ljust(block, b"\0") if len(keys[i]) > j else bytes(block) for i in part), np.uint8).reshape(len(part), block)
                while alive < len(part) and lengths[alive] <= j:
                    alive += 1
                c, live = raw[alive:, j % block], d[alive:]
                live = (self._shift(live) & self.enter[c]) | (live & self.stay[c])
                d[alive:] = self._pass_wildcards(live)
            for p, k in enumerate(self.last):
                out[part, p] = (d[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)
        return out


class Automata:
    """Any number of patterns, packed into automata of at most WORDS words each."""

    def __init__(self, patterns: list[str]):
        self.parts: list[ShiftAnd] = []
        held, items = [], 0
        for pattern in patterns:
            n = len(pattern.encode()) + 1
            if held and items + n > 64 * WORDS:
                self.parts.append(ShiftAnd(held))
                held, items = [], 0
            held.append(pattern)
            items += n
        self.parts.append(ShiftAnd(held))

    def match(self, keys: list[bytes]) -> np.ndarray:
        return np.concatenate([part.match(keys) for part in self.parts], axis=1)


def rules_of(table: DataFrame) -> list[tuple[str, str, str]]:
    """The rules of a table (host, path, verdict), by host and path; rows with a null are left out. More than ``MOST_RULES`` are an error."""
    rows = table.where("host is not null and path is not null and verdict is not null").select("host", "path", "verdict").distinct().limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return sorted(tuple(r) for r in rows)


def filter_urls(pages: DataFrame, host_rules=HOST_RULES, block_globs=BLOCK_GLOBS, default: str = DEFAULT_VERDICT) -> DataFrame:
    """Judge every row of ``pages`` (page_id, url).

    Returns page_id, host, path, rule (null if no host rule fits) and verdict.
    The longest fitting host rule decides; without one, any matching glob blocks;
    else ``default`` holds. A null or malformed url has an empty host and path,
    and fits no host rule. Repeated rows are judged one by one; an empty table
    gives an empty result. Other columns are not read. ``host_rules`` may be a
    table, see :func:`rules_of`; of rules with one host and path the last counts.
    """
    if isinstance(host_rules, DataFrame):
        host_rules = rules_of(host_rules)
    patterns, rule_of, names = [], [], [f"{h}{p}" for h, p, _ in host_rules]
    for k, (host, path, _) in enumerate(host_rules):
        patterns += [f"{host}{path}**", f"**.{host}{path}**" if "/" not in path else f"*.{host}{path}**"]
        rule_of += [k, k]
    n_host = len(patterns)
    patterns += list(block_globs)
    verdicts = [v for _, _, v in host_rules]
    by_length = sorted(range(len(host_rules)), key=lambda k: len(names[k]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = Automata(patterns)
        for batch in batches:
            split = [split_url(u) for u in batch.column(1).to_pylist()]
            hit = automata.match([(h + p).encode("utf-8", "surrogatepass") for h, p in split])
            best = np.full(len(split), -1)
            for k in by_length:  # longer rules overwrite shorter ones
                fits = np.zeros(len(split), bool)
                for p, r in enumerate(rule_of):
                    if r == k:
                        fits |= hit[:, p]
                best[fits] = k
            blocked = hit[:, n_host:].any(axis=1)
            rule = [names[k] if k >= 0 else None for k in best]
            verdict = [verdicts[k] if k >= 0 else "block" if b else default for k, b in zip(best, blocked)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h for h, _ in split], pa.string()), pa.array([p for _, p in split], pa.string()), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    return pages.select("page_id", "url").mapInArrow(in_worker(judge), "page_id long, host string, path string, rule string, verdict string")
