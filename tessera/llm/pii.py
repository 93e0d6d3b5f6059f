"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the cues (at-signs, plus signs, schemes, digits
and identifier words) in one pass; a local parser for each kind expands a cue to
the bounds of the item and validates it. No parser looks at a stretch of text
twice, so very long texts stay linear.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import in_worker

#: In the order in which spans with the same start are listed. The first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE = KINDS[:4]
#: Identifier words, in letters of either case.
ID_CUES = ("iban", "ssn", "account", "acct", "passport", "token", "secret", "api_key", "password")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
LOGIN_URL = re.compile(r"://[^\s/?#@:]+:[^\s/?#@]+@[A-Za-z0-9.-]+")
ACCOUNT = re.compile(r"""[\x20]{0,3}(?:number|no\.?|key)?[\x20]{0,3}[:=#]?[\x20]{0,3}["']?([A-Za-z0-9](?:[A-Za-z0-9_.+/~-]*[A-Za-z0-9])?={0,2})""")
#: Characters of an account value or secret at least; there must be a digit too.
LEAST_VALUE = 6
DIGITS = "0123456789"
HAS_DIGIT = re.compile("[0-9]")


def automaton() -> ahocorasick.Automaton:
    cues = ahocorasick.Automaton()
    for word in ("@", "+", "://", *DIGITS):
        cues.add_word(word, (word if word not in DIGITS else "0", len(word)))
    for word in ID_CUES:
        cues.add_word(word, ("id", len(word)))
    cues.make_automaton()
    return cues


def lower_same_length(text: str) -> str:
    """Lower case; only A-Z where a letter would become two."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if c.isascii() else c for c in text)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def find_spans(text: str, cues: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, by start and kind."""
    spans: list[tuple[int, int, int]] = []
    email_from = ip_from = card_from = phone_from = other_from = no_value_to = 0
    for end, (cue, width) in cues.iter(lower_same_length(text)):
        at = end - width + 1
        if cue == "0":
            if at >= ip_from and (at == 0 or text[at - 1] not in DIGITS):
                if m := IP.match(text, at):
                    ip_from = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                        spans.append((at, 1, m.end()))
            if at >= card_from and (m := CARD.match(text, at)):
                card_from = m.end()
                digits = NOT_DIGIT.sub("", m[0])
                if 14 <= len(digits) <= 19 and luhn(digits):
                    spans.append((at, 2, m.end()))
        elif cue == "@":
            start = at
            while start > email_from and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                email_from = m.end()
                spans.append((start, 0, m.end()))
        elif cue == "+":
            if at >= phone_from and (m := PHONE.match(text, at)):
                phone_from = m.end()
                if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                    spans.append((at, 3, m.end()))
        elif cue == "://":
            start = at
            while start > other_from and text[start - 1].isalpha():
                start -= 1
            if start < at and (m := LOGIN_URL.match(text, at)):
                other_from = m.end()
                spans.append((start, 4, m.end()))
        elif at >= other_from and end + 1 >= no_value_to and (at == 0 or not text[at - 1].isalnum()) and (m := ACCOUNT.match(text, end + 1)):
            if len(m[1]) >= LEAST_VALUE and HAS_DIGIT.search(m[1]):
                other_from = m.end(1)
                spans.append((m.start(1), 5, m.end(1)))
            else:
                no_value_to = m.start(1) + len(m[1].rstrip("="))  # cues inside lead to the rest of the same run
    spans.sort()
    return spans


def find_pii(docs: DataFrame) -> DataFrame:
    """Every span of personal data of every row of ``docs`` (doc_id, text).

    Returns doc_id and spans, an array of (kind, start, stop) in code points, by
    start and then by kind as in ``KINDS``. Null and empty texts have no spans.
    Repeated rows give repeated results; other columns are not read.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cues = automaton()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            out = [[{"kind": KINDS[k], "start": s, "stop": e} for s, k, e in find_spans(t.as_py() or "", cues)] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(out, kind)], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(in_worker(scan), "doc_id long, spans array<struct<kind:string,start:long,stop:long>>")


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each span replaced by its kind in angle brackets; of overlapping spans the earlier stays."""
    out, at = [], 0
    for kind, start, stop in spans:
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
            at = stop
    return "".join([*out, text[at:]])


def digest_spans(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
