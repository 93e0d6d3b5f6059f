"""Toxicity with noisy-channel deobfuscation.

Tokens with signs among their letters or with repeated letters, and runs of
letters set apart, are decoded: a lattice holds, for every character, the letters
it may stand for and what the channel charges for that; in runs of letters set
apart, a word may end at every sign. Viterbi finds the cheapest path under a
character language model. The restored words are then scored. Tokens none of
whose paths leads to a marker are not decoded, as they could not count.

Everything is learned from all labelled rows that are not held out: the character model, the words and word beginnings (of three to eight
letters, as inflections differ at their ends) that tell the classes apart by their
likelihood ratio, and a small logistic regression over a text's evidence.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import fsum, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import doc_crc, in_worker, materialize

THRESHOLD = 0.7
#: Tokens whose evidence or words a task remembers, entries that it counts before it hands them on, and characters that it searches together for letters set apart, but for a longer single text.
REMEMBERED, COUNTED, SEARCHED = 400_000, 1 << 20, 1 << 20
#: Sums over rows are of whole multiples of 1 / ONE, so that they do not depend on the order of the rows.
ONE = 1 << 32

#: Letters that a character of leetspeak may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c"}
#: Costs, in nats, of reading a sign as a letter, of dropping a separator or a repeated letter, and of ending a word at a separator.
AS_LETTER, DROP_SIGN, DROP_REPEAT, END_WORD = 0.7, 0.5, 1.0, 0.5
SEPARATORS = "-_.*~'`^/\\,:;#%&=<>"
SIGN = r"(?:[^\W_]|[@$€])"
#: Three or more letters, or signs that stand for them, that anything else sets apart.
APART = re.compile(rf"(?<![^\W_])(?<![@$€]){SIGN}(?!{SIGN})(?:(?:[\W_](?<![@$€]))+{SIGN}(?!{SIGN})){{2,}}")
JOINED = re.compile(rf"{SIGN}(?:-{SIGN}){{2,}}")
DISGUISED = re.compile(r"[\W\d_]|([^\W\d_])\1")
DOUBLE = re.compile(r"(.)\1", re.S)
#: Signs at the ends of a token that stand for no letter.
ENDS = ".,;:\"'?"
REPEATS = re.compile(r"(.)\1+", re.S)
WORD = re.compile(r"[^\W\d_]+")


def without_tail(token: str) -> str:
    """The token without a sign that is repeated three times or more at its end."""
    sign = token[-1:]
    if not sign or sign.isalnum() or sign == "_" or sign.isspace():
        return token
    rest = token.rstrip(sign)
    return rest if len(token) - len(rest) > 2 else token


def trigrams(word: str) -> list[str]:
    s = f"^^{word}$"
    return [s[i - 2 : i + 1] for i in range(2, len(s))]


class CharModel:
    """Letter trigrams with absolute back-off."""

    def __init__(self, counts: dict[str, int]):
        self.tri, self.bi, self.uni = counts, Counter(), Counter()
        self.tri_of, self.bi_of = Counter(), Counter()
        for k, n in counts.items():
            self.bi[k[1:]] += n
            self.uni[k[2]] += n
            self.tri_of[k[:2]] += n
            self.bi_of[k[1]] += n
        self.total = sum(self.uni.values()) + 200

    @classmethod
    def of_words(cls, words: dict[str, int]) -> CharModel:
        counts: Counter[str] = Counter()
        for w, n in words.items():
            for k in trigrams(w):
                counts[k] += n
        return cls(counts)

    def cost(self, before: str, c: str) -> float:
        p = (self.uni[c] + 1) / self.total
        if n := self.bi_of[before[1]]:
            p = (self.bi[before[1] + c] + 5 * p) / (n + 5)
        if n := self.tri_of[before]:
            p = (self.tri.get(before + c, 0) + 5 * p) / (n + 5)
        return -log(p)


def decode(token: str, model: CharModel, apart: bool = False) -> str:
    """The likeliest word behind a disguised token, or words with spaces between if its letters are set ``apart``; linear in its length."""
    beam: dict[str, tuple[float, tuple]] = {"^^": (0.0, ())}  # last two letters -> (cost, letters as a linked list)
    last = ""
    for c in token:
        options: list[tuple[str, float]] = []
        if c.isalpha():
            options.append((c, 0.0))
            if c == last:
                options.append(("", DROP_REPEAT))
        else:
            options += [(letter, AS_LETTER) for letter in LEET.get(c, "")]
            options.append(("", DROP_SIGN if c in SEPARATORS or c.isspace() else 4.0))
        last = c
        after: dict[str, tuple[float, tuple]] = {}
        for state, (cost, path) in beam.items():
            for letter, price in options:
                if letter:
                    key, total, way = state[1] + letter, cost + price + model.cost(state, letter), (letter, path)
                else:
                    key, total, way = state, cost + price, path
                if key not in after or total < after[key][0]:
                    after[key] = (total, way)
            if apart and not c.isalnum() and state[1] != "^":
                total = cost + END_WORD + model.cost(state, "$")
                if "^^" not in after or total < after["^^"][0]:
                    after["^^"] = (total, (" ", path))
        beam = after
    state = min(beam, key=lambda s: (beam[s][0] + model.cost(s, "$"), s))
    path = beam[state][1]
    out = []
    while path:
        letter, path = path
        out.append(letter)
    return "".join(reversed(out))


def disguised_forms(token: str) -> list[str]:
    """What there is to decode of one token: its core, with and without the signs at its ends that can be letters."""
    core = without_tail(token)
    return [f for f in dict.fromkeys((core.strip(ENDS), core.strip(ENDS + "!()[]{}"))) if DISGUISED.search(f) and not f.isdigit()]


def plain_words(token: str) -> tuple[str, ...]:
    """The words of one token as they stand."""
    core = token.strip(ENDS)
    return (core,) if core.isalpha() else tuple(WORD.findall(without_tail(token)))


def restored_words(token: str, model: CharModel | None) -> list[str]:
    """The words of one whitespace-free, lower-case token, restored where it may be disguised."""
    words = WORD.findall(without_tail(token))
    if model is not None:
        for form in disguised_forms(token):
            words += decode(form, model, bool(JOINED.fullmatch(form))).split()
    return words


@lru_cache(maxsize=1)
def is_sign() -> np.ndarray:
    """Whether SIGN fits each character."""
    out = np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)
    out[[ord(c) for c in "@$€"]] = True
    return out


def with_apart(texts: list[str]) -> set[int]:
    """The texts in which APART finds something: three stretches of signs in a row have one sign each."""
    sizes = [len(t) + 4 for t in texts]
    signs = is_sign()[np.frombuffer(" aa ".join([*texts, ""]).encode("utf-32-le"), "<u4")]  # no stretch of one sign reaches over two texts
    edges = np.flatnonzero(np.diff(signs, prepend=False, append=False))
    single = np.diff(edges)[::2] == 1
    first = edges[::2][:-2][single[:-2] & single[1:-1] & single[2:]]
    return set(np.searchsorted(np.cumsum(sizes), first, side="right").tolist())


def token_sets(texts: list[str | None]) -> Iterator[set[str]]:
    """The distinct lower-case tokens of each text, with runs of letters set apart put together."""
    at = 0
    while at < len(texts):
        held, size = [], 0
        while at < len(texts) and (not held or size + len(texts[at] or "") <= SEARCHED):
            held.append((texts[at] or "").lower())
            size += len(held[-1])
            at += 1
        apart = with_apart(held)
        for i, text in enumerate(held):
            found = set(text.split())
            if i in apart:
                found.update("-".join(re.findall(SIGN, m[0])) for m in APART.finditer(text))
            yield found


def tokens_of(text: str) -> set[str]:
    """Those of one text."""
    return next(token_sets([text]))


def features(word: str) -> list[str]:
    """The word itself and its beginnings."""
    return [f"{word}$", *(word[:k] for k in range(3, min(len(word), 8) + 1))]


class Remembered(dict):
    """What ``of`` gives for tokens, remembered for REMEMBERED tokens and those of one text."""

    def __init__(self, of: Callable[[str], object]):
        self.of = of

    def __missing__(self, token: str) -> object:
        found = self[token] = self.of(token)
        return found

    def of_text(self, tokens: set[str]) -> Iterator:
        if len(self) > REMEMBERED:
            self.clear()
        return map(self.__getitem__, tokens)


class Evidence:
    """The likelihood ratio of the strongest marker of each token."""

    def __init__(self, markers: dict[str, float], model: CharModel | None):
        self.markers, self.model, self.remembered = markers, model, Remembered(self.of)
        self.ends = {REPEATS.sub(r"\1", f.rstrip("$")) for f in markers}
        self.heads = {f.rstrip("$")[:3] for f in markers}
        self.beginnings = {f[:k] for f in self.ends for k in range(1, len(f) + 1)}

    def leads_to_marker(self, form: str) -> bool:
        """Whether any path of the lattice of ``form`` has a marker at the beginning of a word, repeated letters aside."""
        apart = bool(JOINED.fullmatch(form))
        states = {""}
        for c in form:
            letter = c.isalpha()
            after = set() if letter else set(states)
            for state in states:
                for read in c if letter else LEET.get(c, ""):
                    if state[-1:] == read:
                        after.add(state)
                    if (longer := state + read) in self.beginnings:
                        if longer in self.ends:
                            return True
                        after.add(longer)
            if apart and not c.isalnum():
                after.add("")
            if not after and not apart:
                return False
            states = after
        return False

    def strongest(self, words: list[str]) -> float:
        return max((self.markers[f] for w in words if w[:3] in self.heads for f in features(w) if f in self.markers), default=0.0)

    def of(self, token: str) -> float:
        core = without_tail(token).strip(ENDS)
        if core.isalpha():  # one word, and nothing to decode but repeated letters
            found = self.strongest([core]) if core[:3] in self.heads else 0.0
            if not found and self.model is not None and DOUBLE.search(core) and self.leads_to_marker(core):
                found = self.strongest(decode(core, self.model).split())
            return found
        found = self.strongest(restored_words(token, None))
        if not found and self.model is not None and any(map(self.leads_to_marker, disguised_forms(token))):
            found = self.strongest(restored_words(token, self.model))
        return found

    def row(self, text: str) -> list[float]:
        return self.rows([text])[0]

    def rows(self, texts: list[str | None]) -> list[list[float]]:
        out = []
        for tokens in token_sets(texts):
            hits = list(filter(None, self.remembered.of_text(tokens)))
            n = len(tokens)
            out.append([1.0, fsum(hits), max(hits, default=0.0), float(len(hits)), 100 * len(hits) / (n + 10), log(n + 1)])
        return out


def logistic(rows: DataFrame, ridge: float = 1.0, steps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Weights for standardised columns and the columns' scales, of ``rows`` (y, x: array). Every Newton step is a pass over the rows; the driver gets the sums of each partition."""
    k = rows.select(F.size("x")).first()[0]
    scale = np.maximum([float(v) for v in rows.agg(*[F.max(F.abs(F.get("x", F.lit(j)))) for j in range(k)]).first()], 1e-9)
    w = np.zeros(k)
    penalty = np.eye(k) * ridge * 0.01
    for _ in range(steps):

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k + 1, k), np.int64)
            for batch in batches:
                y = batch.column(0).to_numpy()
                z = batch.column(1).flatten().to_numpy().reshape(-1, k) / scale
                p = 1 / (1 + np.exp(-np.clip((z * w).sum(axis=1), -30, 30)))  # noqa: B023
                total[0] += np.rint(z * ((y - p) * ONE)[:, None]).astype(np.int64).sum(axis=0)
                total[1:] += np.rint(z[:, :, None] * z[:, None, :] * ((p * (1 - p) + 1e-6) * ONE)[:, None, None]).astype(np.int64).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.int64()))], names=["s"])

        parts = [r["s"] for r in rows.select("y", "x").mapInArrow(in_worker(sums), "s array<long>").collect()]
        total = np.array([sum(c) / ONE for c in zip(*parts)]).reshape(k + 1, k)
        step = np.linalg.solve(total[1:] + penalty, total[0] - penalty @ w)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w, scale


def fit(docs: DataFrame, labels: DataFrame) -> dict | None:
    """What scoring needs, learned from all labelled rows whose crc32(doc_id) mod 3 is not 1; None if a class is missing.

    Of several labels of a doc_id the largest counts, and of several texts the
    least. The result does not depend on how the tables are partitioned.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(F.pmod(doc_crc(F.col("doc_id")), F.lit(3)) != 1).select(F.col("doc_id").alias("__id"), "toxic")
    rows = docs.select("doc_id", "text").join(known, F.col("doc_id") == F.col("__id"))
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.coalesce(F.min("text"), F.lit("")).alias("text"))
    rows = materialize(rows, "to-learn")

    def batch_of(rows: list[tuple[str, int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=["f", "toxic", "clean"])

    def of_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts of each class (empty name), toxic texts with each feature, and texts with each word as letter trigrams (after a tab)."""
        words, seen, spelt, sizes = Remembered(plain_words), Counter(), Counter(), [0, 0]

        def letters() -> pa.RecordBatch:
            out = Counter()
            for w, n in spelt.items():
                for t in trigrams(w):
                    out[t] += n
            return batch_of([(f"\t{t}", n, 0) for t, n in out.items()])

        for batch in batches:
            for toxic, tokens in zip(batch.column(1).to_pylist(), token_sets(batch.column(2).to_pylist())):
                found = set().union(*words.of_text(tokens))
                spelt.update(found)
                sizes[1 if toxic else 0] += 1
                if toxic:
                    seen.update({f for w in found for f in features(w)})
                if len(spelt) > COUNTED:
                    yield letters()
                    spelt.clear()
                if len(seen) > COUNTED:
                    yield batch_of([(f, n, 0) for f, n in seen.items()])
                    seen.clear()
        yield letters()
        yield batch_of([("", sizes[1], sizes[0]), *((f, n, 0) for f, n in seen.items())])

    def of_clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Clean texts with each feature that is wanted."""
        seen, held = Counter(), Remembered(lambda t: tuple(wanted[f] for w in plain_words(t) for f in features(w) if f in wanted))
        for batch in batches:
            clean = [text for toxic, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()) if not toxic]
            for tokens in token_sets(clean):
                seen.update(set().union(*held.of_text(tokens)))
        yield batch_of([(f, 0, n) for f, n in seen.items()])

    def counted(f) -> DataFrame:
        return rows.mapInArrow(in_worker(f), "f string, toxic long, clean long").groupBy("f").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))

    first = materialize(counted(of_all), "counted")
    n = first.where("f = ''").first()
    if n is None or not n["toxic"] or not n["clean"]:
        return None
    spelling = F.col("f").startswith("\t")
    often = first.where(~spelling & F.expr("f <> '' and toxic >= 3"))
    # what is collected from here on grows with the different words of toxic texts and with the trigrams of letters, not with the rows
    wanted = {r["f"]: r["f"] for r in often.select("f").collect()}
    both = often.unionByName(counted(of_clean)).groupBy("f").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    p, q = F.col("toxic") / F.lit(n["toxic"]), (F.col("clean") + 0.5) / F.lit(n["clean"] + 1.0)
    share = (F.col("toxic") + F.col("clean")) / F.lit(float(n["toxic"] + n["clean"]))
    gain = 2 * (F.col("toxic") * F.log(p / share) + F.col("clean") * F.log(F.greatest(F.col("clean"), F.lit(1e-9)) / F.lit(n["clean"]) / share))
    chosen = both.withColumns({"ratio": F.log(p / q), "gain": gain}).where("ratio > 1.5 and gain > 14")
    markers = {r["f"]: float(r["ratio"]) for r in chosen.orderBy("f").collect()}
    letters = {r["f"][1:]: r["toxic"] for r in first.where(spelling).orderBy("f").collect()}
    for f in markers:  # the model must find likely what the markers stand for
        if f.endswith("$"):
            for k in trigrams(f[:-1]):
                letters[k] = letters.get(k, 0) + n["toxic"] // 2 + 1
    model = CharModel(letters)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Evidence(markers, model)
        for batch in batches:
            x = known.rows(batch.column(2).to_pylist())
            y = [1.0 if t else 0.0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.float64()), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])

    seen = materialize(rows.mapInArrow(in_worker(evidence), "y double, x array<double>"), "evidence")
    weights, scale = logistic(seen)
    return {"markers": markers, "letters": letters, "weights": weights, "scale": scale}


def keep_clean(docs: DataFrame, learned: dict | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` (all columns) whose text scores under ``threshold``, in one pass; all rows where nothing was learned."""
    shared = docs.sparkSession.sparkContext.broadcast(learned)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        known = found and Evidence(found["markers"], CharModel(found["letters"]))
        for batch in batches:
            if found and batch.num_rows:
                x = np.array(known.rows(batch.column(at).to_pylist())) / found["scale"]
                batch = batch.filter(pa.array(1 / (1 + np.exp(-np.clip(x @ found["weights"], -30, 30))) < threshold))
            yield batch

    return docs.mapInArrow(in_worker(keep), docs.schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, held_out, score (0 to 1), predicted (1 from ``threshold`` on).

    Labels (doc_id, toxic) are used only to learn, and only those of rows that are
    not held out (crc32 of the doc_id as text, mod 3, is not 1; a null doc_id reads
    as an empty text). Null and empty texts are scored as texts without evidence.
    Without labels of both classes every score is 0. Repeated rows score alike; an
    empty table gives an empty result; other columns are not read.
    """
    learned = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(learned)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        if found:
            known = Evidence(found["markers"], CharModel(found["letters"]))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            if found and texts:
                x = np.array(known.rows(texts)) / found["scale"]
                p = 1 / (1 + np.exp(-np.clip(x @ found["weights"], -30, 30)))
            else:
                p = np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(p)], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(in_worker(score), "doc_id long, score double")
    held = (F.pmod(doc_crc(F.col("doc_id")), F.lit(3)) == 1).alias("held_out")
    return scored.select("doc_id", held, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
