"""Operators against brute force on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import ahocorasick  # noqa: F401
import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import common, components, decontaminate, exact_dedup, jaccard_join, lm_score, mixing, pii, queries, repeated_bytes, sharding, toxicity, url_filter
from tessera.llm.kernels import shingle_sets, word_hashes

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(t):
    return (t or "").encode().lower().decode()


def docs_of(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows_of(spark):
    return [(r[0], r[1]) for r in docs_of(spark).select("doc_id", "text").collect()]


def components_of(sets, num, den):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: find(i) for i in ids}


def sets_of(rows, width):
    out = {}
    for i, t in rows:
        w = WORD.findall(lower(t))
        out[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    return out


def near_copies(n=120, seed=5):
    """Chains and clusters of edited copies, so that links lie on both sides of the threshold, and short texts."""
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(4000)]
    rows = []
    for g in range(8):
        base = [r.choice(vocabulary) for _ in range(r.choice((6, 12, 30, 80, 200, 500)))]
        for _ in range(n // 8):
            copy = list(base)
            for _ in range(r.randrange(0, max(2, len(base) // 25))):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
            if r.random() < 0.3:
                base = copy
    return rows


@pytest.mark.parametrize("width,num,den", [(3, 90, 100), (5, 80, 100)])
def test_jaccard_components(spark, width, num, den):
    rows = near_copies() + [(1000 + i, t) for i, t in rows_of(spark)[:60]]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), width, num, den).collect()
    sets = sets_of(rows, width)
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(s) for i, s in sets.items()}
    assert {r["doc_id"]: r["component_id"] for r in got} == components_of(sets, num, den)


@pytest.mark.parametrize("group,shingles", [(4, 1 << 22), (2048, 900)])
def test_jaccard_large_groups_in_parts(spark, monkeypatch, group, shingles):
    monkeypatch.setattr(jaccard_join, "GROUP", group)
    monkeypatch.setattr(jaccard_join, "GROUP_SHINGLES", shingles)
    rows = near_copies(seed=9)
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == components_of(sets_of(rows, 3), 90, 100)


@pytest.mark.parametrize("compared", [4_096, 7])
def test_large_groups_by_a_shared_passage_do_not_move(spark, monkeypatch, compared):
    """many sets that share a passage only, and two pairs that link: no sets of a large group are compared across parts."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    shared = [word() for _ in range(80)]
    rows = [(i, " ".join([*shared, *[word() for _ in range(20 + i % 5)]])) for i in range(160)]
    rows += [(200, rows[3][1] + " more"), (201, rows[70][1] + " more")]
    made, old = [], jaccard_join.materialize
    monkeypatch.setattr(jaccard_join, "GROUP", 10)
    monkeypatch.setattr(jaccard_join, "COMPARED", compared)
    monkeypatch.setattr(jaccard_join, "materialize", lambda df, label: made.append(label) or old(df, label))
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: {200: 3, 201: 70}.get(i, i) for i, _ in rows}
    assert "across-parts" not in made and "close-in-large" in made



def test_index_lists_meet_for_every_link():
    """Any two sets at the threshold share a list, also where all differing shingles lie in blocks of their own."""
    r = np.random.default_rng(1)
    for num, den in ((90, 100), (80, 100)):
        for n in (9, 12, 20, 47, 48, 60, 130, 400, 2000, 20_000):
            for _ in range(20):
                a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
                lose = int(len(a) * (den - num) / den)
                b = a[lose:]
                assert len(np.intersect1d(jaccard_join.list_keys(a, num, den), jaccard_join.list_keys(b, num, den)))
    for level in range(60):
        starts = jaccard_join.level_starts(90, 100)
        blocks, empty = jaccard_join.level_plan(level, 90, 100)
        if blocks:  # more blocks than can be touched or empty, for every pair of sizes that meets at this level
            worst = max(a + b - 2 * -(-90 * (a + b) // 190) for a in range(starts[level], starts[level + 1]) for b in range(a, a * 10 // 9 + 1)) if starts[level] < 2000 else 0
            assert blocks - empty > worst


def test_answers_are_derived_without_a_look():
    """Bounds from the pivot's answers give the same components as counting along the lists, and as brute force."""
    r = random.Random(12)
    for trial in range(30):
        base = r.sample(range(1 << 40), r.choice((20, 90, 300)))
        sets = []
        for _ in range(40):
            s = set(base)
            for _ in range(r.randrange(0, len(base) // 5)):
                s.discard(r.choice(base))
                s.add(r.randrange(1 << 40))
            sets.append(np.array(sorted(s), np.uint64))
        everything = np.ones(len(sets), bool)
        args = (sets, r.randrange(len(sets)), everything, everything, np.arange(len(sets)), 90, 100)
        derived = jaccard_join.link_group(*args)
        assert derived.tolist() == jaccard_join.link_group(*args, look_all=True).tolist()
        wanted = components_of({i: frozenset(s.tolist()) for i, s in enumerate(sets)}, 90, 100)
        assert len({(a, b) for a, b in zip(derived.tolist(), [wanted[i] for i in range(len(sets))])}) == len(set(wanted.values())) == len(set(derived.tolist()))


def test_histograms_skip_no_link():
    r = np.random.default_rng(3)
    for n in (3, 30, 300, 700, 5000):
        base = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        sets = []
        for lose in range(0, max(1, n // 6), max(1, n // 40)):
            own = np.union1d(r.permutation(base)[lose:], r.integers(0, 1 << 63, lose // 2, dtype=np.uint64))
            sets.append(own)
        sets += [np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64)) for _ in range(5)]
        kept = jaccard_join.with_partner(np.array([len(s) for s in sets]), [jaccard_join.histogram(s) for s in sets], 80, 100)
        linked = components_of({i: frozenset(s.tolist()) for i, s in enumerate(sets)}, 80, 100)
        alone = [i for i in linked if sum(c == linked[i] for c in linked.values()) == 1]
        assert all(kept[i] for i in linked if i not in alone)
        assert n < 100 or not any(kept[i] for i in alone if i >= len(sets) - 5)


def thue_morse(letters):
    """The first 1,024 letters of the Thue-Morse word, which breaks polynomial hashes modulo powers of two."""
    return "".join(letters[bin(k).count("1") % 2] for k in range(1024))


def test_words_are_told_apart_by_more_than_a_polynomial(spark):
    a, b = thue_morse("ab"), thue_morse("ba")
    hashes, _ = word_hashes([f"{a} {b} a\0 a".encode()])
    assert len(set(hashes.tolist())) == 4
    docs = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    assert {r["component_id"] for r in jaccard_join.jaccard_components(docs).collect()} == {1, 2}
    scored = {r["doc_id"]: r["n_known"] for r in lm_score.score_texts(docs, docs.where("doc_id = 1")).collect()}
    assert scored == {1: 2, 2: 1}
    assert all(len(r["kept"]) == 1024 for r in repeated_bytes.find_repeats(docs).collect() if brute_repeats([(1, a), (2, b)])[r["doc_id"]][1] == 0)
    assert {r["doc_id"]: r["n_bytes"] - len(r["kept"]) for r in repeated_bytes.find_repeats(docs).collect()} == {i: x[1] for i, x in brute_repeats([(1, a), (2, b)]).items()}


def test_long_texts_are_worked_through_in_windows(spark, monkeypatch):
    from tessera.llm import kernels

    text = " ".join(f"w{k % 5000}x" for k in range(40_000))
    whole, _ = word_hashes([text.encode()])
    monkeypatch.setattr(kernels, "CHUNK", 5000)
    parts, bounds = word_hashes([text.encode()])
    assert (whole == parts).all() and bounds.tolist() == [0, 40_000]
    column = __import__("pyarrow").array([None, "x" * 12_000, "short"])
    held = [(r, o, p) for rows, offsets, part in kernels.segments(column, 199) for r, o, p in zip(rows, offsets, part)]
    assert [len(p) for r, _, p in held if r == 1] == [5000, 5000, 2398] and [o for r, o, _ in held if r == 1] == [0, 4801, 9602]


def test_drop_duplicates_keeps_every_text(spark):
    rows = [(1, "same text"), (1, "other text"), (2, "same text"), (2, "Same text"), (None, "same text"), (None, None), (None, ""), (5, "zz")]
    got = exact_dedup.drop_duplicates(spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", __import__("pyspark").sql.functions.lit(1))).collect()
    assert sorted((r["doc_id"] or 0, lower(r["text"])) for r in got) == [(0, ""), (1, "other text"), (2, "same text"), (5, "zz")]


def test_one_row_of_each_group_of_near_copies_stays(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text), (1, "something else that stays as it is here"), (2, text + " more"), (2, text + " more"), (None, text), (None, "alone without an id but with words"), (None, text), (7, ""), (7, None)]
    got = jaccard_join.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str((r["doc_id"], r["text"])) for r in got) == sorted(str(x) for x in (rows[0], rows[1], rows[5], rows[7], rows[8]))
    one = jaccard_join.drop_near_copies(spark.createDataFrame([(None, text)] * 3, "doc_id long, text string")).collect()
    assert len(one) == 1


def test_containment_is_found_wherever_it_lies(spark):
    """Every document with exactly enough shingles of an item, scattered over a long text, is found, and none with one fewer."""
    r = random.Random(6)
    vocabulary = [f"v{k}" for k in range(3000)]
    items, docs = [], []
    for n in (1, 3, 5, 6, 9, 14, 40, 200):
        words = [r.choice(vocabulary) for _ in range(n)]
        items.append((n, " ".join(words)))
        grams = [words[k : k + 5] for k in range(n - 4)] if n >= 5 else [words]
        need = math.ceil(len({tuple(g) for g in grams}) * 0.8 - 1e-9)
        for lack in (0, 1):
            some = r.sample(grams, need - lack)
            filler = lambda: [r.choice(vocabulary) + "f" for _ in range(r.randrange(1, 60))]
            docs.append((len(docs), " ".join(w for g in some for w in (*g, *filler())) + " " + " ".join(filler())))
    grams_of = lambda t, n: (lambda w: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)})(re.findall(r"[^\W_]+", t.lower()))
    wanted = set()
    for i, t in docs:
        for j, item in items:
            own = grams_of(item, min(5, len(item.split())))
            if len(own & grams_of(t, min(5, len(item.split())))) >= math.ceil(len(own) * 0.8 - 1e-9):
                wanted.add((i, j))
    got = decontaminate.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == wanted and len(wanted) >= 8


def test_components_of_a_chain(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (5, 5), (101, 100)]
    got = dict(components.connected_components(spark.createDataFrame(links, "u long, v long")).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_kernels_tell_words_apart():
    hashes, bounds = word_hashes([b"One two\tONE", b"", b"\xc3\x89t\xc3\xa9 one"])
    assert hashes[0] == hashes[2] == hashes[4] and len(set(hashes)) == 3 and list(bounds) == [0, 3, 3, 5]
    assert [len(s) for s in shingle_sets([b"a b c a b c", b"a b", b" "], 3)] == [3, 1, 0]


def brute_repeats(rows):
    seen, out = Counter(), {}
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[p : p + 200] for p in range(len(b) - 199))
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 199):
            if seen[b[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        runs = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def repeat_rows():
    r = random.Random(3)
    base = "".join(r.choice("abcde ") for _ in range(3000))
    return [(1, base), (2, "x" * 1000), (3, base[100:301] + "zz"), (4, base[500:699] + "q"), (5, None), (6, ""), (7, base[700:900]), (8, "ab" * 500 + "c"), (9, "x" * 199), (10, base[1000:1500] + base[1200:1900]), (11, "é" * 150), (12, base[2000:2200])]


@pytest.mark.parametrize("hot", [None, 1])
def test_repeats(spark, monkeypatch, hot):
    if hot is not None:
        monkeypatch.setattr(repeated_bytes.repeated_intervals, "__defaults__", (hot,))
    rows = repeat_rows() + [(1000 + i, t) for i, t in rows_of(spark)]
    got = repeated_bytes.find_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in got} == brute_repeats(rows)


PII_TEXTS = [
    "mail a.b+c@x-y.example.com, then a@b.c@d.e and a@b@c.d", "1.2.3.4.5.6.7.8 999.1.1.1 1.2.3 01.002.0003.4", "4111 1111 1111 1111 and 4111-1111-1111-1112 4111  1111",
    "+1 (136) 555-7479 +12 +1 2 3 (((((", "password=3da3a2ce706 http://joe:pw@host/x token: \"269b1cea99\"", "@ @@ a@ @b.c x@y. +" + "9" * 40, "1" * 5000 + ".1.1.1", "", None, "\U0001f600 a@b.co ١٢",
]


def brute_pii(t):
    t = t or ""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p[-400:]) <= 255 and len(p.lstrip("0")) < 4 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_pii(spark, tmp_path):
    texts = PII_TEXTS + [t for _, t in rows_of(spark)]
    folder = f"{tmp_path}/sf"
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    for r in queries.op8_pii(spark, folder).collect():
        base = brute_pii(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in base) for k in pii.BASE]
        assert r["base_sha256"] == pii.digest_spans(base) == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert set(f"{k}:{a}:{b}" for k, a, b in base) <= set(r["spans"].split(",")) | {""}
    cues = pii.automaton()
    kinds = [pii.KINDS[k] for _, k, _ in pii.find_spans(PII_TEXTS[4], cues)]
    assert kinds.count("account") == 2 and "url" in kinds
    assert pii.redact("x a@b.co y", [("email", 2, 8)]) == "x <email> y"


def test_pii_finds_what_is_planted(spark):
    """Recall by kind over documents with personal data and secrets."""
    cues, found, planted = pii.automaton(), Counter(), Counter()
    forms = {0: r"[\w.]+@[\w.]+\w", 1: r"(?<![\d.])\d+\.\d+\.\d+\.\d+(?![\d.])", 3: r"\+1 \(\d{3}\) \d{3}-\d{4}", 5: r"(?i)(?<=token = \")[0-9a-f]{40}(?=\")"}
    for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").collect():
        spans = {(s, k, e) for s, k, e in pii.find_spans(r[0] or "", cues)}
        for kind, form in forms.items():
            for m in re.finditer(form, r[0] or ""):
                planted[kind] += 1
                found[kind] += (m.start(), kind, m.end()) in spans
    assert all(n > 100 for n in planted.values()) and all(found[k] >= 0.97 * n for k, n in planted.items())


def test_account_values_of_any_length(spark):
    cues = pii.automaton()
    of = lambda t: [t[s:e] for s, k, e in pii.find_spans(t, cues) if k == 5]
    assert of("secret = " + "a1" * 64) == ["a1" * 64] and of("api_key=sk_live_4f.9/x+Y==, next") == ["sk_live_4f.9/x+Y=="]
    assert of("passWord: hunter2x and API_key 123456.") == ["hunter2x", "123456"] and of("token secret=abc123") == ["abc123"] and of("token of thanks") == []
    text = "token/" * 200_000
    began = __import__("time").perf_counter()
    assert of(text) == [] and __import__("time").perf_counter() - began < 5


def test_url_rules_from_a_table(spark, monkeypatch):
    rules = spark.createDataFrame([("net", "/", "block"), ("a.net", "/en/", "allow"), (None, "/", "block"), *((f"h{k}.org", "/", "block") for k in range(300))], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.net/en/x"), (2, "http://b.net/"), (3, "http://q.h77.org/"), (4, "http://free.org/"), (5, "http://ads1.x.com/a"), (6, "http://x.com/q/ad1/z"), (7, "http://x.biz/"), (8, "http://x.com/track1/p.gif")], "page_id long, url string")
    monkeypatch.setattr(url_filter, "WORDS", 2)
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, url_filter.rules_of(rules)).collect()}
    assert got == {1: ("a.net/en/", "allow"), 2: ("net/", "block"), 3: ("h77.org/", "block"), 4: (None, "allow"), **{k: (None, "block") for k in (5, 6, 7, 8)}}
    many = [p for h in range(40) for p in (f"h{h}*/x", f"**{h}**")]
    keys = [f"h{h}.z/x".encode() for h in range(45)]
    assert (url_filter.Automata(many).match(keys) == url_filter.ShiftAnd(many).match(keys)).all()


def test_lm_base_is_exact_and_model_is_better(spark, monkeypatch):
    monkeypatch.setattr(lm_score.frequent_words, "__defaults__", (1 << 9,))
    rows = rows_of(spark)
    got = {r["doc_id"]: r for r in queries.op10_lm_score(spark, SF).collect()}
    tokens = {i: WORD.findall(lower(t)) + [None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    count = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(count.values()), len(count)
    for i, ws in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(count[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
    assert sum(r["score"] - r["base_score"] for r in got.values()) > 0


def test_lm_scores_against_brute_force(spark):
    """Every probability comes from the quantised counts; those after a word sum to 1."""
    r = random.Random(4)
    train = [(k, " ".join(r.choices("the a of cat dog bird sits runs on mat".split(), [9, 8, 7, 3, 3, 2, 2, 2, 5, 1], k=r.randrange(1, 30)))) for k in range(80)]
    docs = [(900, "the cat sits on the mat"), (901, "unseen the words"), (902, ""), (903, None), *train[:10]]
    count, pairs = Counter(), Counter()
    for _, t in train:
        w = [*WORD.findall(t), None]
        count.update(w)
        pairs.update(zip(["", *w], w))

    def half_octave(c):
        step = math.floor(2 * math.log2(c) + 1e-9) + 1
        low = math.ceil(2 ** ((step - 1) / 2) - 1e-9)
        return math.sqrt(low * max(low, math.ceil(2 ** (step / 2) - 1e-9) - 1))

    def less(c):
        low = 2 ** math.floor(math.log2(c)) if c > 1 else 0
        return math.floor(math.sqrt(low * (2 * low - 1)) + 0.5) - 1 if low else 0

    def of_sum(s):
        return s if s <= 32 else 32 * 2 ** ((math.floor(32 * math.log2(s / 32) + 1e-9) + 0.5) / 32)

    z = 1 + sum(half_octave(c) + 1 for c in count.values())

    def p(before, w):
        single = ((half_octave(count[w]) if count[w] else 0) + 1) / z
        after = {b: c for (a, b), c in pairs.items() if a == before}
        s = of_sum(sum(less(c) for c in after.values()))
        t = half_octave(len(after)) if s else 0
        return (less(after.get(w, 0)) + t * single) / (s + t) if s else single

    got = {r["doc_id"]: r["score"] for r in lm_score.score_texts(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(train, "doc_id long, text string")).collect()}
    for i, t in docs:
        w = [*WORD.findall(lower(t)), None]
        assert got[i] == pytest.approx(sum(math.log10(p(a, b)) for a, b in zip(["", *w], w)), rel=1e-6)
    for before in ("", "the", "cat", "on"):
        assert sum(p(before, w) for w in [*count, "unknown"]) == pytest.approx(1, abs=0.02)


def test_lm_probabilities_sum_to_one(spark):
    """After each of the 300 most frequent words, over all words of the corpus and one unknown, as the filter answers."""
    docs = docs_of(spark)
    counts = lm_score.gather(docs)
    rows = sorted(((r["n"], r["key"]) for r in counts.where("key >= 0").collect()), reverse=True)
    held = lm_score.build_filter(lm_score.filter_keys(counts), lm_score.pair_probes(len(rows)))
    scale = 1 + sum(r["words"] * (float(lm_score.word_count(np.array(r["step"]))) + 1) for r in lm_score.words_by_step(counts))
    words = np.unique(np.array([k for _, k in rows] + [12345], np.int64).view(np.uint64))
    contexts = np.searchsorted(words, np.array([k for _, k in rows[:300]], np.int64).view(np.uint64))
    sums = [lm_score.probabilities(held.steps, scale, words, np.arange(len(words)), np.full(len(words), c)).sum() for c in [*contexts, len(words)]]
    assert max(abs(s - 1) for s in sums) < 0.02


def test_lm_scores_do_not_depend_on_partitions(spark):
    rows = spark.createDataFrame(rows_of(spark), "doc_id long, text string")
    scores = [{r["doc_id"]: r["score"] for r in lm_score.score_texts(rows.repartition(n), rows.repartition(n)).collect()} for n in (1, 23)]
    assert scores[0] == pytest.approx(scores[1], rel=1e-12)


def test_toxicity_does_not_depend_on_partitions(spark):
    docs, labels = docs_of(spark), spark.read.parquet(f"{SF}/labels.parquet")
    learned = [toxicity.fit(docs.repartition(n), labels.repartition(n)) for n in (1, 23)]
    assert learned[0]["markers"] == learned[1]["markers"] and learned[0]["letters"] == learned[1]["letters"]
    assert learned[0]["weights"] == pytest.approx(learned[1]["weights"])


def test_toxicity_scoring_against_the_formula(spark):
    docs, labels = docs_of(spark), spark.read.parquet(f"{SF}/labels.parquet")
    learned = toxicity.fit(docs, labels)
    evidence = toxicity.Evidence(learned["markers"], toxicity.CharModel(learned["letters"]))
    evidence.leads_to_marker = lambda form: True  # decode every token
    texts = dict(rows_of(spark))
    for r in toxicity.score_toxicity(docs, labels).collect():
        x = np.array(evidence.row(texts[r["doc_id"]] or "")) / learned["scale"]
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-float(x @ learned["weights"]))), rel=1e-9)


def test_long_tokens_take_time_in_proportion():
    import time

    markers = {"idiot$": 3.0, "scum$": 2.0}
    evidence = toxicity.Evidence(markers, toxicity.CharModel.of_words({"idiot": 50, "scum": 50}))
    for token in ("!" * 1_000_000 + "x", "x" * 1_000_000, "a!" * 500_000, "?" * 1_000_000):
        began = time.perf_counter()
        evidence.of(token)
        assert time.perf_counter() - began < 5
    assert toxicity.without_tail("scum!!!") == "scum" and toxicity.without_tail("scum!!") == "scum!!" and toxicity.without_tail("ha___") == "ha___"


def test_scratch_of_one_thread_is_not_another_s(spark):
    import threading

    kept = []
    with common.scratch_scope(spark) as scope:
        own = common.materialize(spark.range(3), "own")
        other = threading.Thread(target=lambda: kept.append(common.materialize(spark.range(4), "other")))
        other.start()
        other.join()
        scope.keep(own)
        gone = common.materialize(spark.range(5), "gone")
    assert own.count() == 3 and kept[0].count() == 4
    with pytest.raises(Exception):
        gone.count()


def test_places_of_rows_in_tables_of_any_format(spark, tmp_path):
    rows = [(i, f"text {i % 7}") for i in range(50)]
    for form in ("parquet", "csv", "json"):
        path = f"{tmp_path}/{form}"
        spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.format(form).save(path)
        table = spark.read.schema("doc_id long, text string").format(form).load(path)
        assert common.is_parquet_table(table) == (form == "parquet")
        got = common.placed(table).collect()
        assert sorted(r["__place"] for r in got) == list(range(50))
        assert sorted((r["doc_id"], r["text"]) for r in got) == rows


def test_lm_filter_holds_steps(spark):
    rows = [(i * 7919 + 1, 1 + i % 50) for i in range(5000)] + [(-i * 104729 - 1, 1 + i % 4) for i in range(5000)]
    held = lm_score.build_filter(spark.createDataFrame(rows, "key long, step int"), 20)
    found = held.steps(np.array([k for k, _ in rows]).view(np.uint64))
    wanted = np.array([s for _, s in rows])
    assert (found >= wanted).all() and (found > wanted).mean() < 0.02
    others = np.arange(1 << 63, (1 << 63) + 10**6, dtype=np.uint64)
    assert held.steps(others).astype(bool).mean() < 1e-5  # pairs that are not held


def test_lm_scores_do_not_depend_on_what_is_broadcast(spark, monkeypatch):
    r = random.Random(8)
    words = [f"w{k}" for k in range(250_000)]
    lines = []
    for _ in range(2):
        r.shuffle(words)
        lines += 2 * [" ".join(words[k : k + 500]) for k in range(0, len(words), 500)]
    train = spark.createDataFrame([(k, t) for k, t in enumerate(lines)], "doc_id long, text string")
    docs = train.limit(50).union(spark.createDataFrame([(9000 + k, " ".join(f"new{k}x{j}" for j in range(100))) for k in range(20)] + [(9500, None), (None, "w1 w2 new")], "doc_id long, text string"))
    counts = lm_score.gather(train)
    n, _ = lm_score.filter_segments(lm_score.filter_keys(counts), lm_score.pair_probes(counts.where("key >= 0").count()))
    assert n > 2
    whole = sorted(map(str, lm_score.score_texts(docs, train).collect()))
    monkeypatch.setattr(lm_score, "MOST_SEGMENTS", 1)
    assert sorted(map(str, lm_score.score_texts(docs, train).collect())) == whole
    unknown = [x for x in lm_score.score_texts(docs, train).collect() if x["doc_id"] and 9000 <= x["doc_id"] < 9020]
    assert len(unknown) == 20 and all(x["score"] == pytest.approx(x["base_score"], rel=0.1) for x in unknown)


def test_shards(spark):
    r = random.Random(2)
    rows = [(i, "copy" * 40 if i % 3 == 0 else "a" * r.randrange(1, 900)) for i in range(3000)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    by = {}
    for g in got:
        by.setdefault(g["shard"], []).append(g)
    sizes = [sum(len(g["text"]) + 1 for g in gs) for gs in by.values()]
    assert sorted(by) == list(range(8)) and max(sizes) - min(sizes) < 0.02 * sum(sizes) / 8
    assert all(sorted(g["slot"] for g in gs) == list(range(len(gs))) for gs in by.values())
    assert sorted(g["doc_id"] for g in got) == list(range(3000))


def test_op2_sizes(spark):
    got = {r["doc_id"]: r for r in queries.op2_sharding(spark, SF).collect()}
    for i, t in rows_of(spark):
        assert got[i]["size"] == len((t or "").encode()) + 1 and got[i]["text_crc32"] == zlib.crc32((t or "").encode())


def test_pfair_is_less_than_one_block_off():
    share = mixing.shares({"a": 0.5, "b": 0.3, "c": 0.15, "d": 0.05}, 97)
    order = mixing.pfair(share)
    period, taken = sum(share.values()), Counter()
    assert Counter(order) == share
    for slot, s in enumerate(order, 1):
        taken[s] += 1
        assert all(abs(taken[k] - slot * share[k] / period) < 1 for k in share)


def test_mixing_keeps_to_the_weights_until_a_source_ends(spark):
    rows = [(i, "big" if i % 10 < 7 else "mid" if i % 10 < 9 else None) for i in range(2000)]
    got = sorted(mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string"), {"big": 0.5, "mid": 0.25}, block=4, period=64).collect(), key=lambda r: r["mix_position"])
    assert [r["mix_position"] for r in got] == list(range(2000)) and sorted(r["doc_id"] for r in got) == list(range(2000))
    assert [r["mix_block"] for r in got] == sorted(r["mix_block"] for r in got)
    seen = Counter()
    for k, r in enumerate(got[:700], 1):
        seen[r["source"]] += 1
        assert abs(seen["big"] - k * 0.5) < 8 and abs(seen["mid"] - k * 0.25) < 8


def test_schedule_keeps_to_the_exact_weights_over_many_periods():
    equal = {f"s{k:02}": 3000 for k in range(20)}
    order = list(mixing.schedule(equal, dict.fromkeys(equal, 3000**0.5)))
    assert Counter(order) == equal
    for slot in range(0, len(order), 997):
        taken = Counter(order[:slot])
        assert all(abs(taken[s] - slot / 20) < 1 for s in equal)
    weights = {"a": 0.7, "b": 2**0.5 / 10, "c": 1e-4}
    blocks, total, taken = {"a": 40_000, "b": 40_000, "c": 40}, sum(weights.values()), Counter()
    order = list(mixing.schedule(blocks, weights))
    assert Counter(order) == blocks
    for slot, s in enumerate(order[:45_000], 1):  # none has ended here
        taken[s] += 1
        assert all(abs(taken[k] - slot * w / total) < 1 + 1e-6 for k, w in weights.items())


def test_mixing_of_equal_sources_stays_equal(spark):
    n, sources, block = 60_000, 20, 2
    docs = spark.range(n).selectExpr("id as doc_id", f"concat('s', id % {sources}) as source")
    got = mixing.mix_sources(docs, block=block).orderBy("mix_position").select("source", "mix_block", "mix_position").collect()
    assert [r["mix_position"] for r in got] == list(range(n)) and [r["mix_block"] for r in got] == [k // block for k in range(n)]
    seen = Counter(r["source"] for r in got[: n // 2])
    assert len(seen) == sources and all(abs(k - n / 2 / sources) < block for k in seen.values())


def test_many_sources_are_pooled(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('s', id % 500) as source")
    got = mixing.mix_sources(docs, block=2, max_sources=8).orderBy("mix_position").select("doc_id", "source", "mix_position").collect()
    assert [r["mix_position"] for r in got] == list(range(3000)) and len({r["doc_id"] for r in got}) == 3000
    given = mixing.mix_sources(docs, {"s1": 0.5, "s2": 0.1}, block=2, max_sources=8)
    assert sorted(r[0] for r in given.select("mix_position").collect()) == list(range(3000))


def test_op3_against_brute_force(spark):
    docs = docs_of(spark)
    narrow = spark.createDataFrame(docs.select("doc_id", "source").collect(), "doc_id long, source string")
    got = queries.op3_mixing(spark, SF).orderBy("mix_position").collect()
    of = {}
    for r in got:
        of.setdefault(r["source"], []).append(r["doc_id"])
    order = brute_mixed([(i, s) for s, ids in of.items() for i in ids])
    assert [r["doc_id"] for r in got] == order and len(order) == narrow.count()


def test_shift_and_against_regex():
    r = random.Random(4)
    patterns = ["net/**", "**.net/**", "*.a?c/x*", "**spam**", "a" * 70 + "*", "*", "**", "", "x**y*z"]
    to_regex = lambda p: re.compile(re.sub(r"\\\*\\\*|\\\*|\\\?", lambda m: {r"\*\*": ".*", r"\*": "[^/]*", r"\?": "[^/]"}[m[0]], re.escape(p)), re.S)
    keys = ["net/", "a.net/en/", "x.abc/xyz", "b.spam.c", "a" * 75, "", "/", "xAyBz", "x/y/z"] + ["".join(r.choice("axyz./net") for _ in range(r.randrange(12))) for _ in range(400)]
    got = url_filter.ShiftAnd(patterns).match([k.encode() for k in keys])
    assert got.tolist() == [[bool(to_regex(p).fullmatch(k)) for p in patterns] for k in keys]


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    labelled = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    got = toxicity.score_toxicity(labelled, labels).where("held_out").join(labels, "doc_id").select("toxic", "predicted").collect()
    hit = Counter((r["toxic"], r["predicted"]) for r in got)
    assert hit[1, 1] / (hit[1, 1] + hit[1, 0]) > 0.85 and hit[0, 1] / (hit[0, 1] + hit[0, 0]) < 0.01


def test_decoding_disguised_words():
    model = toxicity.CharModel.of_words({w: 50 for w in "idiot moron pathetic loser scum worthless the and with from stupid".split()})
    for disguised, word in (("1d10t", "idiot"), ("m0r0n", "moron"), ("p@thet1c", "pathetic"), ("l-o-s-e-r", "loser"), ("$cum", "scum"), ("stuuupid", "stupid")):
        assert toxicity.decode(disguised, model) == word
    assert "idiot" in toxicity.restored_words("1d10t", model) and toxicity.restored_words("plain", model) == ["plain"]
    assert any("i-d-i-o-t" == t for t in toxicity.tokens_of("you i d i o t there"))


def test_disguises_of_every_form_are_found():
    vocabulary = "idiot moron pathetic loser scum worthless the and with from stupid you are a such what letter good book".split()
    model = toxicity.CharModel.of_words({w: 50 for w in vocabulary})
    markers = {f"{w}$": 3.0 for w in ("idiot", "moron", "loser", "scum", "stupid")}
    evidence = toxicity.Evidence(markers, model)
    found = lambda text: max(map(evidence.of, toxicity.tokens_of(text.lower())))
    forms = ["you are a m o r o n", "such s c u m, you", "i, d, i, o, t", "i  d  i  o  t", "y o u a r e a m o r o n", "ssttuuppiidd", "mooronn", "st.upid", "you st_upid", "mo-ron!", "(id1ot)", "1d10t", "s/c/u/m", "m.0.r.0.n", "stuuupid", "$ c u m"]
    assert [t for t in forms if not found(t)] == []
    for clean in ("a good letter, such a book", "a, b, c, d and e", "room 1024 of 3.14", "https://example.org/a-b_c?d=e", "e. g. i. e."):
        assert not found(clean)
    plain = toxicity.Evidence(markers, model)
    plain.leads_to_marker = lambda form: True  # the look ahead leaves out only what does not count
    for token in {t for text in forms for t in toxicity.tokens_of(text)}:
        assert plain.of(token) == evidence.of(token)


def brute_mixed(rows):
    """Documents (id, source) of each source in the order given, dealt by a Pfair schedule that looks at every source at every slot."""
    of = {}
    for i, s in rows:
        of.setdefault(s, []).append(i)
    left = {s: [ids[k : k + mixing.BLOCK] for k in range(0, len(ids), mixing.BLOCK)] for s, ids in of.items()}
    whole = mixing.whole_weights({s: len(ids) ** mixing.TEMPERATURE for s, ids in of.items()})
    out = []
    while left:
        total, taken, slot = sum(whole[s] for s in left), dict.fromkeys(left, 0), 0
        while True:
            ready = [s for s in left if taken[s] * total // whole[s] <= slot]
            s = min(ready, key=lambda s: (-(-(taken[s] + 1) * total // whole[s]), "null" if s is None else f"s:{s}"))
            if taken[s] == len(left[s]):
                break
            out += left[s][taken[s]]
            taken[s], slot = taken[s] + 1, slot + 1
        left = {s: blocks[taken[s] :] for s, blocks in left.items() if blocks[taken[s] :]}
    return out


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    import corpus_pipeline as pipeline

    def written(name, df):
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    words = re.compile(r"[^\W_]+")
    docs = docs_of(spark)
    verdict = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    clean = written("clean", pipeline.drop_toxic(spark, docs, SF))
    assert sorted(r[0] for r in clean.select("doc_id").collect()) == sorted(i for i, bad in verdict.items() if not bad)

    rows = [(r[0], r[1]) for r in clean.select("doc_id", "text").collect()]
    single = written("single", pipeline.drop_near_duplicates(spark, clean, SF))
    assert sorted(r[0] for r in single.select("doc_id").collect()) == sorted(i for i, c in components_of(sets_of(rows, 5), 80, 100).items() if i == c)

    grams = lambda t: (lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)})(words.findall((t or "").lower()))
    items = []
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words.findall((r["text"] or "").lower())
        items += [grams(r["text"])] if len(w) >= 5 else []
        assert len(w) >= 5
    left = {r[0] for r in single.select("doc_id", "text").collect() if not any(len(g & i) >= math.ceil(len(i) * 0.8 - 1e-9) for g in [grams(r[1])] for i in items)}
    unseen = written("unseen", pipeline.drop_contaminated(spark, single, SF))
    assert {r[0] for r in unseen.select("doc_id").collect()} == left

    mixed = written("mixed", pipeline.mix(spark, unseen, SF))
    dealt = common.placed(unseen).selectExpr("doc_id", "source", "shiftrightunsigned(xxhash64(doc_id, __place, 17), 2) as spread").collect()
    n = max(256, -(-len(dealt) // 20_000))
    order = brute_mixed([(r["doc_id"], r["source"]) for r in sorted(dealt, key=lambda r: (r["spread"] % n, r["spread"], r["doc_id"]))])
    assert [r[0] for r in mixed.select("doc_id").orderBy("_metadata.file_name", "_metadata.row_index").collect()] == order

    at = {i: k for k, i in enumerate(order)}
    slots = {}
    for r in pipeline.shard(spark, mixed, SF).collect():
        slots.setdefault(r["shard"], []).append((r["slot"], at[r["doc_id"]]))
    assert sum(map(len, slots.values())) == len(order)
    for of in slots.values():
        of.sort()
        assert [k for k, _ in of] == list(range(len(of))) and [p for _, p in of] == sorted(p for _, p in of)


def test_shards_keep_the_order_of_many_files(spark, tmp_path):
    docs = spark.range(50_000).selectExpr("id as doc_id", "concat('text ', id * 7919 % 50000) as text")
    docs.repartitionByRange(23, "doc_id").sortWithinPartitions("doc_id").write.parquet(f"{tmp_path}/docs")
    got = sharding.shard_documents(spark.read.parquet(f"{tmp_path}/docs"), 2, keep_order=True).orderBy("shard", "slot").collect()
    for shard in (0, 1):
        mine = [(r["slot"], r["doc_id"]) for r in got if r["shard"] == shard]
        assert [k for k, _ in mine] == list(range(len(mine))) and [i for _, i in mine] == sorted(i for _, i in mine)


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, SF).collect()
    rows = {r["doc_id"]: r for r in docs_of(spark).collect()}
    assert all(rows[g["doc_id"]]["text"] == g["text"] for g in got) and len({g["doc_id"] for g in got}) == len(got)
    kept = sets_of([(g["doc_id"], g["text"]) for g in got], 5)
    assert all(i == c for i, c in components_of(kept, 80, 100).items())
    assert 0.7 * len(rows) < len(got) < len(rows)


def test_each_of_many_sources_has_its_own_share(spark):
    """Beyond 4,096 sources these were pooled, so that the rows of a pool came in a random order."""
    docs = spark.range(5000 * 4).selectExpr("id doc_id", "concat('s', id % 5000) source")
    got = mixing.mix_sources(docs, block=1).orderBy("mix_position").select("source").collect()
    for k in range(4):  # equal sources take turns
        assert len({r["source"] for r in got[5000 * k : 5000 * (k + 1)]}) == 5000


def test_the_filter_is_not_collected(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a b c {i % 7} a b") for i in range(60)], "doc_id long, text string")
    plain = {r["doc_id"]: r["score"] for r in lm_score.score_texts(docs, docs.where("doc_id > 9")).collect()}
    monkeypatch.setattr(lm_score, "collect_filter", lambda *_: pytest.fail("the driver collects the filter"))
    monkeypatch.setattr(lm_score, "SHIPPED_AT_ONCE", 1)
    got = {r["doc_id"]: r["score"] for r in lm_score.score_texts(docs, docs.where("doc_id > 9")).collect()}
    assert len(got) == 60 and got == plain


def test_toxicity_learns_from_all_labelled_rows(spark):
    """Beyond 20,000 labelled rows these were a sample."""
    ids = spark.range(33_000).withColumnRenamed("id", "doc_id")
    kept = ids.where("pmod(crc32(cast(cast(doc_id as string) as binary)), 3) <> 1").count()
    assert kept > 20_000
    docs = ids.selectExpr("doc_id", "if(doc_id % 4 = 0, 'quib zorgle', 'quib fine') text")
    learned = toxicity.fit(docs, ids.selectExpr("doc_id", "int(doc_id % 4 = 0) toxic"))
    assert learned["letters"]["^^q"] == kept and "zorgle$" in learned["markers"]


def test_lm_keys_are_probed_together_and_once(spark, monkeypatch):
    """The keys of each group were probed apart in each segment, and those of each chunk of texts anew."""
    rows = spark.range(3000).selectExpr("id * 7919 + 5 key", "1 + int(id % 300) step")
    n, segments = lm_score.filter_segments(rows, 20)
    assert n == 1
    bits = segments.first()["bits"]
    held = lm_score.build_filter(rows, 20)
    keys = [np.array([i * 7919 + 5 for i in range(k, k + 500)], np.uint64) for k in range(0, 3000, 250)]
    wanted = [held.steps(k) for k in keys]
    asked = []
    steps = lm_score.Filter.steps
    monkeypatch.setattr(lm_score.Filter, "steps", lambda self, k: asked.append(len(k)) or steps(self, k))
    parts = [(0, -1, bits)] + [(0, g, k.tobytes()) for g, k in enumerate(keys)]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in parts[a : a + 5]]) for i in range(3)], names=["segment", "group", "keys"]) for a in range(0, len(parts), 5)]
    got = {b.column(0)[0].as_py(): b for b in lm_score.probe_segments(iter(batches), 20)}
    assert len(asked) == 1 and sorted(got) == list(range(len(keys)))
    for g, k in enumerate(keys):
        found = dict(zip(np.frombuffer(got[g].column(1)[0].as_py(), np.uint64).tolist(), np.frombuffer(got[g].column(2)[0].as_py(), np.uint16).tolist()))
        assert [found.get(x, 0) for x in k.tolist()] == wanted[g].tolist()

    asked.clear()
    look = lm_score.Remembered(held.steps, 1 << 16)
    for _ in range(3):
        assert all((look(k) == w).all() for k, w in zip(keys, wanted))
    assert sum(asked) < 1.2 * 3250
    small = lm_score.Remembered(held.steps, 3)  # most keys share a slot
    assert all((small(k) == w).all() for k, w in zip(keys, wanted))


def test_letters_set_apart_are_looked_for_only_where_they_are(monkeypatch):
    import random

    from tessera.llm import toxicity

    rng = random.Random(5)
    texts = ["".join(rng.choices("ab3@$_ -.é€²\n", k=rng.randrange(40))) for _ in range(2000)] + [None, "", "a", "a b", "x a b", "a b c", "you i d i o t"]
    found = [[m[0] for m in toxicity.APART.finditer((t or "").lower())] for t in texts]
    want = [set((t or "").lower().split()) | {"-".join(re.findall(toxicity.SIGN, m)) for m in f} for t, f in zip(texts, found)]
    searched = []

    class Counted:
        def finditer(self, text, of=toxicity.APART):
            searched.append(text)
            return of.finditer(text)

    monkeypatch.setattr(toxicity, "APART", Counted())
    monkeypatch.setattr(toxicity, "SEARCHED", 500)
    assert list(toxicity.token_sets(texts)) == want
    assert searched == [t.lower() for t, f in zip(texts, found) if f]


def test_evidence_of_tokens_does_not_depend_on_what_is_remembered(monkeypatch):
    from tessera.llm import toxicity

    model = toxicity.CharModel.of_words({"idiot": 50, "scum": 50, "the": 90})
    markers = {"idiot$": 3.0, "idi": 2.0, "scum": 4.0}
    texts = ["The 1d10t!!", "iidiott, s-c-u-m###", "the idea", "you i d i o t", None, "scumm... idiot"] * 3
    whole = toxicity.Evidence(markers, model).rows(texts)
    monkeypatch.setattr(toxicity, "REMEMBERED", 2)
    monkeypatch.setattr(toxicity, "SEARCHED", 10)
    assert toxicity.Evidence(markers, model).rows(texts) == whole
    assert [r[2] for r in whole[:6]] == [3.0, 4.0, 0.0, 3.0, 0.0, 4.0]


def test_remembered_answers_that_took_many_probes_stay():
    asked = []

    def look(keys):
        asked.extend(keys.tolist())
        return np.where(keys < 8, 50, np.where(keys < 500, 1, 0)).astype(np.int64)

    known = lm_score.Remembered(look, 8)
    often, rare = np.arange(8, dtype=np.uint64), np.arange(8, 900, dtype=np.uint64)
    assert known(often).tolist() == [50] * 8
    assert known(rare).tolist() == look(rare).tolist()
    asked.clear()
    assert known(often).tolist() == [50] * 8 and asked == []  # one slot each, that no word of fewer steps takes
    assert known(np.array([3, 400, 700, 3], np.uint64)).tolist() == [50, 1, 0, 50] and asked == [400, 700]


def test_filter_steps_come_in_the_order_of_the_keys():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) | (rng.integers(0, 2, 3000).astype(np.uint64) << np.uint64(63))
    step = rng.integers(1, 90, len(keys))
    segments, n = [], 5
    for i in range(n):
        of = lm_score.segment_of(keys, n) == i
        bits = np.zeros(lm_score.SEGMENT_BITS, bool)
        for s in range(1, 90):
            h, d = lm_score.hashed(keys[of & (step >= s)], s)
            for k in range(20 if s == 1 else lm_score.PROBES):
                bits[lm_score.place(h, d, k)] = True
        segments.append(np.packbits(bits, bitorder="little"))
    model = lm_score.Filter(segments, 20)
    got = model.steps(keys)
    assert (got >= step).all() and (got == step).mean() > 0.99
    assert [int(model.steps(keys[i : i + 1])[0]) for i in range(40)] == got[:40].tolist()
    assert model.steps(keys[::-1]).tolist() == got[::-1].tolist()
