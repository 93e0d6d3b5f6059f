"""Periodic runs, whitening and SimHash groups against brute force."""

import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import covering_simhash, periodic_runs, queries, whitening
from tessera.llm.components import connected_components

SF = "/root/testdata/sf0.001"


def all_runs(words):
    """Every run, by scanning every lag; a stretch counts with its shortest period."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, length, q) for (s, length), q in found.items())


def periodic_texts(seed, n=250):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        words = [f"w{r.randrange(r.choice((1, 2, 3, 40)))}" for _ in range(r.randrange(0, 90))]
        for _ in range(r.randrange(0, 3)):
            a, p = r.randrange(len(words) + 1), r.randrange(1, 9)
            words[a:a] = (words[a : a + p] or ["z"]) * r.randrange(3, 9)
        out.append(r.choice((" ", "  ", "\t", "\n ")).join(words))
    return out


@pytest.mark.parametrize("heavy", (0, 3, 10**9))
def test_runs_against_all_lags(monkeypatch, heavy):
    """The same runs whether words are counted by transforms, by pairs, or by both."""
    monkeypatch.setattr(periodic_runs, "_is_heavy", lambda counts, n: counts > heavy)
    for seed in range(6):
        texts = [t.encode() for t in periodic_texts(seed)]
        for text, (n, runs, collapsed) in zip(texts, periodic_runs.find_in(texts)):
            words = text.split()
            assert n == len(words) and runs == all_runs(words)
            gone = {i for s, length, q in runs for i in range(s + q, s + length)}
            assert collapsed == b" ".join(w for i, w in enumerate(words) if i not in gone)


def test_lag_counts_of_a_long_text():
    """Frequent words by transforms, rare ones by pairs, as the sizes have it, on a text of 30,000 words."""
    r = np.random.default_rng(3)
    ids = np.minimum(r.zipf(1.3, 30_000), 5_000)
    counts, _ = periodic_runs.lag_matches(ids, np.array([0, len(ids)]))
    n_of = np.unique(ids, return_counts=True)[1]
    heavy = periodic_runs._is_heavy(n_of, np.full(len(n_of), len(ids)))
    assert heavy.any() and not heavy.all()
    for q in (1, 2, 17, 999, 7_499, 7_500):
        assert counts[q] == (ids[q:] == ids[:-q]).sum()


def test_equal_words_need_one_scan(monkeypatch):
    """The lags that a run explains are not scanned again."""
    scans = []
    whole = periodic_runs.islands
    monkeypatch.setattr(periodic_runs, "islands", lambda words, lag: scans.append(lag) or whole(words, lag))
    assert [runs for _, runs, _ in periodic_runs.find_in([b"a b " * 5_000])] == [[(0, 10_000, 2)]]
    assert scans == [2]


def test_runs_of_the_documents(spark):
    texts = {r["doc_id"]: r["text"] for r in queries.planted_periods(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    got = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in periodic_runs.find_runs(spark.read.parquet(f"{SF}/documents.parquet").drop("text").join(spark.createDataFrame(list(texts.items()), "id long, text string"), F.col("doc_id") == F.col("id"))).collect()}
    assert got == {i: all_runs((t or "").encode().split()) for i, t in texts.items() if len((t or "").split()) < 3000} | {i: r for i, r in got.items() if len((texts[i] or "").split()) >= 3000}
    assert sum(map(len, got.values())) > 10


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(prints):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= 3:
            root[find(a)] = find(b)
    out = {}
    for p in prints:
        out.setdefault(find(p), set()).add(p)
    return sorted(map(sorted, out.values()))


def test_fingerprints_in_parts(monkeypatch):
    text = ("One  two\tTHREE four\nfive " * 40 + "\u00c9t\u00e9 end").encode()
    whole = covering_simhash.fingerprint_of(text)
    assert whole == brute_fingerprint(text.decode())
    for part in (1, 7, 64):
        monkeypatch.setattr(covering_simhash, "PART", part)
        assert covering_simhash.fingerprint_of(text) == whole
        assert covering_simhash.fingerprint_of(b"Two words") == brute_fingerprint("two WORDS")
    assert covering_simhash.fingerprint_of(b" \n") == 0


def test_every_pair_within_the_radius_shares_a_table():
    """For each choice of up to three bits, of 64 and of few, one mask leaves all of them out."""
    for bits in (np.arange(64), np.arange(64) * 23 % 64, np.array([3, 7, 8, 9, 20, 21, 40, 41, 63])):
        masks = [int(m) for m in covering_simhash.masks(bits)]
        assert all(masks)
        for choice in itertools.combinations(bits.tolist(), 3):
            differing = sum(1 << b for b in choice)
            assert any(not m & differing for m in masks)
    both = [bin(int(a | b)).count("1") for a in covering_simhash.masks(np.arange(64)) for b in covering_simhash.masks(np.arange(64) * 23 % 64)]
    assert min(both) >= 46


def crowded(seed=2):
    """Chains of small steps, a dense ball, pairs at distances 3 and 4, and others."""
    r = random.Random(seed)
    prints = {0, (1 << 64) - 1}
    for _ in range(60):
        p = r.getrandbits(64)
        prints.add(p)
        for _ in range(r.randrange(1, 6)):
            p ^= sum(1 << b for b in r.sample(range(64), r.choice((1, 2, 3, 3, 4))))
            prints.add(p)
    centre = r.getrandbits(64)
    prints |= {centre ^ sum(1 << b for b in r.sample(range(64), r.choice((2, 3, 5)))) for _ in range(500)}
    free = r.sample(range(64), 9)
    prints |= {centre ^ (0b1111 << 40) ^ sum(1 << b for k, b in enumerate(free) if v >> k & 1) for v in range(0, 512, 3)}
    return sorted(prints)


@pytest.mark.parametrize("hot", (4, 1024))
def test_links_against_all_pairs(spark, hot):
    prints = crowded()
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    links = covering_simhash.near_links(spark.createDataFrame(signed, "fp long"), hot=hot)
    found = {}
    for r in connected_components(links).collect():
        found.setdefault(r["component"], set()).add(r["node"] % (1 << 64))
    assert sorted(map(sorted, found.values())) == [g for g in groups_of(prints) if len(g) > 1]


@pytest.mark.parametrize("pairs", (8, 256))
def test_stars_of_large_sets(monkeypatch, pairs):
    monkeypatch.setattr(covering_simhash, "PAIRS", pairs)
    prints = crowded(seed=4)
    u, v = covering_simhash.stars(np.array(prints, np.uint64))
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in zip(u.tolist(), v.tolist()):
        root[find(a)] = find(b)
    out = {}
    for p in prints:
        out.setdefault(find(p), set()).add(p)
    assert sorted(map(sorted, out.values())) == groups_of(prints)


def test_simhash_of_the_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], brute_fingerprint(r["text"])) for r in docs.collect()]
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in queries.op13_simhash_dedup(spark, SF).collect()}
    group = {p: k for k, g in enumerate(groups_of(sorted({p for _, p in rows}))) for p in g}
    least = {}
    for i, p in rows:
        least[group[p]] = min(i, least.get(group[p], i))
    assert got == {i: (p, least[group[p]]) for i, p in rows}


def test_whitening_against_the_whole_matrix(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").repartition(5)
    rows = rows.union(rows.where("vec_id % 7 = 0"))  # repeated rows count once in the fit
    got = whitening.whiten(rows).collect()
    x = {r["vec_id"]: np.floor(64 * np.array(r["embedding"], float)).astype(int) + 1_000_000 for r in rows.collect()}
    fit = np.array(sorted({tuple(v) for v in x.values()}))
    n, sums = len(fit), fit.sum(axis=0)
    values, vectors = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, vectors = values[::-1][:16], vectors[:, ::-1][:, :16]
    assert len(got) == 16 * rows.count() and {r["n"] for r in got} == {n}
    assert max(r["identity_error"] for r in got) < 1e-9
    for r in got:
        k, v = r["component"] - 1, x[r["vec_id"]]
        assert r["deviation"] == int(((n * v - sums) ** 2).sum())
        assert r["explained"] == pytest.approx(values[k] / np.cov(fit.T, bias=True).trace(), rel=1e-9)
        assert abs(r["whitened"]) == pytest.approx(abs((v - sums / n) @ vectors[:, k]) / values[k] ** 0.5, abs=1e-6)
    signs = [{np.sign(r["whitened"]) * np.sign((x[r["vec_id"]] - sums / n) @ vectors[:, r["component"] - 1]) for r in got if r["component"] == k and abs(r["whitened"]) > 1e-3} for k in (1, 16)]
    assert all(len(s) == 1 for s in signs)


def test_merged_moments_are_those_of_the_whole():
    r = np.random.default_rng(1)
    x = r.integers(-50, 50, (1000, 7)) + np.int64(whitening.SHIFT)
    cuts = [0, 1, 3, 400, 401, 999, 1000]
    parts = [whitening.moments_of(x[a:b]) for a, b in zip(cuts, cuts[1:])]
    while len(parts) > 1:
        parts = [parts[k].merged(parts[k + 1]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    whole = (x - whitening.SHIFT).astype(float)
    assert parts[0].n == 1000 and parts[0].sums.tolist() == x.sum(axis=0).tolist()
    assert np.allclose(parts[0].scatter / 1000, np.cov(whole.T, bias=True), rtol=1e-9)
