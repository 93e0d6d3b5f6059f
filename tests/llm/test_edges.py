"""Every operator and stage on odd rows and on empty tables."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import covering_simhash, decontaminate, exact_dedup, jaccard_join, lm_score, mixing, periodic_runs, pii, queries, repeated_bytes, sharding, toxicity, url_filter, whitening

from .conftest import DOCS, ODD

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, None), (None, 0, 1), (2, 0, 1), (2, 0, 1)], LABELS)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "two three four five six seven eight"), (2, None), (3, ""), (None, "one two three four five"), (4, "words")], "item_id long, text string")


def test_exact_dedup(odd, nothing):
    got = exact_dedup.mark_duplicates(odd).collect()
    assert len(got) == len(ODD)
    by = {(r["doc_id"], r["text_sha256"]): r for r in got}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert by[1, sha(ODD[0][1])]["keep_id"] == 2 and by[1, sha(ODD[0][1])]["group_size"] == 3
    assert by[None, sha("")]["keep_id"] == 4 and not by[None, sha("")]["kept"] and by[4, sha("")]["kept"]
    assert exact_dedup.mark_duplicates(nothing).count() == 0


def test_pii(odd, nothing):
    assert pii.find_pii(odd).count() == len(ODD)
    assert pii.find_pii(nothing).count() == 0


def test_repeats(odd, nothing):
    got = {r["doc_id"]: r for r in repeated_bytes.find_repeats(odd).collect()}
    assert got[7]["n_bytes"] == 200_000 and len(got[7]["kept"]) == 0 and len(got[7]["spans"]) == 1
    assert got[3]["n_bytes"] == 0 and got[8]["spans"] == []
    assert repeated_bytes.find_repeats(nothing).count() == 0


def test_jaccard(odd, nothing):
    got = jaccard_join.jaccard_components(odd).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got if r["doc_id"]}
    assert by[1]["component_id"] == by[2]["component_id"] == 1 and by[1]["n_shingles"] == 8
    assert by[4]["component_id"] == 4 and by[4]["n_shingles"] == 0 and by[6]["n_shingles"] == 1
    assert jaccard_join.jaccard_components(nothing).count() == 0


def test_contamination(odd, nothing, benchmark, spark):
    got = {(r["doc_id"], r["item_id"]): r["n_shared"] for r in decontaminate.find_contamination(odd, benchmark).collect()}
    assert got == {(1, 1): 3, (2, 1): 3, (8, 4): 1}
    assert decontaminate.find_contamination(nothing, benchmark).count() == 0
    assert decontaminate.find_contamination(odd, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert decontaminate.decontaminate(odd, benchmark).count() == len(ODD) - 4


def test_toxicity(odd, nothing, labels):
    got = toxicity.score_toxicity(odd, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got if r["doc_id"])
    assert toxicity.score_toxicity(nothing, labels).count() == 0
    assert toxicity.score_toxicity(odd, labels.limit(0)).agg(F.max("score")).first()[0] == 0


def test_lm(odd, nothing):
    got = lm_score.score_texts(odd, odd).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got if r["doc_id"]}
    assert by[3]["n_tokens"] == by[4]["n_tokens"] == by[5]["n_tokens"] == 1 and by[6]["n_tokens"] == 60_001
    assert lm_score.score_texts(nothing, odd).count() == 0
    assert all(r["base_score"] == 0 for r in lm_score.score_texts(odd, nothing).collect())


def test_sharding(odd, nothing):
    got = sharding.shard_documents(odd, 8)
    assert got.columns.count("shard") == 1 and got.count() == len(ODD)
    assert dict(got.dtypes)["shard"] == "int"
    assert sharding.shard_documents(nothing, 8).count() == 0


def test_mixing(odd, nothing):
    got = mixing.mix_sources(odd, block=2)
    assert sorted(r[0] for r in got.select("mix_position").collect()) == list(range(len(ODD)))
    assert mixing.mix_sources(nothing).count() == 0
    assert sorted(r[0] for r in mixing.mix_sources(odd, block=2, max_sources=2).select("mix_position").collect()) == list(range(len(ODD)))


def test_periodic_runs(odd, nothing):
    got = periodic_runs.find_runs(odd).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got if r["doc_id"]}
    assert [tuple(r) for r in by[6]["runs"]] == [(0, 60_000, 1)] and by[6]["collapsed"] == "lorem"
    assert all(by[i]["n_words"] == 0 and by[i]["runs"] == [] and by[i]["collapsed"] == "" for i in (3, 4, 5))
    assert by[8]["n_words"] == 7 and by[8]["collapsed"] == " ".join(ODD[10][1].split(" "))
    assert periodic_runs.find_runs(nothing).count() == 0 and periodic_runs.collapse(nothing).count() == 0
    cut = periodic_runs.collapse(odd)
    assert cut.columns == odd.columns and {r["text"] for r in cut.where("doc_id in (3, 5, 6)").collect()} == {None, " \t\n ", "lorem"}
    assert queries.planted_periods(odd).count() == len(ODD) and queries.planted_periods(nothing).count() == 0


def test_simhash(odd, nothing):
    got = covering_simhash.simhash_components(odd).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got if r["doc_id"]}
    assert by[1]["component_id"] == by[2]["component_id"] == 1
    assert {(r["fp"], r["component_id"]) for r in got if r["doc_id"] in (3, 4, 5)} == {(0, 3)}  # so is the row without anything
    assert sorted(r["component_id"] or 0 for r in got if r["doc_id"] is None) == [0, 3]
    assert by[6]["component_id"] == 6 and covering_simhash.simhash_components(nothing).count() == 0


def test_whitening(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, -1.0]), (None, [0.5, 0.25]), (3, None), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, []), (8, [1.0]), (9, [1e300, -1e300])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("theirs") for c in ("component", "n", "__y", "whitened")})
    got = whitening.whiten(table).collect()
    assert sorted(str(r["vec_id"]) for r in got if r["component"] == 1) == ["1", "1", "2", "9", "None"]
    assert {r["n"] for r in got} == {4} and {r["component"] for r in got} == {1, 2}
    assert {r["deviation"] for r in got if r["vec_id"] == 9} == {None}  # beyond 64 bits
    assert whitening.whiten(table.limit(0)).count() == 0 and whitening.whiten(table.where("vec_id in (3, 4, 7)")).count() == 0
    one = whitening.whiten(table.where("vec_id = 1")).collect()  # no variance at all
    assert len(one) == 4 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one} == {(1, 0, 0.0, 0.0, 0.0)}
    # Of two dimensions the one of more distinct vectors counts.
    assert {r["vec_id"] for r in whitening.whiten(table.where("vec_id in (1, 2, 8)")).collect()} == {1, 2}


def test_urls(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://"), (None, "https://A.Example.NET/en/x?y"), (5, "http://x.org/fr/" + "a" * 50_000), (5, "x://net"), (5, "x://net/#/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1))
    got = url_filter.filter_urls(pages).collect()
    assert [(r["host"], r["rule"], r["verdict"]) for r in got if r["page_id"] is None] == [("a.example.net", "example.net/en/", "allow")]
    assert [(r["path"], r["rule"]) for r in got if r["host"] == "net"] == [("", None), ("/", "net/")]
    assert len(got) == len(rows) and {r["host"] for r in got if r["page_id"] in (1, 2, 3)} == {""}
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, odd, nothing, labels, benchmark, tmp_path, name):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    got = stage(spark, docs, str(tmp_path))
    extra = ["shard", "slot"] if name == "sharding" else []
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", *extra]
    lost = {"ngram_jaccard_join": 2, "benchmark_decontamination": 4}.get(name, 0)  # the two rows of document 2 link with document 1
    assert got.count() == len(ODD) - lost
    assert stage(spark, spark.createDataFrame([], DOCS), str(tmp_path)).count() == 0
