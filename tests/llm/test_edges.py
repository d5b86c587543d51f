"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import pytest
from pyspark.sql import functions as F

from fleetlens.llm import bpe, decontam, langid, line_dedup, quality, secret_scan, simhash, substring, toxicity, url_filter
from public_tokenizers import path

RANKS = path("byte_bpe_50k.tiktoken")
LONG = "palabra larga y otra " * 6000
SCHEMA = "doc_id long, text string, lang string, score string, th string, payload int, n_words string, h1 string"
ITEM = "one two three four five six seven eight nine ten"


def rows():
    made = [
        (None, None, None), (None, "a null id", "en"), (1, None, "en"), (2, "", None), (3, " \t\n ", "en"), (4, LONG, "es"),
        (5, "same text here " * 12, "en"), (5, "same text here " * 12, "en"), (5, "another text under one id " * 5, "en"),
        (6, "same text here " * 12, "en"), (7, f"before {ITEM} after", "en"), (8, "É漢字😀\x00 'll don't", "xx"),
    ]
    return [(i, t, lang, "s", "t", 1, "w", "h") for i, t, lang in made]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1), (6, 0), (7, 0), (None, 1), (8, None), (99, 1)], "doc_id long, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, ITEM), (1, ITEM), (2, None), (3, "short"), (None, "")], "item_id long, text string")


def apply(name, docs, labels, benchmark):
    if name == "toxicity":
        return toxicity.score(docs, toxicity.fit(docs, labels))
    if name == "bpe":
        return bpe.digests(docs, RANKS)
    if name == "substring":
        return substring.removed(docs)
    if name == "simhash":
        return simhash.near_duplicates(docs)
    if name == "quality":
        return quality.judge(docs)
    if name == "langid":
        return langid.classify(docs, langid.fit(docs))
    if name == "secrets":
        return secret_scan.scan(docs, secret_scan.fit(docs))
    if name == "lines":
        return line_dedup.deduplicated(docs)
    return decontam.leaks(docs, benchmark)


PER_ROW = ["toxicity", "bpe", "substring", "simhash", "quality", "langid", "secrets", "lines"]


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_for_each_row(name, docs, labels, benchmark):
    found = apply(name, docs, labels, benchmark).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(r[0]) for r in rows())


@pytest.mark.parametrize("name", PER_ROW + ["decontam"])
def test_empty_tables(name, docs, labels, benchmark):
    found = apply(name, docs.limit(0), labels.limit(0), benchmark.limit(0))
    assert found.collect() == []
    if name == "decontam":
        assert decontam.leaks(docs, benchmark.limit(0)).collect() == []
        assert decontam.clean(docs, benchmark.limit(0)).count() == docs.count()


def test_without_labels_every_score_is_zero(docs, labels):
    found = toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect()
    assert {(r.score, r.predicted) for r in found} == {(0.0, 0)}


def test_columns_are_replaced_and_kept(docs, labels, benchmark):
    found = apply("toxicity", docs, labels, benchmark)
    assert found.columns == [c for c in docs.columns if c != "score"] + ["score", "predicted"]
    assert dict(found.dtypes)["score"] == "double" and dict(found.dtypes)["th"] == "string"


def test_substring_removes_later_copies_and_repeats(docs):
    found = {(r.doc_id, r.n_words): r for r in substring.removed(docs).collect()}
    assert found[(6, 36)].n_removed == 36 and found[(6, 36)].kept == ""  # a copy of document 5
    assert found[(5, 36)].n_removed == 33  # its own windows repeat from the fourth word on
    assert found[(1, 0)].kept == found[(3, 0)].kept == ""
    assert found[(4, 24000)].n_removed == 24000 - 4


def test_simhash_groups_and_null_ids(docs):
    found = {(r.doc_id, r.th): r for r in simhash.near_duplicates(docs).collect()}
    none = [r for r in found.values() if r.fp == 0]
    assert {r.component_id for r in none} == {1} and {r.doc_id for r in none} == {None, 1, 2, 3}
    one = simhash.one_of_each(docs)
    assert one.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in one.collect()]
    assert len(kept) == len(set(kept)) and (6, rows()[9][1]) not in kept and (1, None) in kept


def test_quality_keeps_only_what_passes(docs):
    found = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert found[2].base_failed and not found[2].kept and found[2].n_words == 0
    assert found[4].n_repeat_words == found[4].n_words == 24000 and found[4].base_failed
    assert "text" not in found[4].asDict()


def test_langid_undetermined(docs):
    found = {r.doc_id: r for r in langid.classify(docs, langid.fit(docs)).collect()}
    assert found[1].lang_pred == found[3].lang_pred == "und" and found[1].score == 0.0 and found[1].rejected
    assert found[4].lang_pred in ("en", "es", "xx")


def test_decontamination(docs, benchmark):
    found = decontam.leaks(docs, benchmark).collect()
    assert [(r.doc_id, r.item_id, r.distance, r.first_word, r.end_word) for r in found] == [(7, 1, 0, 1, 11)]
    assert docs.count() - decontam.clean(docs, benchmark).count() == 1


def test_urls(spark):
    pages = spark.createDataFrame(
        [(None, None, "x"), (1, "no scheme", "x"), (2, "http://A.Example.NET/en/x?y", "x"), (2, "http://A.Example.NET/en/x?y", "x"),
         (3, "http://example.net?/en/", "x"), (4, "ftp://www.SPAM-farm.example.org/a", "x"), (5, "://", "x"), (6, "http://.net/", "x"),
         (7, "http://" + "a." * 300 + "org/fr/", "x")],
        "page_id long, url string, verdict string",
    )
    listed = spark.createDataFrame([("spam-farm.example.org",), (None,), ("not.seen",)], "key string")
    found = [(r.page_id, r.host[:20], r.path, r.rule, r.verdict) for r in url_filter.judge(pages, listed).collect()]
    assert sorted(found, key=str) == sorted(
        [(None, "", "", None, "allow"), (1, "", "", None, "allow"), (2, "a.example.net", "/en/x", "example.net/en/", "allow"),
         (2, "a.example.net", "/en/x", "example.net/en/", "allow"), (3, "example.net", "", None, "allow"),
         (4, "www.spam-farm.exampl", "/a", None, "block"), (5, "", "", None, "allow"), (6, ".net", "/", "net/", "block"),
         (7, "a." * 10, "/fr/", "org/fr/", "allow")],
        key=str,
    )
    assert url_filter.judge(pages.limit(0), listed.limit(0)).collect() == []


def test_cascade_is_exact_for_the_whole_universe(spark):
    keys = spark.range(20000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = keys.where("xxhash64(key) % 7 = 0")
    levels = url_filter.build(keys, listed).levels
    assert len(levels) > 1 and sum(bits for _, bits, _ in levels) < 40 * listed.count()
    a, b = url_filter.key_hashes(F.col("key"))
    import numpy as np

    rows_ = keys.join(listed.withColumn("on", F.lit(True)), "key", "left").select(a.alias("a"), b.alias("b"), "on").toPandas()
    found = url_filter.Cascade(levels).contains(rows_.a.to_numpy(np.int64), rows_.b.to_numpy(np.int64))
    assert (found == rows_.on.notna().to_numpy()).all()
