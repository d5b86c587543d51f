"""Periodic runs against a quadratic search, and cases of the texts."""

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetlens.llm import queries, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_pairs(words, least):
    """Runs by comparing all words at every distance."""
    found = {}
    for q in range(1, len(words)):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least[0], least[1] * q):
                found.setdefault((i, j - i + q), q)
            i = j
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


LOOPY = st.builds(
    lambda a, block, n, b: a + (block * 12)[:n] + b,
    st.lists(st.integers(0, 2), max_size=8), st.lists(st.integers(0, 2), min_size=1, max_size=6),
    st.integers(0, 40), st.lists(st.integers(0, 2), max_size=8),
)


@settings(max_examples=400, deadline=None)
@given(st.lists(LOOPY, max_size=4), st.sampled_from([(6, 4), (2, 2), (1, 3)]))
def test_runs_are_those_of_all_pairs(texts, least):
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    found = runs.runs_of(np.array(sum(texts, []), np.int64), bounds, least)
    want = [(s + b, s + b + n, q) for b, t in zip(bounds, texts) for s, n, q in by_pairs(t, least)]
    assert [tuple(map(int, r)) for r in found] == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(["a", "b ", " ", "\n", "é ", "a b "]), max_size=40).map("".join)), max_size=5))
def test_collapsed_text_has_the_words_outside_repeats(texts):
    n_words, found, collapsed = runs.found_in(pa.array(texts, pa.string()), (6, 4))
    for text, n, spans, kept in zip(texts, n_words.to_pylist(), found.to_pylist(), collapsed.to_pylist()):
        words = WORD.findall(text or "")
        gone = {i for s in spans for i in range(s["start"] + s["period"], s["start"] + s["length"])}
        assert n == len(words)
        assert kept == " ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize("values, expected", [
    (np.zeros(200_000, np.int64), [[0, 200_000, 1]]),
    (np.tile(np.arange(700), 100), [[0, 70_000, 700]]),
])
def test_long_texts(values, expected):
    assert runs.runs_of(values, np.array([0, len(values)])).tolist() == expected


def test_next_smaller_value():
    rng = np.random.default_rng(3)
    for size in (1, 2, 3, 7, 64, 500):
        values = np.append(rng.integers(0, 9, size), -1)
        found = runs.next_smaller(values, np.arange(size))
        assert found.tolist() == [next(j for j in range(i + 1, size + 1) if values[j] < values[i]) for i in range(size)]


def test_rows_of_every_kind(spark):
    loop = "x " + "a b c " * 5
    rows = [(None, None, "p"), (None, loop, "p"), (1, None, "p"), (2, "", "p"), (3, " \n\t", "p"), (4, loop, "p"), (4, loop, "p"), (5, "ha " * 50_000, "p")]
    docs = spark.createDataFrame([(*r, 7, "c") for r in rows], "doc_id long, text string, runs string, n_words int, more string").repartition(3)
    found = {(r.doc_id, r.collapsed, tuple(map(tuple, r.runs)), r.n_words, r.more) for r in runs.periodic_runs(docs).collect()}
    run = ((1, 15, 3),)
    assert found == {
        (None, "", (), 0, "c"), (None, "x a b c", run, 16, "c"), (1, "", (), 0, "c"), (2, "", (), 0, "c"), (3, "", (), 0, "c"),
        (4, "x a b c", run, 16, "c"), (5, "ha", ((0, 50_000, 1),), 50_000, "c"),
    }
    assert runs.periodic_runs(docs).count() == len(rows)
    assert runs.periodic_runs(docs.limit(0)).collect() == []
    assert runs.periodic_runs(docs.select("text")).columns == ["n_words", "runs", "collapsed"]


def test_looped_texts(spark):
    docs = spark.createDataFrame([(6, "w0 w1\nw2  w3 w4 w5 w6 w7 w8 w9"), (6, None), (6, " "), (7, " a\tb "), (None, "a b")], "doc_id long, text string")
    found = [r.text for r in queries.looped(docs).collect()]
    # crc32("6") is 498629140: g = 49862914, so a = 4 of ten words and p = 1 + 6 // (3 + 2) = 2.
    assert found == ["w0 w1 w2 w3 w4 w5 w4 w5 w4 w5", None, " ", " a\tb ", "a b"]
