"""Pieces against the tokenizer library, bins against simple bounds, and cases of the rows."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import path
from pyspark.errors import PythonException, SparkRuntimeException
from tokenizers import Tokenizer

from fleetlens.llm import packing, queries

WORDS = path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
ALPHABET = list("abAB 12 .,'st\n\t\x0b\x0c\r\x1c\x85\xa0 é́ÉßΣς漢😀İͅ") + ["<|endoftext|>", "don't "]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.one_of(st.sampled_from(ALPHABET), st.characters(exclude_categories=["Cs"])), max_size=30).map("".join)), max_size=4))
def test_ids_word_by_word_are_the_library_s(library, texts):
    ids, bounds = packing.encoded(pa.array(texts, pa.string()), packing.word_ids(WORDS), 1)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [ids_of(library, t) for t in texts]


def test_ids_do_not_depend_on_the_cache(library, monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 3)
    words = packing.WordIds(WORDS)
    for text in ("one two three four five six", "x" * 200 + " one", "six five four"):
        ids, _ = packing.encoded(pa.array([text]), words, 1)
        assert ids.tolist() == ids_of(library, text)


def filled(lengths, bins):
    return np.bincount(bins, lengths).astype(int)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=60), st.sampled_from([40, 41, 60]))
def test_exchanges_keep_pieces_and_never_add_bins(lengths, limit):
    lengths = np.array(lengths)
    first = packing.best_fit(lengths, limit)
    then = packing.improved(lengths, first, limit)
    before, after = filled(lengths, first), filled(lengths, then)
    assert after.max() <= limit and after.sum() == lengths.sum()
    assert (after > 0).sum() <= (before > 0).sum()
    assert (after**2).sum() >= (before**2).sum()


@pytest.mark.parametrize("lengths, bins, limit, least", [
    ([6, 5, 5, 4], [0, 0, 1, 1], 11, 2),  # best already
    ([7, 3, 4, 6], [0, 1, 2, 3], 10, 2),  # moves
    ([6, 3, 7, 2, 1], [0, 0, 1, 1, 2], 10, 2),  # a move fills the second bin
    ([5, 4, 6, 3, 2], [0, 0, 1, 1, 2], 10, 2),  # one for one before the move
    ([3, 6, 2, 2, 7], [0, 0, 1, 1, 2], 10, 2),  # several exchanges, of fuller bins too
    ([8, 4, 4, 4, 4, 4, 2], [0, 1, 1, 2, 2, 3, 3], 10, 4),  # the least possible is above the bound
])
def test_exchanges_empty_bins(lengths, bins, limit, least):
    lengths = np.array(lengths)
    assert (filled(lengths, packing.improved(lengths, np.array(bins), limit)) > 0).sum() == least


def test_each_kind_of_exchange_is_found():
    def one(lengths, bins, giver):
        lengths, bins = np.array(lengths), np.array(bins)
        gain, given, got, other = packing._exchange(lengths, bins, filled(lengths, bins), giver, 10)
        return gain, sorted(int(lengths[p]) for p in given if p >= 0), sorted(int(lengths[p]) for p in got if p >= 0), other

    assert one([9, 1], [0, 1], 1) == (1, [1], [], 0)
    assert one([4, 5, 5], [0, 0, 1], 1) == (1, [5], [4], 0)
    assert one([4, 5, 2, 3], [0, 0, 1, 1], 1) == (1, [2, 3], [4], 0)
    assert one([2, 2, 5, 5], [0, 0, 0, 1], 1) == (1, [5], [2, 2], 0)


def test_query_holds_every_token_once(spark, library):
    rows = queries.op13_best_fit_packing(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    total = 0
    want = Counter()
    for doc, text in texts.items():
        ids = np.array(ids_of(library, text), "<u4")
        total += len(ids)
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[doc, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    check_sequences(rows, 4096)
    assert len({r.sequence_id for r in rows}) <= -(-total // 4096) + 1


def check_sequences(rows, limit):
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= limit
    return at


def test_many_shards_and_rounds(spark):
    """Small shards need three rounds; the result stays near the bound."""
    rng = np.random.default_rng(5)
    lengths = np.concatenate((rng.integers(1, 60, 3000), rng.integers(1, 100, 1000), np.full(200, 100))).tolist()
    frame = spark.createDataFrame([(i, n, "x", 7) for i, n in enumerate(lengths)], "doc_id long, length int, sequence_id string, bins int").repartition(4)
    rows = packing.pack(frame, limit=100, bins=16, fan=4).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(lengths))) and rows[0].bins == 7
    fills = check_sequences(rows, 100)
    assert len(fills) <= 1.01 * sum(lengths) / 100 + 1


def test_rows_of_every_kind(spark):
    docs = spark.createDataFrame(
        [(None, None, 1), (None, "a b", 1), (1, "", 1), (2, "same", 1), (2, "same", 1), (3, "word " * 9000, 1)], "doc_id long, text string, length int"
    ).repartition(2)
    rows = packing.pack(packing.pieces(docs, WORDS)).collect()
    found = sorted(((r.doc_id, r.piece, r.start, r.length) for r in rows), key=repr)
    assert found == sorted([(None, 0, 0, 1), (None, 0, 0, 3), (1, 0, 0, 1), (2, 0, 0, 2), (2, 0, 0, 2), (3, 0, 0, 4096), (3, 1, 4096, 4096), (3, 2, 8192, 809)], key=repr)
    assert len(check_sequences(rows, 4096)) == 3
    assert packing.pack(packing.pieces(docs.limit(0), WORDS)).collect() == []


def test_sequences_hold_the_ids(spark, library):
    texts = {1: "one two", 2: None, 3: "word " * 30}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    packed = packing.pack(packing.pieces(docs, WORDS, limit=16, with_ids=True), limit=16)
    whole = {r.sequence_id: np.frombuffer(r.ids, "<u4") for r in packing.sequences(packed).collect()}
    back = {}
    for r in sorted(packed.collect(), key=lambda r: (r.doc_id, r.piece)):
        back.setdefault(r.doc_id, []).extend(whole[r.sequence_id][r.offset : r.offset + r.length].tolist())
    assert back == {d: ids_of(library, t) for d, t in texts.items()}


@pytest.mark.parametrize("length", [None, 0, 101])
def test_lengths_out_of_range_are_errors(spark, length):
    frame = spark.createDataFrame([(1, length), (2, 5)], "doc_id long, length int")
    with pytest.raises((PythonException, SparkRuntimeException, Exception), match="1 to 100 tokens"):
        packing.pack(frame, limit=100)
