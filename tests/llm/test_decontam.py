"""Recall of the decontamination by item size and surroundings, at the largest allowed number of edits."""

import random

from fleetlens.llm import decontam

LETTERS = "aeioulnrst"


def words(dice, n):
    return ["".join(dice.choice(LETTERS) for _ in range(9)) for _ in range(n)]


def edited(dice, item, places):
    return [*(words(dice, 1)[0] if i in places else w for i, w in enumerate(item))]


def found(spark, texts, items, **more):
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    benchmark = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in decontam.leaks(docs, benchmark, **more).collect()}


def test_recall_by_item_size(spark):
    dice = random.Random(5)
    items = [words(dice, n) for n in (8, 10, 12, 15, 20, 30, 50) for _ in range(60)]
    texts = [
        words(dice, 30) + edited(dice, t, dice.sample(range(len(t)), decontam.allowed_edits(len(t)))) + words(dice, 30) for t in items
    ]
    got = found(spark, texts, items)
    assert got <= {(i, i) for i in range(len(items))}
    for begin in range(0, len(items), 60):
        assert len(got & {(i, i) for i in range(begin, begin + 60)}) >= 0.9 * 60, len(items[begin])
    least = min(i for i, t in enumerate(items) if len(t) == 15)
    assert {p for p in got if p[1] >= least} == {(i + least, j + least) for i, j in found(spark, texts[least:], items[least:])}


def test_edits_at_the_ends(spark):
    item = words(random.Random(6), 10)
    around = words(random.Random(7), 40)
    cases = [(0, 1), (8, 9), (1, 8), (2, 7), (0, 9), (2, 5)]
    texts = [around[:20] + edited(random.Random(i), item, c) + around[20:] for i, c in enumerate(cases)]
    assert found(spark, texts, [item]) == {(i, 0) for i in range(len(cases))}


def test_items_inside_longer_items(spark):
    dice = random.Random(8)
    short = [words(dice, n) for n in (10, 15, 20, 30) for _ in range(20)]
    variants = [edited(dice, t, [0, 1, 2][: decontam.allowed_edits(len(t))] if i % 2 else [len(t) - 2, len(t) - 1]) for i, t in enumerate(short)]
    long = [words(dice, 40) + v + words(dice, 40) for v in variants]
    texts = [words(dice, 20) + t + words(dice, 20) for t in long]
    items = short + long
    expected = {(i, i) for i in range(80)} | {(i, i + 80) for i in range(80)}
    got = found(spark, texts, items)
    assert got <= expected and len(got) >= 0.95 * len(expected)
    assert {p for p in expected if p[1] >= 80} <= got


def test_a_full_bitmap_loses_nothing(spark):
    dice = random.Random(9)
    items = [words(dice, n) for n in (8, 10, 15, 30) for _ in range(40)]
    texts = [words(dice, 30) + edited(dice, t, dice.sample(range(len(t)), decontam.allowed_edits(len(t)))) + words(dice, 30) for t in items]
    plain = found(spark, texts, items)
    assert plain <= found(spark, texts, items, gram_bits=1 << 11) and len(plain) >= 0.95 * len(items)


def test_the_bitmap_grows_with_the_trigrams():
    assert decontam.bits_for(0) == decontam.bits_for(10_000) == 1 << 23
    assert decontam.bits_for(1_000_000) == 1 << 25 and decontam.bits_for(10**9) == 1 << 28
