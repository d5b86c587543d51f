"""Benchmark items in documents, found by a CGK embedding and bit-sampling LSH, verified by edit distance.

Texts are words (runs of letters and digits, lower case). An item leaks where a stretch of a document is
within ``MAX_EDITS`` of its words in edit distance. The CGK random walk copies the current word of a
sequence and moves on or stays, as a random bit of (step, word) says; sequences within a few edits fall
back into step, so that their walks agree at many places. Each LSH table samples a few places of a
walk; windows of a document meet items with the same sample. Every
candidate is verified by exact word edit distance (bit-parallel, free ends).

Items are in classes by size, and each class has windows of its own: they begin at every ``stride``-th word of a text,
so that one begins near any item, however its ends are edited and whatever is around it, and where a known trigram is
the first of an item. The walk sees little of what is behind an item, so windows need no exact end.
They are taken only where an item of the class can be: by the q-gram lemma a stretch within k edits of an item of n
words shares n - 2 - 3k word trigrams with it. The trigrams of all items are known to the
tasks as a bitmap with ``BITS_PER_GRAM`` bits for each different one, up to ``MOST_GRAM_BITS``; it links no window to an
item. Behind that size it fills up: false hits then make surplus windows, but as windows begin at every few words inside
a run of hits too, none is lost. Windows and samples that no item has are left out by a like bitmap of the items' samples.
Items and windows meet in an equi-join on the sample, so the benchmark may be of any size; nothing is kept per document but its windows.

Recall of the LSH depends on the edits: see ``tests/llm/test_decontam.py``, which holds it to 0.9 or more
against brute force.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.storage import bitmap, has_bit, stored
from fleetlens.llm.text import Prefixes, keyed, mix, same_document, slices
from fleetlens.llm.tokens import Words

GRAM = 3
LEAST_GRAM_BITS, MOST_GRAM_BITS = 1 << 23, 1 << 28
BITS_PER_GRAM = 32
MIN_ITEM_WORDS = 8
MAX_EDITS = 0.2
GROWTH = 1.25
MAX_STRIDE = 4
STEPS_AT_ONCE = 1 << 22
WALKS, TABLES_PER_WALK, SAMPLED = 6, 10, 3
SEED = 0xC6A4A7935BD1E995


def allowed_edits(n_words: int, share: float = MAX_EDITS) -> int:
    return int(n_words * share)


def size_class(n_words: np.ndarray) -> np.ndarray:
    """Items and windows are compared in classes of sizes; one is ``GROWTH`` times the one before."""
    return np.floor(np.log(np.maximum(n_words, 1) / MIN_ITEM_WORDS) / np.log(GROWTH) + 1e-9).astype(np.int64)


def sampled_places(size: int) -> np.ndarray:
    """Places of the walks that the tables of a class look at: [walk, table, sample]."""
    dice = np.random.default_rng(1000 + size)
    length = max(2, int(2 * MIN_ITEM_WORDS * GROWTH**size))
    return dice.integers(0, length, (WALKS, TABLES_PER_WALK, SAMPLED))


def samples(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray, *sizes: np.ndarray) -> np.ndarray:
    """LSH keys [sequence, table] of runs of word hashes, embedded once and sampled for each of the given classes."""
    tables = WALKS * TABLES_PER_WALK
    out = np.zeros((len(begin), tables * len(sizes)), np.uint64)
    if not len(begin):
        return out
    padded = np.append(hashes, np.uint64(0))
    places = {int(size): sampled_places(int(size)) for size in np.unique(np.concatenate(sizes))}
    for walk in range(WALKS):
        at = begin.copy()
        symbols = np.zeros((max(int(p[walk].max()) for p in places.values()) + 1, len(begin)), np.uint64)
        for step in range(len(symbols)):
            over = at >= end
            if over.all():
                break  # behind the end all symbols are 0
            word = np.where(over, np.uint64(0), padded[np.minimum(at, len(hashes))])
            symbols[step] = word
            dice = mix(word + np.uint64(SEED * (walk * 4096 + step + 1) % (1 << 64)))
            at += (dice & np.uint64(1)).astype(np.int64) & ~over
        number = np.arange(walk * TABLES_PER_WALK, (walk + 1) * TABLES_PER_WALK)
        for turn, wanted in enumerate(sizes):
            for size in np.unique(wanted):
                which = np.flatnonzero(wanted == size)
                seen = symbols[places[int(size)][walk]][:, :, which]  # [table, sample, sequence]
                key = np.repeat(((int(size) + 64) * 1000 + number).astype(np.uint64)[:, None], len(which), axis=1)
                for sample in range(SAMPLED):
                    key = mix(key * np.uint64(SEED) + seen[:, sample])
                out[which[:, None], turn * tables + number[None, :]] = key.T
    return out


class SizeClass(NamedTuple):
    """What the windows of a class need: see ``classes_of``."""

    number: int
    stride: int
    reach: int
    needed: int
    margin: int
    steps: int


def classes_of(sizes: list[int]) -> list[SizeClass]:
    """The classes of items of these sizes.

    A window begins at every ``stride``-th word, and holds an item of the class, edited, in ``reach`` words from
    there. ``needed`` trigrams at least are shared with it. An item can begin ``margin`` words before or end as
    much behind. The walk takes ``steps`` steps.
    """
    n = np.unique(np.array(sizes, np.int64))
    edits = np.array([allowed_edits(int(x)) for x in n], np.int64)
    number = size_class(n)
    out = []
    for size in np.unique(number).tolist():
        own = number == size
        stride = int(np.clip(n[own][0] // 8, 2, MAX_STRIDE))
        needed = max(1, int((n - (GRAM - 1) - GRAM * edits)[own].min()))
        margin = 2 * int(edits[own].max()) + GRAM + stride
        out.append(SizeClass(size, stride, int((n + edits)[own].max()), needed, margin, int(sampled_places(size).max()) + 1))
    return out


def windows_of(hits: np.ndarray, begins: np.ndarray, doc: np.ndarray, first: np.ndarray, sizes: list[SizeClass]) -> Iterator[tuple[SizeClass, np.ndarray]]:
    """By class, the words at which windows begin that may hold an item.

    ``hits`` marks the words at which a known trigram begins, ``begins`` those where it is the first of an item;
    ``doc`` has the text of each word and ``first`` the bounds of the texts.
    """
    sums = np.concatenate(([0], np.cumsum(hits)))
    last = len(hits)

    def shared(word: np.ndarray, before: int, after: int) -> np.ndarray:
        a = np.minimum(np.maximum(word - before, first[doc[word]]), last)
        b = np.minimum(word + after, first[doc[word] + 1]) - (GRAM - 1)
        return sums[np.maximum(b, a)] - sums[a]

    farthest = max(size.reach + size.stride for size in sizes)
    near = np.flatnonzero(shared(np.arange(len(doc)), MAX_STRIDE, farthest) >= min(size.needed for size in sizes))
    opens = np.append(hits & begins, np.zeros(len(doc) - last, bool))[near]
    place = near - first[doc[near]]
    for size in sizes:
        some = near[opens | (place % size.stride == 0)]
        yield size, some[shared(some, size.stride, size.reach + size.stride) >= size.needed]


def grams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the trigrams that begin at each word, and which of them lie in one text."""
    whole = words.whole()
    n = max(len(whole) - GRAM + 1, 0)
    at = np.arange(n)
    hashes = (Prefixes(whole).run(at, at + GRAM) >> np.uint64(1)).astype(np.int64) if n else np.zeros(0, np.int64)
    return hashes, words.doc[:n] == words.doc[GRAM - 1 :] if n else np.zeros(0, bool)


def bits_for(n_grams: int) -> int:
    """Bits of the bitmap for so many different trigrams: a power of two."""
    wanted = 1 << max(BITS_PER_GRAM * n_grams - 1, 1).bit_length()
    return min(max(wanted, LEAST_GRAM_BITS), MOST_GRAM_BITS)


def _spelled(words: Words, begin: np.ndarray, end: np.ndarray) -> list[str]:
    """Runs of words as text, one space between them."""
    points = words.lower
    out = []
    for a, b in zip(begin.tolist(), end.tolist()):
        pieces = [points[s:e].tobytes().decode("utf-32-le") for s, e in zip(words.starts[a:b].tolist(), words.ends[a:b].tolist())]
        out.append(" ".join(pieces))
    return out


def edit_match(item: list[str], text: list[str]) -> tuple[int, int]:
    """The least word edit distance of ``item`` to any stretch of ``text``, and the first end of such a stretch.

    Bit-parallel over the item's words, one step for each word of the text.
    """
    n = len(item)
    full, top = (1 << n) - 1, 1 << (n - 1)
    where: dict[str, int] = {}
    for i, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << i
    plus, minus, distance = full, 0, n
    best, end = n, 0
    for j, w in enumerate(text):
        equal = where.get(w, 0)
        diagonal = (((equal & plus) + plus) ^ plus) | equal | minus
        up, down = minus | (full & ~(diagonal | plus)), plus & diagonal
        distance += bool(up & top) - bool(down & top)
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(diagonal | up)), up & diagonal
        if distance < best:
            best, end = distance, j + 1
    return best, end


def _items(benchmark: DataFrame, key: str, text: str) -> DataFrame:
    """``(item_id, body, n, bits, keys)``: items of enough words, their trigrams and LSH keys."""

    def prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"))
                n = np.diff(words.first)
                which = np.flatnonzero(n >= MIN_ITEM_WORDS)
                begin, end = words.first[which], words.first[which + 1]
                hashes, _ = grams(words)
                keys = samples(words.whole(), begin, end, size_class(n[which]))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("item_id").take(pa.array(which)),
                        pa.array(_spelled(words, begin, end), pa.string()),
                        pa.array(n[which]),
                        pa.array([hashes[a : b - GRAM + 1] for a, b in zip(begin, end)], pa.list_(pa.int64())),
                        pa.array(list(keys.view(np.int64)), pa.list_(pa.int64())),
                    ],
                    ["item_id", "body", "n", "grams", "keys"],
                )

    rows = benchmark.select(F.col(f"`{key}`").cast("long").alias("item_id"), F.col(f"`{text}`").cast("string").alias("text"))
    made = rows.distinct().mapInArrow(prepared, "item_id long, body string, n long, grams array<long>, keys array<long>")
    return stored(made, "items")


def leaks(
    docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    gram_bits: int | None = None,
) -> DataFrame:
    """``(doc_id, th, item_id, distance, n_item_words, first_word, end_word)``: the best place of each item in each document.

    An item is in a document if some stretch of its words is within ``MAX_EDITS`` of the item's words, rounded
    down. Items of under ``MIN_ITEM_WORDS`` words are too short to tell and never match; null texts have no
    words; null ids are returned as they are. Words are counted from 0. Of equally good places the first
    counts. Documents equal in id and text are one; items equal in id and text are one. ``gram_bits`` is the size of
    the bitmap of known trigrams, by default set from their number.
    """
    items = _items(benchmark, item_key, item_text)
    sizes = classes_of([row.n for row in items.select("n").distinct().collect()])
    schema = "doc_id long, th long, first int, size int, margin int, body string, keys array<long>"
    rows = keyed(docs, key=key, text=text)
    if not sizes:
        return rows.limit(0).select(
            "doc_id", "th", F.lit(0).cast("long").alias("item_id"), F.lit(0).alias("distance"),
            F.lit(0).cast("long").alias("n_item_words"), F.lit(0).alias("first_word"), F.lit(0).alias("end_word"),
        )
    all_grams = items.select(F.explode("grams").alias("gram"))
    gram_bits = gram_bits or bits_for(all_grams.agg(F.approx_count_distinct("gram")).first()[0])
    known = bitmap(all_grams.select((F.col("gram") % gram_bits).alias("bit")), "bit", gram_bits)
    all_keys = items.select(F.explode("keys").alias("key"))
    key_bits = bits_for(all_keys.count())
    met_by_items = bitmap(all_keys.select(F.pmod("key", F.lit(key_bits)).alias("bit")), "bit", key_bits)
    opening = bitmap(items.select((F.element_at("grams", 1) % gram_bits).alias("bit")), "bit", gram_bits)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"))
                hashes, inside = grams(words)
                bits = hashes % gram_bits
                hits = has_bit(known, bits) & inside
                bounds, whole = words.first, words.whole()
                for size, begins in windows_of(hits, has_bit(opening, bits), words.doc, bounds, sizes):
                    block = max(1, STEPS_AT_ONCE // size.steps)
                    for begin in (begins[at : at + block] for at in range(0, len(begins), block)):
                        end = np.minimum(begin + size.steps, bounds[words.doc[begin] + 1])
                        keys = samples(whole, begin, end, np.full(len(begin), size.number))
                        meets = has_bit(met_by_items, (keys % np.uint64(key_bits)).astype(np.int64))
                        some = meets.any(axis=1)
                        begin, keys, meets = begin[some], keys[some].view(np.int64), meets[some]
                        doc = words.doc[begin]
                        low = np.maximum(begin - size.margin, bounds[doc])
                        high = np.minimum(begin + size.reach + size.margin, bounds[doc + 1])
                        rows = pa.array(doc)
                        yield pa.RecordBatch.from_arrays(
                            [
                                part.column("doc_id").take(rows), part.column("th").take(rows),
                                pa.array((begin - bounds[doc]).astype(np.int32)), pa.array(np.full(len(begin), size.number, np.int32)),
                                pa.array((begin - low).astype(np.int32)), pa.array(_spelled(words, low, high), pa.string()),
                                pa.array([k[m] for k, m in zip(keys, meets)], pa.list_(pa.int64())),
                            ],
                            ["doc_id", "th", "first", "size", "margin", "body", "keys"],
                        )

    windows = stored(rows.mapInArrow(cut, schema), "windows")
    place = ("doc_id", "th", "first", "size")
    probes = windows.select(*place, F.explode("keys").alias("key"))
    index = items.select("item_id", F.explode("keys").alias("key"))
    met = probes.join(index, "key").select(*place, "item_id").distinct()
    met = met.alias("m").join(windows.alias("w"), same_document("m", "w") & (F.col("m.first") == F.col("w.first")) & (F.col("m.size") == F.col("w.size")))
    pairs = met.join(items.alias("i"), F.col("m.item_id").eqNullSafe(F.col("i.item_id"))).select(
        "m.doc_id", "m.th", "m.first", "w.margin", "w.body", "i.item_id", F.col("i.body").alias("item")
    ).distinct()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, found = [], []
            columns = (batch.column(c).to_pylist() for c in ("body", "item", "first", "margin"))
            for row, (body, item, first, before) in enumerate(zip(*columns)):
                a, b = item.split(" "), body.split(" ")
                distance, end = edit_match(a, b)
                if distance <= allowed_edits(len(a)):
                    _, back = edit_match(a[::-1], b[:end][::-1])
                    keep.append(row)
                    found.append((distance, len(a), first - before + end - back, first - before + end))
            some = batch.take(pa.array(keep, pa.int64()))
            made = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("doc_id", "th", "item_id")), *made], names)

    names = ["doc_id", "th", "item_id", "distance", "n_item_words", "first_word", "end_word"]
    good = pairs.mapInArrow(verify, "doc_id long, th long, item_id long, distance int, n_item_words long, first_word int, end_word int")
    best = good.groupBy("doc_id", "th", "item_id").agg(F.min(F.struct("distance", "first_word", "end_word", "n_item_words")).alias("b"))
    return best.select("doc_id", "th", "item_id", "b.distance", "b.n_item_words", "b.first_word", "b.end_word")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no item was found, with all columns."""
    th = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    found = leaks(docs, benchmark).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).distinct()
    return docs.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (th == F.col("__th")), "left_anti")
