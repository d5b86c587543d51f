"""Periodic runs of words: stretches that repeat one block over and over.

The words of a slice of documents become numbers, and one suffix array is sorted over all of
them by prefix doubling; equal words of different documents count as different, so that no group
of suffixes reaches over a document's end. Every doubling round keeps the groups it began with: two
suffixes of one group agree on so many words. Walking these groups from long to short gives the
common prefixes of neighbours, and later how far two places agree to the left.

A pair of places ``i`` and ``i + d`` that agree on ``d`` words and no more is a square of period
``d`` at the right end of a run, and both places lie in one interval of the suffix array whose
common prefix is ``d``, under different children. So for each interval the suffixes
of all children but the largest look up the places ``d`` before and after them in the inverse suffix
array; each is looked at as often as sizes can double. Intervals are found as the next smaller
values around each common prefix; no tree is built. A square found is moved to the left as long as
words agree, which gives the run; squares of several periods in one run end at the same bounds,
and the least period names the run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.text import SPACE, slices, text_buffer, widened, word_spans

MIN_LENGTH = 6  # words of a run
MIN_EXPONENT = 4  # times the period


def word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word; equal numbers are equal words, byte by byte."""
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    body = data[~SPACE[data]]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(body.tobytes())])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


def _spans(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers in the half-open spans, one after the other, and the span that each is of."""
    size = end - begin
    which = np.repeat(np.arange(len(begin)), size)
    inside = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
    return begin[which] + inside, which


class Suffixes:
    """The suffixes of sequences of numbers, in an order in which common prefixes stand together.

    ``bounds`` are the bounds of the sequences. ``levels[k]`` has the slots of the suffix array
    whose suffix shares its first 2**k words with another, and the first slot of its group.
    """

    def __init__(self, values: np.ndarray, bounds: np.ndarray) -> None:
        self.n = n = len(values)
        sequence = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        key = sequence * (int(values.max(initial=0)) + 1) + values
        order = np.argsort(key, kind="stable")
        self.order, self.slot = order, np.empty(n + 1, np.int64)
        self.slot[n] = -1
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        slots, key, reach = np.arange(n), key[order], 1
        while len(slots):
            fresh = np.ones(len(slots) + 1, bool)
            fresh[1:-1] = key[1:] != key[:-1]
            first = np.flatnonzero(fresh[:-1])
            group = np.repeat(slots[first], np.diff(np.append(first, len(slots))))
            self.slot[order[slots]] = group
            shared = ~(fresh[:-1] & fresh[1:])
            slots, group = slots[shared], group[shared]
            if not len(slots):
                break
            self.levels.append((slots.astype(np.int32), group.astype(np.int32)))
            suffixes = order[slots]
            key = group * (n + 1) + self.slot[np.minimum(suffixes + reach, n)] + 1
            by = np.argsort(key, kind="stable")
            order[slots], key = suffixes[by], key[by]
            reach *= 2
        self.slot[order] = np.arange(n)
        self._groups = np.full(n + 1, -1, np.int32)

    def descending(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """From the longest: prefix length, slots, and the groups of all places; -1 where a prefix stands alone."""
        for k in range(len(self.levels) - 1, -1, -1):
            slots, group = self.levels[k]
            places = self.order[slots]
            self._groups[places] = group
            yield 1 << k, slots, self._groups
            self._groups[places] = -1

    def common(self) -> np.ndarray:
        """Words that the suffix of each slot has in common with the one before; 0 at both ends."""
        out = np.zeros(self.n + 1, np.int64)
        for length, slots, groups in self.descending():
            slots = slots[slots > 0]
            have = out[slots]
            left = groups[np.minimum(self.order[slots - 1] + have, self.n)]
            right = groups[np.minimum(self.order[slots] + have, self.n)]
            out[slots[(left == right) & (left >= 0)]] += length
        return out

    def agreeing_before(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """How many words just before the places ``left`` and ``right`` agree."""
        out = np.zeros(len(left), np.int64)
        for length, _, groups in self.descending():
            a, b = left - out - length, right - out - length
            fits = (a >= 0) & (groups[np.maximum(a, 0)] == groups[np.maximum(b, 0)]) & (groups[np.maximum(a, 0)] >= 0)
            out[fits] += length
        return out


def next_smaller(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each index in ``at``: the first later index with a smaller value. The last value is below all others.

    Minima of blocks of two, four and more values are walked up until one holds a smaller value, then down.
    """
    tree = [values]
    while len(tree[-1]) > 1:
        low = tree[-1]
        if len(low) % 2:
            low = np.append(low, np.iinfo(np.int64).max)
        tree.append(low.reshape(-1, 2).min(axis=1))
    wanted, block = values[at], at + 1
    height = np.zeros(len(at), np.int64)
    walking = np.arange(len(at))
    for k, low in enumerate(tree):
        odd = (block[walking] & 1).astype(bool) | (len(low) == 1)
        hit = np.zeros(len(walking), bool)
        hit[odd] = low[np.minimum(block[walking[odd]], len(low) - 1)] < wanted[walking[odd]]
        height[walking[hit]] = k
        walking = walking[~hit]
        block[walking] = (block[walking] + 1) >> 1
        if not len(walking):
            break
    for k in range(int(height.max(initial=0)) - 1, -1, -1):
        down = np.flatnonzero(height > k)
        child = block[down] * 2
        block[down] = child + ~(tree[k][child] < wanted[down])
    return block


def squares(suffixes: Suffixes, least: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods of squares that the word after them ends, for all runs of the ``least`` length and exponent.

    A run puts so many of its suffixes into its interval as periods fit in it, so smaller intervals are left out.
    """
    common = suffixes.common()
    edge = np.flatnonzero(common > 0)
    guarded = np.append(common, -1)
    after = next_smaller(guarded, edge)
    before = suffixes.n + 1 - next_smaller(np.concatenate((guarded[:-1][::-1], [-1])), suffixes.n - edge) - 1
    depth = common[edge]
    keep = after - before >= np.maximum(least[0], least[1] * depth) // depth
    edge, before, after, depth = edge[keep], before[keep], after[keep], depth[keep]
    by = np.lexsort((edge, after, before))
    edge, before, after, depth = edge[by], before[by], after[by], depth[by]
    # Children of an interval: before its first edge, between its edges, after its last one.
    new = np.ones(len(edge) + 1, bool)
    new[1:-1] = (before[1:] != before[:-1]) | (after[1:] != after[:-1])
    first = np.flatnonzero(new[:-1])
    begin = np.concatenate((before[first], edge))
    nearer = np.append(edge[1:], 0) if len(edge) else edge
    end = np.concatenate((edge[first], np.where(new[1:], after, nearer)))
    interval = np.concatenate((np.arange(len(first)), np.cumsum(new[:-1]) - 1))
    by = np.lexsort((begin, begin - end, interval))  # the largest child of each interval comes first, and is left out
    small = by[np.concatenate(([False], interval[by][1:] == interval[by][:-1]))] if len(by) else by
    begin, end, interval = begin[small], end[small], interval[small]
    low, high, period = before[first][interval], after[first][interval], depth[first][interval]
    slots, child = _spans(begin, end)
    place, d = suffixes.order[slots], period[child]

    def meets(other: np.ndarray) -> np.ndarray:
        inside = (other >= 0) & (other < suffixes.n)
        slot = suffixes.slot[np.where(inside, other, suffixes.n)]
        return inside & (slot >= low[child]) & (slot < high[child]) & ~((slot >= begin[child]) & (slot < end[child]))

    forward, back = meets(place + d), meets(place - d)
    found = np.concatenate((place[forward], (place - d)[back])), np.concatenate((d[forward], d[back]))
    one = np.unique(found[0] * (suffixes.n + 1) + found[1])
    return one // (suffixes.n + 1), one % (suffixes.n + 1)


def runs_of(values: np.ndarray, bounds: np.ndarray, least: tuple[int, int] = (MIN_LENGTH, MIN_EXPONENT)) -> np.ndarray:
    """Rows of begin, end and least period of all runs, in order; places count through all sequences."""
    if not len(values):
        return np.zeros((0, 3), np.int64)
    suffixes = Suffixes(values, bounds)
    place, period = squares(suffixes, least)
    begin = place - suffixes.agreeing_before(place, place + period)
    end = place + 2 * period
    long = end - begin >= np.maximum(least[0], least[1] * period)
    found = np.stack((begin[long], end[long], period[long]), axis=1)
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    one = np.ones(len(found), bool)
    one[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    found = found[one]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _kept_text(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, offsets: np.ndarray, kept: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    if not len(data):
        return pa.array([""] * (len(offsets) - 1), pa.string())
    change = np.zeros(len(data) + 1, np.int8)
    change[starts[kept]] += 1  # texts may touch: one word's end is another's start
    change[ends[kept]] -= 1
    stays = np.cumsum(change[:-1], dtype=np.int8).astype(bool)
    which = np.flatnonzero(kept)
    text = np.searchsorted(first, which, side="right")
    stays[ends[which[:-1][text[1:] == text[:-1]]]] = True
    body = data[stays]
    body[SPACE[body]] = 0x20
    size = np.concatenate(([0], np.cumsum(stays)))[offsets].astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(size.tobytes()), pa.py_buffer(body.tobytes())])


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def found_in(texts: pa.Array, least: tuple[int, int]) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Number of words, runs and collapsed text of each text."""
    data, offsets = text_buffer(texts)
    starts, ends, first = word_spans(data, offsets)
    found = runs_of(word_numbers(data, starts, ends), first, least)
    change = np.zeros(len(starts) + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 1], -1)
    kept = np.cumsum(change[:-1]) == 0
    text = np.searchsorted(first, found[:, 0], side="right") - 1
    parts = [found[:, 0] - first[text], found[:, 1] - found[:, 0], found[:, 2]]
    per_text = np.searchsorted(text, np.arange(len(offsets))).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(per_text), pa.StructArray.from_arrays([pa.array(p, pa.int64()) for p in parts], fields=list(RUN)))
    return pa.array(np.diff(first), pa.int64()), lists, _kept_text(data, starts, ends, first, offsets, kept)


def periodic_runs(docs: DataFrame, *, text: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """Each row of ``docs`` with the runs of its text, the text itself left out.

    A run is a stretch of consecutive words (runs of characters other than space and \\x09-\\x0D) in which words
    ``period`` apart are equal, of at least ``min_length`` words and ``min_exponent`` (2 or more) periods, that
    no neighbouring word extends; ``period`` is the least such number. New columns: ``n_words``; ``runs``, an
    array of start (counted from 0), length and period in order of start, then period; ``collapsed``, the words
    joined by one space, without those that a run holds after its first period.

    A null or empty text has no words, no runs and an empty collapsed text. Rows are judged one by one, so
    repeated rows give repeated results and nothing but a row's own text matters. Columns of these names in
    ``docs`` are replaced. Work and memory of a task grow with a slice of documents or the longest single text, with n log n.
    """
    if min_exponent < 2:
        raise ValueError("a run has two periods at least")
    new = ("n_words", "runs", "collapsed")
    rest = docs.withColumn(text, F.col(f"`{text}`").cast("string")).drop(*new)
    others = [c for c in rest.columns if c != text]
    least = (min_length, min_exponent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                made = found_in(part.column(text), least)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in others], *made], [*others, *new])

    more = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return rest.mapInArrow(run, widened(rest.select(*[f"`{c}`" for c in others]), more))
