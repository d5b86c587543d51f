"""Removal of word windows that occur earlier in the corpus, by FM-index.

All windows of ``window`` words are compared, across the whole corpus and inside documents. Shards
hold content, not documents: the anchor of a window is the word 4-gram in it with the smallest
hash, so equal windows have equal anchors and meet in one shard. Neighbouring windows with one
anchor travel together as a segment of words. Every shard builds an FM-index of its segments whose
anchor recurs (Burrows-Wheeler transform in a wavelet matrix of packed bits); the segments of the
documents are streamed against it by backward search, one word a step, which gives for each
position the interval of the suffixes that share the next ``window`` words, the longer matches cut back to
that threshold. The interval's earliest start says whether the window starts earlier elsewhere.

Hot content: equal segments read by one task (in buffers of ``BUFFER_BYTES``) become one before the shuffle, the copies being
repeats for certain. An anchor that many different segments share (a common line in ever new
surroundings) would fill one shard: anchors that recur inside slices ``HOT_SEGMENTS`` times or more,
counted over the whole corpus, have their windows sent one by one by the hash of the window
instead. Those anchors are known to the tasks as a bitmap of ``HOT_BITS`` bits, fixed however
many there are; an anchor that shares a bit with a hot one takes the longer way, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.storage import bitmap, has_bit, stored
from fleetlens.llm.text import Prefixes, joined, keyed, mix, same_document, slices, text_buffer, word_hashes, word_spans

WINDOW = 20
GRAM = 4
DEPTH = 32
HOT_SEGMENTS = 5000
HOT_BITS = 1 << 23
SEGMENTS_PER_SHARD = 60_000
INDEX_WORDS = 400_000
BUFFER_BYTES = 40 << 20
LEVEL = 6
# How the numbers of a segment travel: anchor (24 bits are enough inside a shard), null id, id, text hash, start, windows.
PACKED = ("<u4", "u1", "<i8", "<u4", "<i4", "u1")


class Segments:
    """Segments of the words of some texts: runs of windows that share an anchor."""

    def __init__(self, texts: pa.Array, window: int, hot: np.ndarray | None = None) -> None:
        data, offsets = text_buffer(texts)
        starts, ends, self.first_word = word_spans(data, offsets)
        self.body, self.begin, self.end = joined(data, offsets, starts, ends)
        counts = np.diff(self.first_word)
        n, gram = len(starts), min(GRAM, window)
        self.anchor = np.zeros(0, np.uint64)
        self.doc = self.first = self.windows = np.zeros(0, np.int64)
        if not (counts >= window).any():
            return
        hashed = Prefixes(word_hashes(data, starts, ends))
        at = np.arange(n - gram + 1)
        grams = hashed.run(at, at + gram)
        low = np.uint64((1 << 24) - 1)  # positions in a slice; ties go to the first
        if n >= 1 << 24:
            raise ValueError("a text of more than 16 million words")
        least = (mix(grams ^ np.uint64(0xA5A5)) & ~low) | at.astype(np.uint64)
        width, have = window - gram + 1, 1
        while have < width:
            step = min(have, width - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        where = (least & low).astype(np.int64)  # of the anchor, for each window start
        doc = np.repeat(np.arange(len(counts)), counts)[: len(where)]
        inside = np.arange(len(where)) + window <= self.first_word[doc + 1]
        new = inside.copy()
        new[1:] &= ~inside[:-1] | (where[1:] != where[:-1]) | (doc[1:] != doc[:-1])
        single = np.zeros(len(where), bool)
        if hot is not None:
            single = inside & is_hot(grams[where], hot)
            new |= single
        first = np.flatnonzero(new)
        run = np.cumsum(new)[inside] - 1
        self.windows = np.bincount(run, minlength=len(first))
        self.anchor = grams[where[first]]
        alone = single[first]
        if alone.any():
            self.anchor[alone] = hashed.run(first[alone], first[alone] + window) ^ np.uint64(1)
        self.doc = doc[first]
        self.first = first

    def content(self, window: int) -> list[bytes]:
        body = self.body
        last = self.first + self.windows + window - 2
        return [body[a:b] for a, b in zip(self.begin[self.first].tolist(), self.end[last].tolist())]


def is_hot(anchors: np.ndarray, hot: np.ndarray) -> np.ndarray:
    return has_bit(hot, (anchors % np.uint64(len(hot) * 8)).astype(np.int64))


def hot_anchors(docs: DataFrame, window: int, hot: int = HOT_SEGMENTS, bits: int = HOT_BITS) -> tuple[np.ndarray | None, int]:
    """A bitmap of the anchors that recur in slices ``hot`` times or more in all, and the number of all segments."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                anchor = Segments(part.column("text"), window).anchor
                values, times = np.unique(anchor, return_counts=True)
                bit = (values % np.uint64(bits)).astype(np.int64)[times > 1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.append(bit, -1)), pa.array(np.append(times[times > 1], len(anchor)))], ["bit", "n"]
                )

    found = docs.select("text").mapInArrow(counted, "bit long, n long").groupBy("bit").agg(F.sum("n").alias("n"))
    kept = stored(found.where((F.col("bit") < 0) | (F.col("n") >= hot)), "anchors")
    total = kept.where("bit < 0").agg(F.sum("n")).first()[0] or 0
    used = kept.where("bit >= 0")
    return (None if used.isEmpty() else bitmap(used, "bit", bits)), total


class FMIndex:
    """Suffixes of a sequence of small numbers, ordered by their first ``DEPTH`` symbols.

    Only the transform is kept, as a wavelet matrix: for each bit of the symbols a packed bit vector
    with the ones counted at every 64th position.
    """

    def __init__(self, symbols: np.ndarray, window: int) -> None:
        n = len(symbols)
        rank, span, by_span = symbols.astype(np.int64), 1, {}
        while span < DEPTH:
            by_span[span] = rank
            rank = _ranked(rank, _ahead(rank, span))
            span *= 2
        self.order = np.argsort(rank, kind="stable")
        depth, group = 0, np.zeros(n, np.int64)  # ranks by the first `window` symbols
        for part in sorted(by_span, reverse=True):
            while depth + part <= window:
                group = _ranked(group, _ahead(by_span[part], depth))
                depth += part
        group = group[self.order]
        self.group_start = np.flatnonzero(np.diff(group, prepend=-1))
        self.group_of = np.cumsum(np.diff(group, prepend=-1) != 0) - 1
        self.group_end = np.append(self.group_start[1:], n)
        before = symbols[self.order - 1]
        self.levels = max(1, int(symbols.max()).bit_length())
        counts = np.bincount(symbols)
        self.less = np.concatenate(([0], np.cumsum(counts)))
        self.words, self.ones, self.zeros = [], [], []
        row = before
        for level in range(self.levels - 1, -1, -1):
            bit = (row >> level & 1).astype(bool)
            packed = np.packbits(np.append(bit, np.zeros(-n % 64 + 64, bool)), bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.ones.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64))))
            self.zeros.append(int(n - bit.sum()))
            row = np.concatenate((row[~bit], row[bit]))
        self.origin = self._descend(np.zeros(len(counts), np.int64), np.arange(len(counts)))

    def _descend(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        for i in range(self.levels):
            bit = symbol >> (self.levels - 1 - i) & 1 == 1
            block = at >> 6
            inside = self.words[i][block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            ones = self.ones[i][block] + np.bitwise_count(inside)
            at = np.where(bit, self.zeros[i] + ones, at - ones)
        return at

    def back(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Where the suffixes that begin with ``symbol`` and go on below ``at`` end: one step of backward search."""
        return self.less[symbol] + self._descend(at, symbol) - self.origin[symbol]

    def cut(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The interval of all suffixes that share the first ``window`` symbols with the one at ``low``, and its number."""
        group = self.group_of[low]
        return self.group_start[group], self.group_end[group], group


def _ahead(rank: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(rank)
    if by < len(rank):
        out[: len(rank) - by] = rank[by:] + 1
    return out


def _ranked(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Dense ranks of pairs."""
    key = first * (int(second.max(initial=0)) + 1) + second
    order = np.argsort(key)
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(np.diff(key[order], prepend=-1) != 0) - 1
    return out


def search(contents: list[bytes], earliest: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of distinct segments the earliest start of its words.

    ``earliest`` holds the (ordered) start of each segment's first occurrence. Gives the starts, one
    segment's windows after the other, and for each segment where its windows begin (one more at the end).
    """
    numbers: dict[bytes, int] = {}
    words = [c.split(b" ") for c in contents]
    sizes = np.array([len(w) for w in words])
    flat = np.fromiter((numbers.setdefault(w, len(numbers) + 1) for ws in words for w in ws), np.int64, int(sizes.sum()))
    stop = np.cumsum(sizes + 1) - 1  # each segment ends with a separator, 0
    symbols = np.zeros(int(stop[-1]) + 1, np.int64)
    inside = np.ones(len(symbols), bool)
    inside[stop] = False
    symbols[inside] = flat
    index = FMIndex(symbols, window)
    base = stop - sizes
    own = np.repeat(earliest - base, sizes + 1) + np.arange(len(symbols))
    least = np.minimum.reduceat(own[index.order], index.group_start)

    per_segment = sizes - window + 1
    bounds = np.concatenate(([0], np.cumsum(per_segment)))
    out = np.empty(int(bounds[-1]), np.int64)
    stream = np.argsort(-sizes, kind="stable")  # long ones first: those still going are a prefix
    going = -sizes[stream]
    low, high = np.zeros(len(stream), np.int64), np.full(len(stream), len(symbols), np.int64)
    for step in range(int(sizes.max())):
        some = stream[: np.searchsorted(going, -step)]
        at = stop[some] - 1 - step
        symbol = symbols[at]
        both = index.back(np.concatenate((low[: len(some)], high[: len(some)])), np.concatenate((symbol, symbol)))
        low, high = both[: len(some)], both[len(some) :]
        if step + 1 >= window:
            low, high, group = index.cut(low)
            out[bounds[some] + at - base[some]] = least[group]
    return out, bounds


class Buffer:
    """Segments of several slices, until they are packed by shard."""

    def __init__(self, window: int, shards: int) -> None:
        self.window, self.shards = window, shards
        self.numbers: list[np.ndarray] = []
        self.contents: list[bytes] = []
        self.size = 0

    def add(self, part: pa.RecordBatch, found: Segments) -> None:
        ids = part.column("doc_id")
        null = np.asarray(ids.is_null()).astype(np.int64)[found.doc]
        doc_id = np.asarray(ids.fill_null(0)).astype(np.int64)[found.doc]
        th = np.asarray(part.column("th"))[found.doc]
        spread = mix(found.anchor)
        shard = (spread % np.uint64(self.shards)).astype(np.int64)
        start = found.first - found.first_word[found.doc]
        self.numbers.append(np.stack(((spread >> np.uint64(40)).astype(np.int64), null, doc_id, th, start, found.windows, shard)))
        self.contents += found.content(self.window)
        self.size += sum(map(len, self.contents[len(self.contents) - len(start) :])) + 56 * len(start)

    def packed(self) -> pa.RecordBatch:
        """A payload for each shard: distinct segments at their earliest place, then the copies, which are repeats."""
        import zstandard

        numbers = np.concatenate(self.numbers, axis=1) if self.numbers else np.zeros((7, 0), np.int64)
        order = np.lexsort((numbers[4], numbers[3], numbers[2], numbers[1], numbers[6]))
        contents = self.contents
        seen: dict[bytes, int] = {}  # equal segments have one shard
        fresh = np.fromiter((seen.setdefault(contents[i], i) == i for i in order.tolist()), bool, len(order))
        squeeze = zstandard.ZstdCompressor(level=LEVEL).compress
        shard = numbers[6, order]
        edges = np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(order))
        names, payloads = [], []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            these, new = order[a:b], fresh[a:b]
            these = np.concatenate((these[new], these[~new]))
            rows = numbers[:6, these]
            rows[2] = np.diff(rows[2], prepend=0)
            head = np.array([len(these), new.sum()], np.int64).tobytes()
            body = b"".join(row.astype(kind).tobytes() for row, kind in zip(rows, PACKED))
            text = b"\n".join([contents[i] for i in these[: new.sum()].tolist()])
            names.append(int(shard[a]))
            payloads.append(squeeze(head + body + text))
        self.__init__(self.window, self.shards)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(payloads, pa.binary())], ["shard", "payload"])


def _unpack(payload: bytes) -> tuple[np.ndarray, int, list[bytes]]:
    """Six rows of numbers (anchor, null id, id, text hash, start, windows), how many are fresh, and their words."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(payload)
    count, fresh = np.frombuffer(raw, np.int64, 2).tolist()
    rows, at = [], 16
    for kind in PACKED:
        rows.append(np.frombuffer(raw, kind, count, at).astype(np.int64))
        at += count * np.dtype(kind).itemsize
    numbers = np.stack(rows)
    numbers[2] = np.cumsum(numbers[2])
    return numbers, fresh, raw[at:].split(b"\n") if fresh else []


def _shard_repeats(payloads: list[bytes], window: int) -> pa.Table:
    """Runs of repeated windows of one shard: the document, the first word and the end of the last window."""
    parts = [_unpack(p) for p in payloads]
    copies = np.concatenate([n[:, f:] for n, f, _ in parts], axis=1)
    rows = np.concatenate([n[:, :f] for n, f, _ in parts], axis=1)
    contents = [c for _, _, cs in parts for c in cs]
    out = [(copies[1:4], copies[4], copies[4] + copies[5] + window - 1)]

    _, which, times = np.unique(rows[0], return_inverse=True, return_counts=True)
    again = np.flatnonzero(times[which] > 1)
    again = again[np.argsort(which[again], kind="stable")]
    if len(again):
        docs = np.lexsort((rows[3], rows[2], rows[1]))
        changed = (np.diff(rows[1:4, docs], axis=1) != 0).any(axis=0)
        rank = np.empty(len(docs), np.int64)
        rank[docs] = np.concatenate(([0], np.cumsum(changed)))
        place = (rank << 32) + rows[4]
        used = np.cumsum(rows[5][again] + window)
        anchors = which[again]
        last_of_anchor = np.append(anchors[1:] != anchors[:-1], True)
        cuts, full = [0], 0
        for stop in (np.flatnonzero(last_of_anchor) + 1).tolist():  # an index takes whole anchors
            if used[stop - 1] - full >= INDEX_WORDS or stop == len(again):
                cuts.append(stop)
                full = used[stop - 1]
        for a, b in zip(cuts[:-1], cuts[1:]):
            out.append(_index_repeats(rows, contents, again[a:b], place, window))
    whose = np.concatenate([o[0] for o in out], axis=1)
    low, high = (np.concatenate([o[i] for o in out]) for i in (1, 2))
    ids = pa.array(whose[1], mask=whose[0] == 1)
    return pa.table({"doc_id": ids, "th": whose[2], "low": pa.array(low.astype(np.int32)), "high": pa.array(high.astype(np.int32))})


def _index_repeats(rows, contents, these, place, window):
    distinct: dict[bytes, int] = {}
    of = np.fromiter((distinct.setdefault(contents[i], len(distinct)) for i in these.tolist()), np.int64, len(these))
    earliest = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(earliest, of, place[these])
    least, bounds = search(list(distinct), earliest, window)
    windows = rows[5][these]
    ends = np.cumsum(windows)
    inside = np.arange(int(ends[-1])) - np.repeat(ends - windows, windows)
    repeated = least[np.repeat(bounds[of], windows) + inside] < np.repeat(place[these], windows) + inside
    opens = repeated & ((inside == 0) | ~np.concatenate(([False], repeated[:-1])))
    closes = repeated & (np.append(inside[1:] == 0, True) | ~np.append(repeated[1:], False))
    segment = np.repeat(these, windows)
    first, last = np.flatnonzero(opens), np.flatnonzero(closes)
    return rows[1:4, segment[first]], rows[4, segment[first]] + inside[first], rows[4, segment[first]] + inside[last] + window


def repeats(
    docs: DataFrame, *, window: int = WINDOW, hot_segments: int = HOT_SEGMENTS, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(doc_id, th, low, high)``: runs of words covered by windows that start earlier elsewhere.

    Words are numbered from 0 in each document; ``high`` is the first word after the run. Earlier
    means a smaller id, nulls last, then a smaller text hash, or an earlier start in the same document.
    Rows equal in id and text are one document. Runs may overlap.
    """
    if not 1 <= window < DEPTH:
        raise ValueError(f"window has to be from 1 to {DEPTH - 1}")
    rows = _rows(docs, key, text)
    hot, total = hot_anchors(rows, window, hot_segments)
    shards = max(1, -(-total // SEGMENTS_PER_SHARD))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer = Buffer(window, shards)
        for batch in batches:
            for part in slices(batch):
                part = part.take(pa.array(_unequal(part)))
                buffer.add(part, Segments(part.column("text"), window, hot))
                if buffer.size >= BUFFER_BYTES:
                    yield buffer.packed()
        yield buffer.packed()

    def find(table: pa.Table) -> pa.Table:
        return _shard_repeats(table.column("payload").to_pylist(), window)

    payloads = rows.mapInArrow(cut, "shard long, payload binary")
    return payloads.groupBy("shard").applyInArrow(find, "doc_id long, th long, low int, high int")


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Documents with 32 bits of the text's hash: rows of one id are told apart by them."""
    return keyed(docs, key=key, text=text).withColumn("th", F.col("th").bitwiseAND(F.lit(0xFFFFFFFF)))


def _unequal(part: pa.RecordBatch) -> list[int]:
    """Rows of a slice, each document once."""
    keys: dict[tuple, int] = {}
    for i, k in enumerate(zip(part.column("doc_id").to_pylist(), part.column("th").to_pylist())):
        keys.setdefault(k, i)
    return list(keys.values())


def removed(
    docs: DataFrame, *, window: int = WINDOW, hot_segments: int = HOT_SEGMENTS, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)`` for every row: words, words removed, the others joined by one space.

    Every word covered by a window whose words also start earlier goes; windows are judged on the
    input. Null texts have no words. Repeated rows are one document, given once each with the same result.
    """
    rows = _rows(docs, key, text)
    runs = repeats(docs, window=window, hot_segments=hot_segments, key=key, text=text)
    runs = runs.groupBy("doc_id", "th").agg(F.collect_list(F.struct("low", "high")).alias("runs"))
    paired = rows.alias("d").join(runs.alias("r"), same_document("d", "r"), "left").select("d.doc_id", "d.text", "r.runs")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield _kept(part)

    return paired.mapInArrow(keep, "doc_id long, n_words long, n_removed long, kept string")


def _kept(part: pa.RecordBatch) -> pa.RecordBatch:
    data, offsets = text_buffer(part.column("text"))
    starts, ends, first = word_spans(data, offsets)
    body, begin, end = joined(data, offsets, starts, ends)
    depth = np.zeros(len(starts) + 1, np.int64)
    runs = part.column("runs")
    if len(flat := runs.flatten()):
        whose = np.repeat(first[:-1], np.asarray(runs.value_lengths().fill_null(0)))
        np.add.at(depth, whose + np.asarray(flat.field("low")), 1)
        np.add.at(depth, whose + np.asarray(flat.field("high")), -1)
    gone = np.cumsum(depth)[:-1] > 0
    left = ~gone
    opens = left.copy()
    opens[1:] &= gone[:-1]
    opens[first[:-1][first[:-1] < len(starts)]] = left[first[:-1][first[:-1] < len(starts)]]
    from_word = np.flatnonzero(opens)
    to_word = np.append(from_word[1:], len(starts))
    counts = np.concatenate(([0], np.cumsum(left)))
    last = from_word + counts[to_word] - counts[from_word] - 1
    pieces = [body[a:b] for a, b in zip(begin[from_word].tolist(), end[last].tolist())]
    bounds = np.searchsorted(from_word, first).tolist()
    kept = pa.array([b" ".join(pieces[a:b]) for a, b in zip(bounds, bounds[1:])], pa.binary()).cast(pa.string())
    total = np.diff(first)
    stays = counts[first[1:]] - counts[first[:-1]]
    return pa.RecordBatch.from_arrays(
        [part.column("doc_id"), pa.array(total), pa.array(total - stays), kept], ["doc_id", "n_words", "n_removed", "kept"]
    )
