"""Removal of lines that occur, or nearly occur, earlier in the corpus: a segment-partition edit join.

A line is a repeat if an equal line, or one within ``MAX_EDITS`` character edits, comes earlier. An
indexed line is split into MAX_EDITS + 1 segments, one of which a line within that distance must
hold unchanged. So each line is indexed under (length, number of the segment, segment), and probes the
indexes of its own and of slightly shorter lengths with those of its substrings that can be that
segment, given where the edits before and after it can be. Pairs that meet are dropped if their
character counts differ too much for so few edits; the rest is verified by banded bit-parallel edit
distance, for many pairs at once.

What is shuffled: per different line of a slice of documents and key, three numbers (key, hash of the
line, its character counts in four bits each), packed by shard; texts only of lines in candidate
pairs. Equal lines become one before the shuffle. Which lines are in candidate pairs is known to the
reading tasks as a bitmap of ``CANDIDATE_BITS`` bits, fixed however many there are. A key that many
different lines share takes time with the square of their number, in strips of bounded memory, and gives out only
pairs whose character counts fit.

Equal lines go at any length but blank ones. Near ones go from ``NEAR_CHARS`` characters on: with few characters a
few edits mean nothing, so shorter lines are in no index and only their hashes are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.storage import bitmap, has_bit, stored
from fleetlens.llm.text import Prefixes, code_points, keyed, mix, slices, text_buffer

MAX_EDITS = 2
NEAR_CHARS = 30
NO_BLANK = 0x3001  # from this code point on none is white space
BLANK = np.array([chr(c).isspace() for c in range(NO_BLANK)] + [False])
CANDIDATE_BITS = 1 << 25
LINES_PER_SHARD = 60_000
STRIP, STRIP_ACROSS = 256, 4096
BUCKETS = 16
OUTSIDE = 0xFFFFFFFF
DOC = ("doc_id", "th")


class Lines:
    """The lines of some texts that are long enough, as spans of code points.

    Lines under ``blank_chars`` characters are left out if all of them are white space.
    """

    def __init__(self, texts: pa.Array, min_chars: int, blank_chars: int = 0) -> None:
        import xxhash

        data, offsets = text_buffer(texts)
        self.points, begin, bounds = code_points(data, offsets)
        feeds = np.flatnonzero(self.points == 0x0A)
        starts = np.unique(np.concatenate((bounds[:-1], feeds + 1)))
        starts = starts[starts < len(self.points)]
        doc = np.searchsorted(bounds, starts, side="right") - 1
        ends = np.minimum(np.append(feeds, len(self.points))[np.searchsorted(feeds, starts)], bounds[doc + 1])
        number = np.cumsum(np.concatenate(([0], self.points == 0x0A)))
        number = number[starts] - number[bounds[doc]]
        written = np.concatenate(([0], np.cumsum(~BLANK[np.minimum(self.points, NO_BLANK)])))
        long = (ends - starts >= min_chars) & ((ends - starts >= blank_chars) | (written[ends] > written[starts]))
        self.start, self.end, self.doc, self.number = starts[long], ends[long], doc[long], number[long]
        body, digest = data.tobytes(), xxhash.xxh3_128_digest
        spans = zip(begin[self.start].tolist(), begin[self.end].tolist())
        hashes = np.frombuffer(b"".join([digest(body[a:b]) for a, b in spans]), "<i8").reshape(-1, 2)
        self.h1, self.h2 = hashes[:, 0].astype(np.int64), hashes[:, 1].astype(np.int64)

    def distinct(self) -> np.ndarray:
        """Numbers of lines, each different one once."""
        return np.sort(np.unique(np.stack((self.h1, self.h2)), axis=1, return_index=True)[1])

    def text(self, which: np.ndarray) -> list[str]:
        spans = zip(self.start[which].tolist(), self.end[which].tolist())
        return [self.points[a:b].tobytes().decode("utf-32-le") for a, b in spans]

    def counts(self, which: np.ndarray) -> np.ndarray:
        """Counts of the characters by hash, modulo 16: four bits each of one number."""
        size = self.end[which] - self.start[which]
        line = np.repeat(np.arange(len(which)), size)
        at = np.arange(len(line)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.start[which], size)
        bucket = (mix(self.points[at].astype(np.uint64)) & np.uint64(BUCKETS - 1)).astype(np.int64)
        table = np.bincount(line * BUCKETS + bucket, minlength=len(which) * BUCKETS).reshape(-1, BUCKETS) & 15
        return (table.astype(np.uint64) << (4 * np.arange(BUCKETS)).astype(np.uint64)).sum(axis=1, dtype=np.uint64)


def segments(length: np.ndarray, edits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(offset, size) of the edits + 1 segments of lines of these lengths: as even as can be, the longer ones last."""
    parts = edits + 1
    base, longer = length // parts, length % parts
    out, offset = [], np.zeros_like(length)
    for i in range(parts):
        size = base + (i >= parts - longer)
        out.append((offset, size))
        offset = offset + size
    return out


def keys(lines: Lines, which: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, key, indexed) for the segments of lines and for the substrings they probe with."""
    hashed = Prefixes(lines.points)
    start, size = lines.start[which], lines.end[which] - lines.start[which]
    line, key, indexed = [], [], []
    for shorter in range(edits + 1):
        length = size - shorter
        for i, (offset, part) in enumerate(segments(length, edits)):
            # At most i edits come before the segment and edits - i after it, as it is the first or last unchanged one.
            low = np.maximum(np.maximum(offset - i, offset + shorter - (edits - i)), 0)
            high = np.minimum(np.minimum(offset + i, offset + shorter + (edits - i)), size - part)
            for shift in range(2 * edits + 1):
                at = low + shift
                good = np.flatnonzero((at <= high) & (part > 0))
                if len(good):
                    begin = start[good] + at[good]
                    found = hashed.run(begin, begin + part[good])
                    line.append(good)
                    key.append(mix(found ^ mix((length[good] * 16 + i).astype(np.uint64))))
                    indexed.append((shorter == 0) & (at[good] == offset[good]))
    if not line:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    return np.concatenate(line), np.concatenate(key), np.concatenate(indexed)


def _fits(a: np.ndarray, b: np.ndarray, edits: int) -> np.ndarray:
    """Whether counts differ by so little that this many edits can explain it."""
    apart = (a - b) & 15
    return np.minimum(apart, 16 - apart).sum(axis=-1) <= 2 * edits


def meeting(key: np.ndarray, line: np.ndarray, indexed: np.ndarray, counts: np.ndarray, edits: int) -> np.ndarray:
    """Pairs of different lines that share a key, one of them indexed under it, and fit by their counts: [pair, 2]."""
    order = np.lexsort((~indexed, line, key))
    key, line, indexed, counts = key[order], line[order], indexed[order], counts[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (line[1:] != line[:-1])  # indexed ones come first
    key, line, indexed, counts = key[new], line[new], indexed[new], counts[new]
    begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(begin, len(key)))
    out = []

    def add(a: np.ndarray, b: np.ndarray) -> None:
        for cut in range(0, len(a), 1 << 18):
            i, j = a[cut : cut + (1 << 18)], b[cut : cut + (1 << 18)]
            good = (indexed[i] | indexed[j]) & _fits(nibbles(counts[i]), nibbles(counts[j]), edits)
            out.append(np.stack((line[i[good]], line[j[good]]), axis=1))

    def nibbles(values: np.ndarray) -> np.ndarray:
        packed = values.view(np.uint8).reshape(*values.shape, 8)
        return np.concatenate((packed & 15, packed >> 4), axis=-1)

    inside = np.arange(len(key)) - np.repeat(begin, size)
    of_size = np.repeat(size, size)
    small = np.flatnonzero(of_size <= STRIP)
    for step in range(1, int(min(STRIP, size.max(initial=1)))):
        small = small[inside[small] + step < of_size[small]]
        add(small, small + step)
    for a, n in zip(begin[size > STRIP].tolist(), size[size > STRIP].tolist()):
        for low in range(a, a + n, STRIP):
            i = np.arange(low, min(low + STRIP, a + n))
            for left in range(low, a + n, STRIP_ACROSS):
                j = np.arange(left, min(left + STRIP_ACROSS, a + n))
                x, y = np.meshgrid(i, j, indexing="ij")
                later = x < y
                add(x[later], y[later])
    pairs = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
    pairs = np.sort(pairs, axis=1)
    return np.unique(pairs, axis=0)


def within(left: list[str], right: list[str], edits: int) -> np.ndarray:
    """Edit distances of pairs of lines up to ``edits``; edits + 1 where they are larger.

    Bit-parallel in a band: bit t of a pair's vectors stands for the diagonal t - edits. All
    pairs go one character further at a time.
    """
    pad = np.full(edits, OUTSIDE, np.uint32)
    sizes = np.array([(len(a), len(b)) for a, b in zip(left, right)], np.int64).reshape(-1, 2)
    out = np.full(len(left), edits + 1)
    order = np.flatnonzero(np.abs(sizes[:, 0] - sizes[:, 1]) <= edits)
    order = order[np.argsort(-sizes[order, 1], kind="stable")]
    if not len(order):
        return out
    rows = [np.frombuffer(left[i].encode("utf-32-le"), np.uint32) for i in order.tolist()]
    columns = [np.frombuffer(right[i].encode("utf-32-le"), np.uint32) for i in order.tolist()]
    a = np.concatenate([x for row in rows for x in (pad, row, pad)])
    b = np.concatenate([*columns, pad])
    m, n = sizes[order, 0], sizes[order, 1]
    at_a = np.cumsum(m + 2 * edits) - (m + 2 * edits)  # place of row -edits
    at_b = np.cumsum(n) - n
    one, width = np.uint64(1), 2 * edits + 1
    full, top = np.uint64((1 << width) - 1), np.uint64(1 << 2 * edits)
    plus = np.full(len(order), (1 << width) - (1 << edits), np.uint64)  # rows from 0 on count up from the left edge
    minus = np.zeros(len(order), np.uint64)
    score = np.full(len(order), edits)  # of the lowest row of the band
    score = np.where(m < edits, m, score)
    going = -n
    for j in range(int(n.max(initial=0))):
        k = int(np.searchsorted(going, -j))  # pairs with more than j columns
        letter = b[at_b[:k] + j]
        equal = np.zeros(k, np.uint64)
        for t in range(width):
            # Row j - edits + t; behind the last row no character is equal.
            row = np.minimum(at_a[:k] + j + t, len(a) - 1)
            real = (j + t >= edits) & (j + t - edits < m[:k])
            equal |= ((a[row] == letter) & real).astype(np.uint64) << np.uint64(t)
        p, q = plus[:k], minus[:k]
        diagonal = (((equal & p) + p) ^ p) | equal | q
        up, down = q | ~(diagonal | p), p & diagonal
        last = m[:k] - 1 - (j - edits)  # bit of the last row
        inner = last >= 2 * edits
        score[:k] += np.where(inner, (diagonal & top) == 0, 0)
        bit = np.clip(last, 0, 2 * edits).astype(np.uint64)
        edge = ~inner & (last >= 0)
        score[:k] += np.where(edge, ((up >> bit) & one).astype(np.int64) - ((down >> bit) & one).astype(np.int64), 0)
        moved = (diagonal & full) >> one
        plus[:k] = (down | ~(moved | up)) & full
        minus[:k] = moved & up & full
    out[order] = np.minimum(score, edits + 1)
    return out


def _pack(numbers: np.ndarray, bounds: np.ndarray) -> pa.Array:
    body = np.ascontiguousarray(numbers).tobytes()
    step = numbers.shape[1] * 8
    return pa.array([body[a * step : b * step] for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())


def near_lines(rows: DataFrame, lines: int, *, max_edits: int, near_chars: int) -> DataFrame:
    """``(a1, a2, b1, b2, distance)``: different lines of the documents within ``max_edits`` edits, by their hashes."""
    shards = max(1, -(-lines // LINES_PER_SHARD))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                own = Lines(part.column("text"), near_chars)
                which = own.distinct()
                line, key, indexed = keys(own, which, max_edits)
                counts = own.counts(which)
                shard = (key % np.uint64(shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                # The lowest bit of the key says whether the line is indexed under it.
                marked = (key & ~np.uint64(1)) | indexed.astype(np.uint64)
                table = np.stack((marked, own.h1[which][line].view(np.uint64), counts[line]), axis=1)[order]
                names, first = np.unique(shard[order], return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(names), _pack(table, np.append(first, len(table)))], ["shard", "payload"])

    def meet(table: pa.Table) -> pa.Table:
        numbers = np.frombuffer(b"".join(table.column("payload").to_pylist()), np.uint64).reshape(-1, 3)
        marked = numbers[:, 0]
        pairs = meeting(marked >> np.uint64(1), numbers[:, 1].view(np.int64), (marked & np.uint64(1)) == 1, numbers[:, 2].copy(), max_edits)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    met = rows.mapInArrow(index, "shard long, payload binary").groupBy("shard").applyInArrow(meet, "a long, b long")
    pairs = stored(met.distinct(), "line-pairs")
    bits = pairs.select(F.explode(F.array("a", "b")).alias("h")).select(F.pmod("h", F.lit(CANDIDATE_BITS)).alias("bit"))
    wanted = bitmap(bits, "bit", CANDIDATE_BITS)

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                own = Lines(part.column("text"), near_chars)
                which = own.distinct()
                which = which[has_bit(wanted, own.h1[which] % CANDIDATE_BITS)]
                yield pa.RecordBatch.from_arrays([pa.array(own.h1[which]), pa.array(own.h2[which]), pa.array(own.text(which), pa.string())], ["h1", "h2", "line"])

    texts = stored(rows.mapInArrow(spelled, "h1 long, h2 long, line string").groupBy("h1", "h2").agg(F.first("line").alias("line")), "lines")
    left = texts.select(F.col("h1").alias("a"), F.col("h2").alias("a2"), F.col("line").alias("left"))
    right = texts.select(F.col("h1").alias("b"), F.col("h2").alias("b2"), F.col("line").alias("right"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "left"):
                distance = within(part.column("left").to_pylist(), part.column("right").to_pylist(), max_edits)
                good = np.flatnonzero(distance <= max_edits)
                some = part.take(pa.array(good))
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("a", "a2", "b", "b2")), pa.array(distance[good])], ["a1", "a2", "b1", "b2", "distance"])

    both = pairs.join(left, "a").join(right, "b").select("a", "a2", "b", "b2", "left", "right")
    return both.mapInArrow(verify, "a1 long, a2 long, b1 long, b2 long, distance long")


def repeats(
    docs: DataFrame, *, max_edits: int = MAX_EDITS, min_chars: int | None = None, near_chars: int | None = None, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(doc_id, th, numbers)``: the numbers of the lines, from 0, that equal or nearly equal an earlier one.

    A line goes if an equal line comes before it, or if a different line within ``max_edits`` edits has its
    first occurrence before this line's first one. Before means a smaller id, nulls last, then a smaller
    text hash, then a smaller line number. Edits count between lines of ``near_chars`` characters or more; shorter
    lines go if they are equal, and stay if they are blank. Lines under ``min_chars`` characters never go. If only
    ``min_chars`` is given it is ``near_chars`` too; if neither is, every length counts and ``NEAR_CHARS`` holds.
    """
    least = min_chars or 1
    near_chars = max(near_chars or min_chars or NEAR_CHARS, least)
    if not 1 <= max_edits <= 15 or near_chars <= 2 * max_edits:
        raise ValueError("1 to 15 edits, and lines of more than twice as many characters")
    rows = keyed(docs, key=key, text=text)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                own = Lines(part.column("text"), least, near_chars)
                doc = pa.array(own.doc)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(doc), part.column("th").take(doc), pa.array(own.number.astype(np.int32)), pa.array(own.h1), pa.array(own.h2),
                     pa.array(own.end - own.start >= near_chars)],
                    ["doc_id", "th", "number", "h1", "h2", "long"],
                )

    lines = stored(rows.mapInArrow(found, "doc_id long, th long, number int, h1 long, h2 long, long boolean"), "line-hashes")
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "th", "number")
    firsts = lines.groupBy("h1", "h2").agg(F.min(order).alias("first"), F.count("*").alias("times"))
    near = stored(near_lines(rows, lines.where("long").count(), max_edits=max_edits, near_chars=near_chars), "near-lines")
    a = firsts.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("first").alias("first_a"))
    b = firsts.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("first").alias("first_b"))
    late = near.join(a, ["a1", "a2"]).join(b, ["b1", "b2"])
    a_later = F.col("first_a") > F.col("first_b")
    late = late.select(F.when(a_later, F.col("a1")).otherwise(F.col("b1")).alias("h1"), F.when(a_later, F.col("a2")).otherwise(F.col("b2")).alias("h2"))
    late = late.distinct().withColumn("late", F.lit(True))
    judged = firsts.join(late, ["h1", "h2"], "left").where((F.col("times") > 1) | F.col("late"))
    judged = stored(judged, "repeated-lines")  # read anew, so that the join below can split the rows of a very common line
    gone = lines.join(judged, ["h1", "h2"]).where(F.col("late") | (order != F.col("first")))
    return gone.groupBy(*DOC).agg(F.collect_set("number").alias("numbers"))


def deduplicated(docs: DataFrame, *, max_edits: int = MAX_EDITS, min_chars: int | None = None, near_chars: int | None = None) -> DataFrame:
    """``docs`` with ``text`` without its repeated lines, and ``n_lines`` and ``n_removed`` (long).

    Lines are what line feeds separate; those that stay are joined by line feeds. Null texts have no
    lines and stay null; a text may become empty. Rows equal in id and text are one document and get the
    same result. Columns of these names are replaced; all others stay.
    """
    gone = repeats(docs, max_edits=max_edits, min_chars=min_chars, near_chars=near_chars)
    rest = docs.drop("n_lines", "n_removed")
    th = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    named = gone.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "numbers")
    on = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (th == F.col("__th"))
    paired = rest.join(named, on, "left").select(*[f"`{c}`" for c in rest.columns], F.sort_array("numbers").alias("__gone"))
    columns = rest.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts, totals, removed = [], [], []
                for text, numbers in zip(part.column("text").to_pylist(), part.column("__gone").to_pylist()):
                    lines = text.split("\n") if text is not None else []
                    drop = set(numbers or ())
                    texts.append(None if text is None else "\n".join([x for i, x in enumerate(lines) if i not in drop]) if drop else text)
                    totals.append(len(lines))
                    removed.append(len(drop))
                cells = [pa.array(texts, pa.string()) if c == "text" else part.column(c) for c in columns]
                yield pa.RecordBatch.from_arrays([*cells, pa.array(totals, pa.int64()), pa.array(removed, pa.int64())], [*columns, "n_lines", "n_removed"])

    plain = paired.withColumn("text", F.col("text").cast("string"))
    schema = plain.drop("__gone").select("*", F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed")).schema
    return plain.mapInArrow(keep, schema)
