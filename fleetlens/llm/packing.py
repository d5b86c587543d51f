"""Packing of documents into sequences of a fixed number of tokens.

Documents become token ids and an end id; longer ones are cut into pieces. A piece that
fills a sequence is one. The others are dealt to shards of about ``BINS`` sequences. A shard starts with best
fit: pieces by falling length, each into the fullest bin that has room. Then bins exchange pieces: the emptiest
bin gives one piece, or two, to another underfull bin, for one piece or two that are shorter, or for none. Of all exchanges the one that
fills the most is made, if it raises the sum of the squared fills; so room gathers in
few bins, which run empty and go, until no exchange is left or no bin can be saved.

The emptiest bins of a shard are not final: those of ``FAN`` shards meet in the next round and exchange pieces,
and so on until one shard is left. A round keeps a sixteenth of the bins, so all rounds together
move little more than the first, and no task ever has more than a shard.

Tokens are found word by word: the tokenizers here drop white space and never look across it, so each
distinct word of a slice of documents is given to the library once, and ids are gathered from the words.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.runs import _spans
from fleetlens.llm.storage import stored
from fleetlens.llm.text import SPACE, lower_ascii, once, slices, text_buffer, widened, word_spans

LIMIT = 4096  # tokens of a sequence
END = 1  # the id after each document
BINS = 256  # sequences of a shard, about
FAN = 16  # shards that become one in the next round
CACHE_WORDS = 400_000
CACHED_BYTES = 64
CLOSES = "</w>"  # fixed: what these vocabularies write after the last piece of a word
AT_ONCE = 500  # words
ENCODED_AT_ONCE = 4 << 20  # bytes of text; the more, the fewer different words per word


class WordIds:
    """Ids of words by a tokenizer file, each word encoded on its own.

    The cache has two generations: words used since the last turn of generations, and the ones before. Words in use stay.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a piece of a word
        self.closes[[i for token, i in vocabulary.items() if token.endswith(CLOSES)]] = True
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def of(self, words: list[bytes]) -> list[bytes]:
        """Packed little-endian 32-bit ids of distinct words."""
        young, old = self.young, self.old
        if len(young) > CACHE_WORDS:
            self.old = old = young
            self.young = young = {}
        new = []
        for word in words:
            if word not in young:
                known = old.get(word)
                if known is None:
                    new.append(word)
                else:
                    young[word] = known
        long = {}
        for word, packed in zip(new, self._encode([w.decode("utf-8") for w in new])):
            (young if len(word) <= CACHED_BYTES else long)[word] = packed
        if long:
            return [long[w] if w in long else young[w] for w in words]
        return list(map(young.__getitem__, words))


    def _encode(self, words: list[str]) -> list[bytes]:
        """Ids of the words. Words of letters alone go to the library many at a time: each is one piece, which one id ends."""
        out: list[bytes] = [b""] * len(words)
        plain = [i for i, w in enumerate(words) if w.isalpha()]
        groups = [plain[i : i + AT_ONCE] for i in range(0, len(plain), AT_ONCE)]
        alone = [i for i, w in enumerate(words) if not w.isalpha()]
        found = self.library.encode_batch_fast([" ".join([words[i] for i in g]) for g in groups], add_special_tokens=False)
        for group, encoded in zip(groups, found):
            ids = np.array(encoded.ids, "<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(group):  # letters to Python, but not to the library
                alone += group
                continue
            body, edges = ids.tobytes(), (4 * ends).tolist()
            for i, a, b in zip(group, [0, *edges], edges):
                out[i] = body[a:b]
        for i, encoded in zip(alone, self.library.encode_batch_fast([words[i] for i in alone], add_special_tokens=False)):
            out[i] = np.array(encoded.ids, "<u4").tobytes()
        return out


def word_ids(path: str) -> WordIds:
    return once(f"word ids {path}", lambda: WordIds(path))


def _normal_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and ends of words that have the ids of the words of the texts, and the bounds of the texts among them.

    There are fewer different ones: words of ASCII alone are put in lower case, as the tokenizer would, and a mark
    after a letter, which it would cut off, is a word. (A bar may belong to a special token, which only
    counts as it is written; beside other characters a capital may not be put in lower case alone.)
    """
    data, offsets = text_buffer(texts)
    starts, ends, first = word_spans(data, offsets)
    odd = np.concatenate(([0], np.cumsum((data >= 0x80) | (data == ord("|")), dtype=np.int32)))
    lower = lower_ascii(data)
    kept = np.flatnonzero(odd[ends] != odd[starts])
    as_is = _spans(starts[kept], ends[kept])[0]
    lower[as_is] = data[as_is]
    marks, letters = np.zeros(256, bool), np.zeros(256, bool)
    marks[list(b".,;:!?")] = True
    letters[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
    cut = np.flatnonzero((ends - starts > 1) & marks[lower[ends - 1]] & letters[lower[ends - 2]])
    before = np.concatenate(([0], np.cumsum(np.bincount(cut, minlength=len(starts)))))[first]
    at = ends[cut] - 1
    starts, ends = np.insert(starts, cut + 1, at), np.insert(ends, cut, at)
    return lower, starts, ends, first + before


def encoded(texts: pa.Array, ids: WordIds, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each followed by the end id, and the bounds of the texts among them."""
    data, starts, ends, first = _normal_words(texts)
    bounds = np.concatenate(([0], np.cumsum(ends - starts)))
    body = pa.py_buffer(data[~SPACE[data]].tobytes())
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), body]).dictionary_encode()
    different, edges = text_buffer(words.dictionary.cast(pa.large_binary()).view(pa.large_string()))
    body, edges = different.tobytes(), edges.tolist()
    packed = ids.of([body[a:b] for a, b in zip(edges, edges[1:])])
    size = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
    begin = np.cumsum(size) - size
    which = words.indices.to_numpy()
    flat = np.frombuffer(b"".join(packed), "<u4")[_spans(begin[which], begin[which] + size[which])[0]]
    per_text = np.concatenate(([0], np.cumsum(size[which])))[first]
    out = np.insert(flat, per_text[1:], end)
    return out, per_text + np.arange(len(per_text))


def pieces(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", limit: int = LIMIT, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row for each piece of each document: its key, ``piece``, ``start``, ``length`` and ``ids_crc32``; with ``with_ids`` also ``ids``.

    A document is the ids of its text by the tokenizer file ``path``, without special tokens added, then ``end``; a
    null text is an empty one, a single ``end``. It is cut every ``limit`` ids. ``ids`` are packed little-endian 32-bit numbers and ``ids_crc32`` their
    CRC-32. Other columns of ``docs`` are left out; the key may have any type. The file has to be readable on the executors, and its
    tokenizer must drop white space.
    """
    rows = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").cast("string").alias("__text"))
    new = ["piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text", ENCODED_AT_ONCE):
                ids, bounds = encoded(part.column("__text"), word_ids(path), end)
                count = -(-np.diff(bounds) // limit)
                piece, which = _spans(np.zeros(len(count), np.int64), count)
                start = bounds[:-1][which] + piece * limit
                stop = np.minimum(start + limit, bounds[1:][which])
                body = memoryview(ids.astype("<u4").tobytes())
                cut = [body[4 * a : 4 * b] for a, b in zip(start.tolist(), stop.tolist())]
                made = [
                    part.column(key).take(pa.array(which)), pa.array(piece, pa.int32()), pa.array(piece * limit, pa.int64()),
                    pa.array(stop - start, pa.int64()), pa.array([zlib.crc32(c) for c in cut], pa.int64()),
                ]
                if with_ids:
                    made.append(pa.array([c.tobytes() for c in cut], pa.binary()))
                yield pa.RecordBatch.from_arrays(made, [key, *new])

    return rows.mapInArrow(run, widened(rows.select(key), "piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids))


def best_fit(length: np.ndarray, limit: int) -> np.ndarray:
    """A bin for each length: longest first, into the fullest bin with room, else into a new one."""
    bins = np.empty(len(length), np.int64)
    with_room: list[list[int]] = [[] for _ in range(limit + 1)]
    rooms, made = 0, 0  # bit r of rooms: some bin has room for r more
    for i in np.argsort(-length, kind="stable").tolist():
        size = int(length[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            bins[i] = with_room[room].pop()
            if not with_room[room]:
                rooms &= ~(1 << room)
        else:
            room, bins[i], made = limit, made, made + 1
        if room > size:
            with_room[room - size].append(int(bins[i]))
            rooms |= 1 << (room - size)
    return bins


def _few_of_each(length: np.ndarray, bins: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Of ``which``, at most two pieces of each length in each bin; more give no other exchange.

    So a bin shows about twice as many pieces as lengths fit in it: under 200 at 4096 tokens.
    """
    by = which[np.lexsort((which, length[which], bins[which]))]
    if len(by) < 3:
        return by
    third = (bins[by][2:] == bins[by][:-2]) & (length[by][2:] == length[by][:-2])
    return by[np.concatenate(([True, True], ~third))]


def _pairs(length: np.ndarray, bins: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs within a bin of the pieces ``which``, ordered by bin."""
    last = np.searchsorted(bins[which], bins[which], side="right")
    at = np.arange(len(which))
    second, first = _spans(at + 1, last)
    return which[first], which[second]


def _exchange(length: np.ndarray, bins: np.ndarray, fill: np.ndarray, giver: int, limit: int):
    """The exchange with ``giver`` that fills another bin the most: pieces it gives, pieces it gets, the bin. None without one."""
    mine = _few_of_each(length, bins, np.flatnonzero(bins == giver))
    a, b = _pairs(length, bins, mine)
    gives = np.concatenate((np.stack((mine, np.full(len(mine), -1)), axis=1), np.stack((a, b), axis=1)))
    sums = np.concatenate((length[mine], length[a] + length[b]))
    theirs = np.flatnonzero((fill > 0) & (fill < limit))
    theirs = theirs[theirs != giver]
    open_ = np.zeros(len(fill), bool)
    open_[theirs] = True
    single = _few_of_each(length, bins, np.flatnonzero(open_[bins]))
    none = np.full(len(theirs), -1)
    c, d = _pairs(length, bins, single)
    # Nothing or one piece against one or two; two pieces against one.
    offers = (
        (sums, gives, np.concatenate((theirs, bins[single])), np.concatenate((none, single)), np.full(len(theirs) + len(single), -1)),
        (sums[: len(mine)], gives[: len(mine)], bins[c], c, d),
    )
    best = None
    for amounts, pieces_, bin_, one, two in offers:
        if not len(bin_):
            continue
        order = np.argsort(amounts, kind="stable")
        back = np.where(one >= 0, length[one], 0) + np.where(two >= 0, length[two], 0)
        at = np.searchsorted(amounts[order], back + limit - fill[bin_], side="right") - 1
        gain = np.where(at >= 0, amounts[order][np.maximum(at, 0)] - back, 0)
        gain[(gain <= 0) | (fill[bin_] + gain <= fill[giver])] = 0
        i = int(np.argmax(gain))
        if gain[i] > 0 and (best is None or gain[i] > best[0]):
            best = int(gain[i]), pieces_[order[at[i]]], (one[i], two[i]), int(bin_[i])
    return best


def improved(length: np.ndarray, bins: np.ndarray, limit: int) -> np.ndarray:
    """The bins after exchanges that raise the sum of squared fills, until no bin can go or no exchange is left."""
    bins = bins.copy()
    fill = np.bincount(bins, length).astype(np.int64)
    least = -(-int(length.sum()) // limit)
    stuck, changed = np.zeros(len(fill), bool), False
    while (fill > 0).sum() > least:
        givers = np.flatnonzero((fill > 0) & (fill < limit) & ~stuck)
        if not len(givers):
            if not changed:
                break
            stuck[:], changed = False, False
            continue
        giver = int(givers[np.argmin(fill[givers])])
        found = _exchange(length, bins, fill, giver, limit)
        if found is None:
            stuck[giver] = True
            continue
        gain, given, got, other = found
        bins[[p for p in given if p >= 0]] = other
        bins[[p for p in got if p >= 0]] = giver
        fill[other] += gain
        fill[giver] -= gain
        changed = True
    return bins


def _settle(table: pa.Table, limit: int, open_bins: int) -> pa.Table:
    """One shard: best fit if it has no bins yet, exchanges, and which bins stay open."""
    table = table.sort_by("__uid")
    uid, length = table.column("__uid").to_numpy(), table.column("length").to_numpy()
    had = table.column("sequence_id")
    bins = best_fit(length, limit) if had.null_count else np.unique(had.to_numpy(), return_inverse=True)[1]
    bins = improved(length, bins, limit)
    order = np.argsort(bins, kind="stable")
    first = np.flatnonzero(np.diff(bins[order], prepend=-1))
    size = np.diff(np.append(first, len(order)))
    before = np.cumsum(length[order]) - length[order]
    fill = np.add.reduceat(length[order], first)
    least_full = np.argsort(fill, kind="stable")[:open_bins]
    stays = np.zeros(len(first), bool)
    stays[least_full[fill[least_full] < limit]] = True
    sequence, offset, still = np.empty_like(uid), np.empty_like(uid), np.empty(len(uid), bool)
    sequence[order] = np.repeat(uid[order][first], size)
    offset[order] = before - np.repeat(before[first], size)
    still[order] = np.repeat(stays, size)
    for name, values in (("sequence_id", sequence), ("offset", offset), ("__open", still)):
        table = table.set_column(table.schema.get_field_index(name), name, pa.array(values))
    return table


def _settler(limit: int, open_bins: int) -> Callable[[pa.Table], pa.Table]:
    return lambda table: _settle(table, limit, open_bins)


def pack(pieces_: DataFrame, *, limit: int = LIMIT, bins: int = BINS, fan: int = FAN) -> DataFrame:
    """``pieces_`` with ``sequence_id`` and ``offset``: the sequence of each row and its place there, in tokens from 0.

    ``pieces_`` has ``length``, from 1 to ``limit``; its other columns stay, except that ``sequence_id`` and ``offset``
    are replaced. Sequences have no gaps and at most ``limit`` tokens. Rows may repeat: each is a piece of its
    own. Rows with a null, too large or too small length end the job with an error. No rows give none.
    """
    columns = [c for c in pieces_.columns if c not in ("sequence_id", "offset")]
    fits = F.col("length").between(1, limit)
    checked = F.when(F.coalesce(fits, F.lit(False)), F.col("length").cast("long")).otherwise(F.raise_error(F.lit(f"a piece has 1 to {limit} tokens")))
    rows = stored(
        pieces_.select(*[f"`{c}`" for c in columns]).withColumn("length", checked).withColumn("__uid", F.monotonically_increasing_id()), "packing-pieces"
    )
    full = rows.where(F.col("length") == limit).select(*columns, F.col("__uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = rows.where(F.col("length") < limit)
    total = rest.agg(F.sum("length")).first()[0] or 0
    shards = max(1, -(-total // (limit * bins)))
    none = F.lit(None).cast("long")
    left = rest.withColumns({"sequence_id": none, "offset": none, "__open": F.lit(True), "__shard": F.pmod(F.xxhash64("__uid"), F.lit(shards))})
    done = [full]
    while True:
        kept = bins // fan if shards > 1 else 0
        found = stored(left.groupBy("__shard").applyInArrow(_settler(limit, kept), left.schema), "packing-round")
        done.append(found.where("not __open").select(*columns, "sequence_id", "offset"))
        if shards == 1:
            break
        shards = -(-shards // fan)
        left = found.where("__open").withColumn("__shard", F.pmod(F.col("__shard"), F.lit(shards)))
    out = done[0]
    for part in done[1:]:
        out = out.unionAll(part)
    return out


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id``, ``n_tokens`` and ``ids`` of each sequence, from packed pieces with ``ids``."""
    inside = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    made = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), inside.alias("parts"))
    return made.select("sequence_id", "n_tokens", F.unhex(F.array_join(F.col("parts.ids"), "")).alias("ids"))
