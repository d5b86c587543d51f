"""Words of document batches as numpy spans, and how documents are told apart.

A word is a run of bytes other than space and \\x09-\\x0D. Batches are Arrow string arrays; the
functions work on their byte buffers, so no Python object is made per word. Work arrays take
several bytes for each byte of text, so batches are handled in slices of about ``SLICE_BYTES``.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 1 << 20
BATCH_ROWS = 1000
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
SPACE = np.zeros(256, bool)
SPACE[list(SPACE_BYTES)] = True
# An odd multiplier and its inverse modulo 2**64, for hashes of byte runs.
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def once(key: str, make: Callable[[], Any]) -> Any:
    """``make()``, made once in a Python process.

    Functions travel to the executors by value, so that module globals begin anew in every task; this store
    lives as long as the worker process.
    """
    name = "_fleetlens_worker_store"
    store = vars(sys.modules.setdefault(name, types.ModuleType(name)))
    if key not in store:
        store[key] = make()
    return store[key]


def small_batches(spark: SparkSession) -> None:
    """Bound the rows that Spark hands to Python at once; its own 10,000 are too many where texts are long."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))


def keyed(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``text`` and ``th``, a hash of the text, which tells rows of one id apart.

    Other columns are left out. Rows that are equal in id and text count as one document.
    """
    small_batches(docs.sparkSession)
    body = F.col(f"`{text}`").cast("string")
    return docs.select(
        F.col(f"`{key}`").cast("long").alias("doc_id"), body.alias("text"), F.xxhash64(F.coalesce(body, F.lit(""))).alias("th")
    )


def widened(df: DataFrame, more: str) -> T.StructType:
    """The schema of ``df`` with further fields, given as DDL, for a function that gets small batches."""
    small_batches(df.sparkSession)
    return T.StructType(df.schema.fields + T.StructType.fromDDL(more).fields)


def same_document(left: str, right: str) -> Column:
    """Join condition between two aliases of tables with ``doc_id`` and ``th``; null ids match."""
    return F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id")) & (F.col(f"{left}.th") == F.col(f"{right}.th"))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most about ``limit`` bytes of text each, one row at least."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // limit
    edges = np.flatnonzero(np.diff(part, prepend=-1))
    for begin, end in zip(edges, np.append(edges[1:], len(sizes))):
        yield batch.slice(int(begin), int(end - begin))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array, one text after the other, and the offsets of the texts. Null is empty."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(offsets) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each text the index of its first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    outside = np.ones(len(data) + 1, bool)
    outside[1:] = space
    starts = np.flatnonzero(~space & (outside[:-1] | edge[:-1]))
    outside[:-1] = space
    outside[-1] = True
    ends = np.flatnonzero(~space & (outside[1:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def joined(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Texts with one space between words: bytes, and the starts and ends of the words in them.

    Consecutive words of one text are one slice of the result, from the start of the first to the end of the last.
    """
    if not len(data):
        return b"", starts, ends
    keep = ~SPACE[data]
    follows = ends[ends < len(data)]
    keep[follows] = True
    where = np.cumsum(keep) - keep
    out = data[keep]
    out[SPACE[out]] = 0x20
    first = where[starts]
    return out.tobytes(), first, first + (ends - starts)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, count: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64."""
    out = np.full(max(count, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Prefixes:
    """Hashes of any runs of a sequence of small integers, in constant time for each run."""

    def __init__(self, values: np.ndarray) -> None:
        terms = (values.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(values))
        self.sums = np.concatenate(([np.uint64(0)], np.cumsum(terms, dtype=np.uint64)))
        self.back = powers(BASE_INVERSE, len(values) + 1)

    def run(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of values[begin:end], for arrays of bounds."""
        return mix((self.sums[end] - self.sums[begin]) * self.back[begin] + (end - begin).astype(np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    block = starts // SLICE_BYTES  # a very long text is hashed in blocks of words
    edges = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(starts))
    for a, b in zip(edges[:-1], edges[1:]):
        begin = starts[a]
        hashed = Prefixes(data[begin : ends[b - 1]])
        out[a:b] = hashed.run(starts[a:b] - begin, ends[a:b] - begin)
    return out


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of UTF-8 texts, their byte starts (one more at the end), and the offsets of the texts among them."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    begin = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    return points, begin, np.searchsorted(begin, offsets)
