"""Ordered scans that never put a whole key in one task.

A running computation per key (row numbers, runs of failures, "last value before")
is usually a window partitioned by the key, which sends a hot key to one task. Here
each key is cut into chunks along its order column. Windows run inside (key, chunk);
every chunk is reduced to one summary row; the summaries, few per key, are scanned to
give each chunk the state left by the chunks before it; that state is joined back.

The chunk id is a function of the row alone, so a recomputed task gives the same chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CHUNK = "__chunk"
PART = "__part_of_chunk"
KEY = "__key"
SPLIT_ROWS = 2_000_000
DEFAULT_CHUNK_S = 300

WindowFn = Callable[[WindowSpec], Column]


def int_chunk(value: Column, width: int) -> Column:
    """Index of the fixed-width slice of an integer order column; exact for any long."""
    whole = F.lit(width).cast("long")
    value = value.cast("long")
    return F.call_function("div", value - F.pmod(value, whole), whole)


def time_chunk(ts: Column, width_s: float = DEFAULT_CHUNK_S) -> Column:
    """Index of the fixed-width time slice that holds ``ts``."""
    return int_chunk(F.unix_micros(ts), int(width_s * 1_000_000))


@dataclass(frozen=True)
class Slices:
    """Fixed-width slices of an integer that never falls along the order of a scan.

    Slices spread a hot key, and many keys spread a hot slice. Where the keys are few, such
    as one cluster, a burst could still be one chunk; ``split`` then cuts chunks that are
    too large, at the price of counting the rows first.
    """

    value: Column
    width: int
    split: bool = False


def by_time(ts: Column, width_s: float = DEFAULT_CHUNK_S, split: bool = False) -> Slices:
    return Slices(F.unix_micros(ts), int(width_s * 1_000_000), split)


def by_number(value: Column, width: int, split: bool = False) -> Slices:
    return Slices(value.cast("long"), width, split)


def oversized(df: DataFrame, slices: Slices) -> DataFrame:
    """Chunks of packed keys with more than ``SPLIT_ROWS`` rows, and how to cut them.

    At most one chunk in ``SPLIT_ROWS`` rows can be that large, which bounds this table: a
    trillion rows give half a million entries.
    """
    at = slices.value
    return (
        df.groupBy(_chunk_of(slices).alias(CHUNK), KEY)
        .agg(F.count(F.lit(1)).alias("__rows"), F.min(at).alias("__low"), F.max(at).alias("__high"))
        .where(F.col("__rows") > SPLIT_ROWS)
        .select(
            CHUNK,
            KEY,
            "__low",
            (F.col("__high") - F.col("__low") + 1).alias("__span"),
            F.ceil(F.col("__rows") / SPLIT_ROWS).alias("__parts"),
        )
    )


def _chunk_of(slices: Slices) -> Column:
    # Rows without an order value sort first, in a chunk of their own; like the packed key,
    # a chunk that is never null keeps null filters out of the joins.
    return F.coalesce(int_chunk(slices.value, slices.width), F.lit(-(2**63)))


def cut(df: DataFrame, slices: Slices, large: DataFrame | None = None) -> DataFrame:
    """Give each row of packed keys its chunk and part.

    A chunk is one slice of one key. With ``slices.split``, an oversized one is cut into
    equal parts of the range its rows span. ``large`` names the oversized chunks; by default
    they are counted on ``df``. Rows outside the counted range go to the outer parts.
    """
    if not slices.split:
        return df.withColumn(CHUNK, _chunk_of(slices)).withColumn(PART, F.lit(0).cast("long"))
    large = oversized(df, slices) if large is None else large
    offset = (slices.value - F.col("__low")) * F.col("__parts")
    part = F.call_function("div", offset, F.col("__span"))
    part = F.greatest(F.least(part, F.col("__parts") - 1), F.lit(0).cast("long"))
    return (
        df.withColumn(CHUNK, _chunk_of(slices))
        .join(F.broadcast(large), [CHUNK, KEY], "left")
        .withColumn(PART, F.when(F.col("__parts").isNotNull(), part).otherwise(F.lit(0).cast("long")))
        .drop("__low", "__span", "__parts")
    )


def pack(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Replace the key columns by one struct.

    A struct is never null itself and equals another with nulls in the same fields, so
    rows with null keys keep their group, and joins on it add no null filter that would
    keep Spark from reusing the shuffle of the rows for their summaries.
    """
    return df.withColumn(KEY, F.struct(*keys)).drop(*keys)


def unpack(df: DataFrame) -> DataFrame:
    """Restore the key columns and drop the chunk columns."""
    return df.select(f"{KEY}.*", *[c for c in df.columns if c not in (KEY, CHUNK, PART)])


def so_far(window: WindowSpec) -> WindowSpec:
    """The rows of a window up to the current one."""
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def chunked_scan(
    df: DataFrame,
    order: Sequence[Column],
    slices: Slices | None,
    *,
    local: Mapping[str, WindowFn],
    summary: Mapping[str, Column],
    carry: Mapping[str, WindowFn],
    backward: bool = False,
    large: DataFrame | None = None,
) -> DataFrame:
    """Add ``local`` window columns and the ``carry`` state of the preceding chunks.

    ``df`` has packed keys. ``local`` columns are computed inside a chunk, in the given
    order, each able to use the ones before it. ``summary`` aggregates the resulting rows
    per chunk. ``carry`` columns are windows over the summary rows of the strictly earlier
    chunks (strictly later ones when ``backward``); each may use summaries and earlier
    carries. The result keeps its chunks, so a following scan can pass None for ``slices``
    and find the rows already partitioned; :func:`unpack` drops them.
    """
    # The chunk comes first in the sort, as numbers compare faster than structs.
    inside = Window.partitionBy(CHUNK, PART, KEY).orderBy(*order)
    rows = df if slices is None else cut(df, slices, large)
    for name, fn in local.items():
        rows = rows.withColumn(name, fn(inside))
    along = [F.col(c).desc() if backward else F.col(c).asc() for c in (CHUNK, PART)]
    before = Window.partitionBy(KEY).orderBy(*along).rowsBetween(Window.unboundedPreceding, -1)
    state = rows.groupBy(CHUNK, PART, KEY).agg(*[c.alias(n) for n, c in summary.items()])
    for name, fn in carry.items():
        state = state.withColumn(name, fn(before))
    return rows.join(state.select(CHUNK, PART, KEY, *carry), [CHUNK, PART, KEY])


def row_index(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], slices: Slices, out: str
) -> DataFrame:
    """1-based position of each row within its key."""
    # The slices may be of a key column, so they are cut before the keys are packed.
    sliced = df.withColumn("__along", slices.value)
    scanned = chunked_scan(
        pack(sliced, keys),
        order,
        Slices(F.col("__along"), slices.width, slices.split),
        local={"__pos": lambda w: F.row_number().over(w)},
        summary={"__n": F.count(F.lit(1))},
        carry={"__before": lambda w: F.sum("__n").over(w)},
    )
    position = F.col("__pos") + F.coalesce(F.col("__before"), F.lit(0))
    return unpack(scanned.withColumn(out, position).drop("__pos", "__before", "__along"))


def previous_row(
    df: DataFrame, order: Sequence[str], slices: Slices | None, value: Column, out: str
) -> DataFrame:
    """``value`` of the row just before this one within its packed key; null on the first."""
    rank = F.struct(*[F.col(c) for c in order])
    scanned = chunked_scan(
        df.withColumn("__val", F.struct(value.alias("v"))),
        [F.col(c).asc() for c in order],
        slices,
        local={"__lag": lambda w: F.lag("__val").over(w)},
        summary={"__last": F.max_by("__val", rank)},
        carry={"__from": lambda w: F.last("__last").over(w)},
    )
    return scanned.withColumn(out, F.coalesce("__lag", "__from")["v"]).drop("__val", "__lag", "__from")


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    enters: Column,
    leaves: Column,
    values: Mapping[str, Column],
    chunk_s: float = DEFAULT_CHUNK_S,
    split: bool = False,
) -> DataFrame:
    """Totals of ``values`` over the rows in force at each row's ``enters`` time.

    A row is in force from ``enters`` through ``leaves``, both in microseconds. It adds its
    values when it enters and takes them back one microsecond after it leaves, so a
    trailing window becomes a running sum: one step per change, however many rows the
    window spans. (A sliding frame would be summed again for every row.) Rows entering at
    the same time see each other. The totals of doubles are subject to rounding; those of
    whole numbers are exact.
    """
    names = list(values)
    slices = by_number(F.col("__us"), int(chunk_s * 1_000_000), split)
    large = oversized(pack(df.select(*keys, enters.alias("__us")), keys), slices) if split else None
    entering = df.select("*", enters.alias("__us"), *[v.alias(f"__d_{n}") for n, v in values.items()])
    leaving = df.select(
        *keys, (leaves + 1).alias("__us"), *[(-v).alias(f"__d_{n}") for n, v in values.items()]
    )
    changes = entering.withColumn("__row", F.lit(True)).unionByName(
        leaving.withColumn("__row", F.lit(False)), allowMissingColumns=True
    )

    def with_peers(window: WindowSpec) -> WindowSpec:
        return window.rangeBetween(Window.unboundedPreceding, Window.currentRow)

    scanned = chunked_scan(
        pack(changes, keys),
        [F.col("__us")],
        slices,
        local={f"__l_{n}": lambda w, n=n: F.sum(f"__d_{n}").over(with_peers(w)) for n in names},
        summary={f"__t_{n}": F.sum(f"__d_{n}") for n in names},
        carry={f"__c_{n}": lambda w, n=n: F.sum(f"__t_{n}").over(w) for n in names},
        large=large,
    )
    totals = [(F.col(f"__l_{n}") + F.coalesce(f"__c_{n}", F.lit(0))).alias(n) for n in names]
    return unpack(scanned.where("__row")).select(*df.columns, *totals)
