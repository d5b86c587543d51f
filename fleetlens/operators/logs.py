"""Replica logs: counting a literal and taking the last lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.text import occurrences
from fleetlens.operators.scan import by_number, chunked_scan, pack, so_far, unpack

TAIL_LINES = 50000
REPLICA_KEYS = ("cluster_id", "replica_id")


def needle_count(logs: DataFrame, needle: str, by: Sequence[str] = REPLICA_KEYS, text: str = "raw") -> DataFrame:
    """Occurrences of a literal per replica, over whole texts."""
    hits = F.coalesce(occurrences(F.col(text), needle), F.lit(0))
    return logs.groupBy(*by).agg(F.sum(hits).alias("hits"))


def _lines(text: Column) -> Column:
    """Lines of a text; a final line feed does not start another line."""
    return F.split(F.regexp_replace(text, "\n$", ""), "\n")


def log_tail(
    logs: DataFrame,
    by: Sequence[str] = REPLICA_KEYS,
    *,
    lines: int = TAIL_LINES,
    chunk: int = 4096,
    text: str = "raw",
) -> DataFrame:
    """Last lines per replica, numbered from the end.

    Only line counts are scanned; the texts themselves are then joined to the few log
    pieces that reach into the tail.
    """
    by = list(by)
    sized = logs.select(*by, "seq", F.size(_lines(F.col(text))).alias("__n"))
    scanned = chunked_scan(
        pack(sized, by),
        [F.col("seq").desc()],
        by_number(F.col("seq"), chunk),
        local={"__to_here": lambda w: F.sum("__n").over(so_far(w))},
        summary={"__total": F.sum("__n")},
        carry={"__after": lambda w: F.sum("__total").over(w)},
        backward=True,
    )
    later = F.coalesce("__after", F.lit(0)) + F.col("__to_here") - F.col("__n")
    tail = unpack(scanned).select(*by, "seq", later.alias("__later")).where(F.col("__later") < lines)
    return (
        logs.join(tail, [*by, "seq"])
        .select(*by, "seq", "__later", F.posexplode(F.reverse(_lines(F.col(text)))).alias("__back", "line"))
        .withColumn("from_end", F.col("__later") + F.col("__back") + 1)
        .where(F.col("from_end") <= lines)
        .select(*by, "seq", "from_end", "line")
    )
