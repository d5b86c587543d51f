"""Streamed responses: ordered text assembly and event-stream transcripts."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.operators.scan import by_number, chunked_scan, int_chunk, pack, so_far, unpack

PIECES = 1024


def ordered_concat(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    piece: str,
    out: str,
    size: int = PIECES,
    also: Mapping[str, tuple[Column, Callable[[str], Column]]] | None = None,
) -> DataFrame:
    """Text pieces of each key joined in order.

    Pieces are first joined within slices of the order column, which spreads a key with
    very many pieces over tasks; the last step joins only the slices. ``also`` names
    further aggregates: one over the pieces and the one that merges it over slices.
    """
    also = also or {}

    def joined(rows: str) -> Column:
        return F.array_join(F.array_sort(F.collect_list(rows))["p"], "")

    keys = list(keys)
    sliced = (
        df.withColumn("__slice", int_chunk(F.col(order), size))
        .withColumn("__row", F.struct(F.col(order).alias("o"), F.col(piece).alias("p")))
        .groupBy(*keys, "__slice")
        .agg(joined("__row").alias("__text"), *[first.alias(name) for name, (first, _) in also.items()])
        .withColumn("__row", F.struct(F.col("__slice").alias("o"), F.col("__text").alias("p")))
    )
    return sliced.groupBy(*keys).agg(
        joined("__row").alias(out), *[merge(name).alias(name) for name, (_, merge) in also.items()]
    )


def delta_content(line: Column) -> Column:
    """Text delta of one event line; null for anything else."""
    trimmed = F.trim(F.regexp_replace(line, r"\r$", ""))
    data = F.trim(F.substr(trimmed, F.lit(len("data: ") + 1)))
    parsed = F.when(
        F.startswith(trimmed, F.lit("data: ")) & (data != "[DONE]"), F.try_parse_json(data)
    )
    return F.nullif(F.try_variant_get(parsed, "$.choices[0].delta.content", "string"), F.lit(""))


def _split_chunks(chunks: DataFrame, slice_size: int) -> DataFrame:
    """Each chunk as head piece, text of its whole lines, and tail piece.

    The whole lines of a chunk are read where they are; only the first and last piece may
    belong to lines that cross into other chunks. ``first`` numbers the line of the head:
    a running count of line feeds per response is all the order that is needed.
    """
    lines = F.split("chunk", "\n")
    inner = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 2, F.lit(0)))
    deltas = F.filter(F.transform(inner, delta_content), lambda d: d.isNotNull())
    pieces = chunks.select(
        "request_id",
        "seq",
        "ts",
        (F.size(lines) - 1).alias("feeds"),
        F.get(lines, F.lit(0)).alias("head"),
        F.when(F.size(lines) > 1, F.element_at(lines, -1)).alias("tail"),
        deltas.alias("deltas"),
    )
    counted = chunked_scan(
        pack(pieces, ["request_id"]),
        [F.col("seq")],
        by_number(F.col("seq"), slice_size),
        local={"__to_here": lambda w: F.sum("feeds").over(so_far(w))},
        summary={"__total": F.sum("feeds")},
        carry={"__before": lambda w: F.sum("__total").over(w)},
    )
    first = F.coalesce("__before", F.lit(0)) + F.col("__to_here") - F.col("feeds")
    return unpack(counted.withColumn("first", first)).drop("__to_here", "__before")


def sse_transcripts(
    chunks: DataFrame, started: DataFrame | None = None, slice_size: int = PIECES
) -> DataFrame:
    """Text, token count, time to first token, latency and tokens per second.

    Lines cut by chunk boundaries are put together first. ``started`` gives
    ``started_at`` per request; the first chunk counts otherwise. Requests without any
    text keep an empty transcript and a null time to first token.
    """
    spans = chunks.groupBy("request_id").agg(F.min("ts").alias("__first"), F.max("ts").alias("__last"))
    if started is not None:
        spans = spans.join(started.select("request_id", "started_at"), "request_id", "left")
        begin = F.coalesce("started_at", "__first")
    else:
        begin = F.col("__first")
    spans = spans.select("request_id", begin.alias("__begin"), "__last")

    split = _split_chunks(chunks, slice_size)
    # An empty head is kept where it ends its line, so the line is timed by that chunk.
    head = F.when((F.col("feeds") > 0) | (F.col("head") != ""), F.col("head"))
    tail = F.nullif(F.col("tail"), F.lit(""))
    ends = F.array(
        F.struct(F.col("first").alias("line_no"), head.alias("piece")),
        F.struct((F.col("first") + F.col("feeds")).alias("line_no"), tail.alias("piece")),
    )
    crossing = split.select("request_id", "seq", "ts", F.inline(ends)).where(F.col("piece").isNotNull())
    stitched = ordered_concat(
        crossing, ["request_id", "line_no"], "seq", "piece", "line", slice_size, {"ts": (F.max("ts"), F.max)}
    )
    tokens = (
        stitched.select("request_id", "line_no", "ts", delta_content(F.col("line")).alias("token"))
        .where(F.col("token").isNotNull())
        .withColumn("n", F.lit(1))
    )
    inner = split.where(F.size("deltas") > 0).select(
        "request_id",
        (F.col("first") + 1).alias("line_no"),
        "ts",
        F.array_join("deltas", "").alias("token"),
        F.size("deltas").alias("n"),
    )
    texts = ordered_concat(
        tokens.unionByName(inner),
        ["request_id"],
        "line_no",
        "token",
        "text",
        slice_size,
        also={"output_tokens": (F.sum("n"), F.sum), "__token_ts": (F.min("ts"), F.min)},
    )

    def ms(later: str) -> Column:
        return (F.unix_micros(later) - F.unix_micros("__begin")) / 1000.0

    count = F.coalesce("output_tokens", F.lit(0))
    rate = count / F.nullif(ms("__last") / 1000.0, F.lit(0.0))
    return spans.join(texts, "request_id", "left").select(
        "request_id",
        F.coalesce("text", F.lit("")).alias("text"),
        count.alias("output_tokens"),
        ms("__token_ts").alias("ttft_ms"),
        ms("__last").alias("latency_ms"),
        F.when(ms("__last") > 0, rate).otherwise(0.0).alias("tokens_per_s"),
    )
