"""Batch form of the rate limiter: which requests would have been accepted."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.operators.scan import DEFAULT_CHUNK_S, by_time, chunked_scan, pack, previous_row, so_far, unpack
from fleetlens.operators.slo import RATE_LIMIT, RATE_WINDOW_S

MICROS = 1_000_000


def admit(times: np.ndarray, accepted: deque, limit: int, window_us: int) -> np.ndarray:
    """Label sorted times accepted or not, updating the accepted times in place.

    At most ``limit`` accepted times lie in the trailing window; one exactly a window old
    still counts, and rejected requests do not. While the window is full every request is
    rejected until its oldest entry expires, so the steps taken are as few as the accepted.
    """
    labels = np.zeros(len(times), dtype=bool)
    at = 0
    while limit > 0 and at < len(times):
        now = times[at]
        while accepted and accepted[0] < now - window_us:
            accepted.popleft()
        if len(accepted) < limit:
            labels[at] = True
            accepted.append(int(now))
            at += 1
        else:
            at = int(np.searchsorted(times, accepted[0] + window_us, side="right"))
    return labels


def rate_limit_labels(
    requests: DataFrame,
    key: str = "api_key_id",
    *,
    limit: int = RATE_LIMIT,
    window_s: float = RATE_WINDOW_S,
    chunk_s: float = DEFAULT_CHUNK_S,
) -> DataFrame:
    """Label requests accepted or rejected; only accepted ones count against the limit.

    Each label depends on the labels before it, so rows must be stepped through in order.
    After a pause longer than the window nothing is remembered; requests are therefore
    cut at such pauses, and the runs between them spread over tasks independently. Rows
    pass through a task in sorted batches, with only the accepted times of the current
    window held, so a long run needs no more memory than a short one.
    """
    window_us = int(window_s * MICROS)
    rows = pack(requests.select(key, "ts", "request_id"), [key])
    slices = by_time(F.col("ts"), chunk_s)
    paused = previous_row(rows, ["ts", "request_id"], slices, F.unix_micros("ts"), "__prev")
    at = F.unix_micros("ts")
    opens = F.col("__prev").isNull() | (at - F.col("__prev") > window_us)
    scanned = chunked_scan(
        paused.withColumn("__open", F.when(opens, at)),
        [F.col("ts"), F.col("request_id")],
        None,
        local={"__here": lambda w: F.max("__open").over(so_far(w))},
        summary={"__latest": F.max("__open")},
        carry={"__earlier": lambda w: F.max("__latest").over(w)},
    )
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    runs = unpack(scanned).select(
        key,
        F.concat_ws(" ", F.coalesce("__here", "__earlier"), F.col(key).isNull(), name).alias("__run"),
        at.alias("__at"),
        "ts",
        "request_id",
    )
    ordered = runs.repartition("__run").sortWithinPartitions("__run", "__at", "request_id")

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, accepted = None, deque()
        for pdf in batches:
            if pdf.empty:
                continue
            run, times = pdf["__run"].to_numpy(), pdf["__at"].to_numpy()
            edges = [0, *(np.flatnonzero(run[1:] != run[:-1]) + 1), len(run)]
            labels = []
            for first, last in zip(edges, edges[1:]):
                if run[first] != current:
                    current, accepted = run[first], deque()
                labels.append(admit(times[first:last], accepted, limit, window_us))
            yield pdf.assign(accepted=np.concatenate(labels))

    schema = T.StructType([*ordered.schema.fields, T.StructField("accepted", T.BooleanType())])
    return ordered.mapInPandas(label, schema).drop("__run", "__at")
