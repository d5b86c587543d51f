"""Rolling quantiles and counter rates per node."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, floor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.operators.scan import (
    DEFAULT_CHUNK_S,
    by_time,
    int_chunk,
    row_index,
)

SAMPLES = 1024
BLOCK = 16384
RATE_S = 60.0
PROBS = (0.5, 0.95, 0.99)
QUANTILE_COLUMNS = ("p50", "p95", "p99")


def interpolate(ordered: Sequence[float], p: float) -> float:
    """Value at position (n-1)*p of sorted samples, 0 without any."""
    if not ordered:
        return 0.0
    at = (len(ordered) - 1) * p
    low, high = ordered[floor(at)], ordered[ceil(at)]
    return low + (high - low) * (at - floor(at))


def window_quantiles(values: np.ndarray, size: int, probs: Sequence[float] = PROBS) -> np.ndarray:
    """Interpolated quantiles of the last ``size`` values at each place: [place, quantile].

    A wavelet matrix over the ranks of the values: bit by bit, from the highest, values with a 0 go before those with
    a 1, and a count of zeros tells where a window goes and on which side its k-th value is. All windows and quantiles
    take each step at once, so the work is n log n, whatever the size of the window.
    """
    n = len(values)
    order = np.argsort(values, kind="stable")
    level = np.empty(n, np.int64)
    level[order] = np.arange(n)
    right = np.arange(1, n + 1)
    left = np.maximum(right - size, 0)
    position = (right - left - 1)[None, :] * np.asarray(probs)[:, None]
    k = np.concatenate((np.floor(position), np.ceil(position))).astype(np.int64)
    l, r = np.broadcast_to(left, k.shape), np.broadcast_to(right, k.shape)
    rank = np.zeros_like(k)
    for bit in range(max(n - 1, 0).bit_length() - 1, -1, -1):
        ones = (level >> bit & 1).astype(bool)
        zeros = np.concatenate(([0], np.cumsum(~ones)))
        before, upto = zeros[l], zeros[r]
        high = k >= upto - before
        rank |= high.astype(np.int64) << bit
        k = np.where(high, k - (upto - before), k)
        l, r = np.where(high, zeros[-1] + l - before, before), np.where(high, zeros[-1] + r - upto, upto)
        level = np.concatenate((level[~ones], level[ones]))
    found = values[order][rank] if n else np.zeros(k.shape)
    low, up = found[: len(probs)], found[len(probs) :]
    return (low + (up - low) * (position - np.floor(position))).T


def _roll(pdf: pd.DataFrame, size: int) -> pd.DataFrame:
    """Quantiles of the last ``size`` values at each row, context rows dropped."""
    pdf = pdf.sort_values("__rn", ignore_index=True)
    pdf[list(QUANTILE_COLUMNS)] = window_quantiles(pdf["__value"].to_numpy(float), size)
    return pdf[~pdf["__context"]]


def rolling_quantiles(
    samples: DataFrame,
    by: Sequence[str] = ("cluster_id", "node"),
    value: str = "latency_ms",
    *,
    size: int = SAMPLES,
    block: int = BLOCK,
    chunk_s: float = DEFAULT_CHUNK_S,
) -> DataFrame:
    """p50, p95 and p99 of the last ``size`` samples of the node, at each sample.

    Samples (ts, seq, value) are numbered per node and cut into blocks; each block also
    receives the ``size - 1`` samples before it. A task holds one block, whatever the
    node's share of the data. Within a block all windows are answered at once
    (:func:`window_quantiles`), as the built-in percentile would sort the whole frame again for every row. Null and NaN
    values are no samples.
    """
    by = list(by)
    blocks = sample_blocks(samples, by, value, size, block, chunk_s)
    schema = T.StructType(
        [*blocks.schema.fields, *[T.StructField(c, T.DoubleType()) for c in QUANTILE_COLUMNS]]
    )
    rolled = blocks.groupBy(*by, "__block").applyInPandas(lambda pdf: _roll(pdf, size), schema)
    return rolled.select(*by, "ts", "seq", *QUANTILE_COLUMNS)


def sample_blocks(
    samples: DataFrame, by: Sequence[str], value: str, size: int, block: int, chunk_s: float
) -> DataFrame:
    """Samples with the block they belong to, and copies as context for the next blocks."""
    numbered = row_index(
        samples.select(*by, "ts", "seq", F.col(value).cast("double").alias("__value")).where(
            F.col("__value").isNotNull() & ~F.isnan("__value")
        ),
        by,
        [F.col("ts"), F.col("seq")],
        by_time(F.col("ts"), chunk_s),
        "__rn",
    )
    own = int_chunk(F.col("__rn") - 1, block)
    reach = int_chunk(F.col("__rn") + (size - 2), block)
    return (
        numbered.withColumn("__own", own)
        .withColumn("__block", F.explode(F.sequence(own, reach)))
        .withColumn("__context", F.col("__block") != F.col("__own"))
        .drop("__own")
    )


def _rates(pdf: pd.DataFrame, reach: int) -> pd.DataFrame:
    """Per-second increases of one slice, margin rows dropped."""
    pdf = pdf.sort_values(["__us", "seq"], ignore_index=True)
    us, value = pdf["__us"].to_numpy(np.int64), pdf["__value"].to_numpy(float)
    step = np.diff(value, prepend=value[0])
    grown = np.cumsum(np.where(step < 0, value, step).astype(np.longdouble))
    first, last = np.searchsorted(us, us - reach), np.searchsorted(us, us, side="right") - 1
    rate = ((grown[last] - grown[first]) / (reach / 1e6)).astype(float)
    pdf["per_second"] = np.where(last > first, rate, np.nan)
    return pdf[pdf["__own"] == pdf["__slice"]]


def counter_rate(
    samples: DataFrame,
    by: Sequence[str] = ("cluster_id", "node"),
    *,
    range_s: float = RATE_S,
    chunk_s: float = DEFAULT_CHUNK_S,
) -> DataFrame:
    """Per-second increase of a counter over the trailing range, at each sample.

    A drop is a restart from zero. Only increases between two samples of the range
    count; a range with a single sample has no rate. Nothing is extrapolated to the
    range's edges. Samples at the same time see each other; rows without a time or a value are no samples.

    Samples are cut into time slices of ``chunk_s``, or four ranges if that is longer, and each slice also receives the
    samples of the range before it, a quarter more at most where they are even. So one shuffle brings together all that a rate depends on, a task holds one slice of one
    key, and sums start anew in every slice, so that no rounding error grows with the history.
    """
    by = list(by)
    reach = int(range_s * 1_000_000)
    width = max(4 * reach, int(chunk_s * 1_000_000))
    us = F.unix_micros("ts")
    rows = samples.select(*by, "ts", "seq", F.col("value").cast("double").alias("__value"), us.alias("__us"))
    rows = rows.where(F.col("__us").isNotNull() & F.col("__value").isNotNull()).withColumn("__own", int_chunk(F.col("__us"), width))
    sliced = rows.withColumn("__slice", F.explode(F.sequence("__own", int_chunk(F.col("__us") + reach, width))))
    schema = T.StructType([*sliced.schema.fields, T.StructField("per_second", T.DoubleType())])
    rated = sliced.groupBy(*by, "__slice").applyInPandas(lambda pdf: _rates(pdf, reach), schema)
    per_second = F.nanvl("per_second", F.lit(None).cast("double"))
    return rated.select(*by, "ts", "seq", per_second.alias("per_second"), (per_second * 60.0).alias("per_minute"))
