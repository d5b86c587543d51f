"""Exact interpolated quantiles without holding a group's values in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

# Buckets per factor of two: one bucket spans about 0.07 % of its value.
RESOLUTION = 1024
# Linear parts a wanted bucket is cut into.
PARTS = 4096
# Below every base-2 logarithm of a double, so that bucket numbers stay positive.
LOWEST_EXPONENT = 1100


def _magnitude(value: Column) -> Column:
    """Order-preserving bucket of a double, relative to its own size."""
    exponent = F.least(F.log2(F.abs(value)), F.lit(1025.0))  # infinity has a bucket of its own
    steps = F.floor(exponent * RESOLUTION) + F.lit(LOWEST_EXPONENT * RESOLUTION)
    zero = F.lit(0).cast("long")
    return F.coalesce(F.when(value != 0, F.signum(value).cast("long") * steps), zero)


def _part(value: Column, low: Column, high: Column) -> Column:
    """Order-preserving linear part of a bucket that spans ``low`` to ``high``."""
    zero = F.lit(0).cast("long")
    return F.coalesce(F.when(high > low, F.floor((value - low) / (high - low) * PARTS)), zero)


def _holds(start: Column, size: Column, n: Column, p: float, upper: bool) -> Column:
    """Whether ranks ``start`` up to ``start + size`` include a rank p interpolates between."""
    position = (n - 1) * F.lit(float(p))
    wanted = F.ceil(position) if upper else F.floor(position)
    return (wanted >= start) & (wanted < start + size)


def _holds_any(start: Column, size: Column, n: Column, probs: Mapping[str, float]) -> Column:
    hit = F.lit(False)
    for p in probs.values():
        for upper in (False, True):
            hit = hit | _holds(start, size, n, p, upper)
    return hit


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    *,
    count: str | None = None,
) -> DataFrame:
    """Linear-interpolation quantiles of ``value`` per group, at position (n-1)*p.

    ``probs`` maps output column to probability. Groups without a value do not appear.
    No task ever holds a group:

    1. rows are counted per (group, value), which spreads a hot group over all tasks;
    2. the counts are summed per logarithmic bucket and scanned, a few thousand rows per
       group at most, to find the buckets that hold the wanted ranks;
    3. those buckets alone are cut into equal parts and searched the same way;
    4. the distinct values of the parts found are scanned to the exact ranks.
    """
    # The keys travel as one struct, which is never null: rows with null keys keep their
    # group, and the joins below add no filters that would make Spark count again.
    groups = ["__key"]
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    values = df.select(key.alias("__key"), F.col(value).cast("double").alias("__v")).where(
        F.col("__v").isNotNull() & ~F.isnan("__v")
    )
    # Adding 0.0 folds -0.0 into 0.0, so both count as one value.
    hist = (
        values.withColumn("__v", F.col("__v") + F.lit(0.0))
        .groupBy(*groups, "__v")
        .agg(F.count(F.lit(1)).alias("__c"))
        .withColumn("__b", _magnitude(F.col("__v")))
    )

    def preceding(partition: Sequence[str], order: str) -> WindowSpec:
        return Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)

    def before(size: str, partition: Sequence[str], order: str) -> Column:
        return F.coalesce(F.sum(size).over(preceding(partition, order)), F.lit(0))

    n = F.col("__n")
    buckets = (
        hist.groupBy(*groups, "__b")
        .agg(F.sum("__c").alias("__size"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
        .withColumn("__start", before("__size", groups, "__b"))
        .withColumn("__n", F.sum("__size").over(Window.partitionBy(*groups)))
        .where(_holds_any(F.col("__start"), F.col("__size"), n, probs))
        .drop("__size")
    )
    near = hist.join(buckets, [*groups, "__b"]).withColumn(
        "__part", _part(F.col("__v"), F.col("__low"), F.col("__high"))
    )
    bucket = [*groups, "__b"]
    parts = (
        near.groupBy(*bucket, "__part")
        .agg(F.sum("__c").alias("__size"), F.max("__start").alias("__from"), F.max("__n").alias("__n"))
        .withColumn("__from", F.col("__from") + before("__size", bucket, "__part"))
        .where(_holds_any(F.col("__from"), F.col("__size"), n, probs))
        .select(*bucket, "__part", "__from")
    )
    part = [*bucket, "__part"]
    ranked = near.join(parts, part).withColumn("__at", F.col("__from") + before("__c", part, "__v"))

    picks = [F.max("__n").alias("__n")]
    for name, p in probs.items():
        for upper, tag in ((False, "lo"), (True, "hi")):
            here = _holds(F.col("__at"), F.col("__c"), n, p, upper)
            picks.append(F.max(F.when(here, F.col("__v"))).alias(f"__{tag}_{name}"))
    found = ranked.groupBy(*groups).agg(*picks)

    out = [F.col(f"__key.{k}") for k in keys]
    if count:
        out.append(n.alias(count))
    for name, p in probs.items():
        low, high = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        position = (n - 1) * F.lit(float(p))
        out.append((low + (high - low) * (position - F.floor(position))).alias(name))
    return found.select(*out)
