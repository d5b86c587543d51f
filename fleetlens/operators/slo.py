"""Service-level indicators, alarms, traffic and quotas over request telemetry."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.status import success_flag
from fleetlens.operators.quantiles import exact_quantiles
from fleetlens.operators.scan import running_totals

NODE_QUANTILES = {"latency_p50_ms": 0.5, "latency_p95_ms": 0.95, "latency_p99_ms": 0.99}
# Default targets and limits.
SLA_P95_MS = 30000.0
DAILY_LIMIT = 10000
RATE_LIMIT = 15
RATE_WINDOW_S = 10


@dataclass(frozen=True)
class AlarmRule:
    """A mean over a period compared with a threshold; ``below`` picks the side."""

    alarm: str
    metric: str
    threshold: float
    period_s: int
    below: bool


# The alarm rules of the fleet.
ALARM_RULES = (
    AlarmRule("GatewayAvailabilityLow", "availability", 0.999, 300, True),
    AlarmRule("GatewayLatencyHigh", "latency_ms", 4500.0, 300, False),
    AlarmRule("BatchReliabilityLow", "batch_reliability", 0.995, 3600, True),
    AlarmRule("FailoverRTOHigh", "failover_rto_seconds", 30.0, 60, False),
)


def sli_availability(requests: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Percentage of successful requests; 0 when there are none."""
    share = F.coalesce(F.avg(success_flag(F.col("status"))) * 100.0, F.lit(0.0))
    return requests.groupBy(*by).agg(share.alias("availability"))


def sli_p95_latency(requests: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """95th percentile latency over all requests; 0 when there are none."""
    return _zero_filled(requests, by, "latency_ms", {"p95_ms": 0.95})


def sli_batch_reliability(jobs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Percentage of jobs that completed; anything else counts against."""
    done = (F.upper("status") == "COMPLETED").cast("double")
    share = F.coalesce(F.avg(done) * 100.0, F.lit(0.0))
    return jobs.groupBy(*by).agg(share.alias("batch_reliability"))


def _zero_filled(
    df: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float]
) -> DataFrame:
    found = exact_quantiles(df, by, value, probs)
    if not by:
        return found.agg(*[F.coalesce(F.max(n), F.lit(0.0)).alias(n) for n in probs])
    groups = df.select(*by).distinct()
    return groups.join(found, list(by), "left").fillna(0.0, list(probs))


def latency_quantiles(
    samples: DataFrame,
    by: Sequence[str] = ("cluster_id", "node"),
    value: str = "latency_ms",
    *,
    nodes: DataFrame | None = None,
) -> DataFrame:
    """p50, p95 and p99 per node; nodes of ``nodes`` without samples get 0."""
    found = exact_quantiles(samples, by, value, NODE_QUANTILES)
    if nodes is None:
        return found
    listed = nodes.select(*by).distinct()
    return listed.join(found, list(by), "left").fillna(0.0, list(NODE_QUANTILES))


def request_quantiles(requests: DataFrame, by: Sequence[str]) -> DataFrame:
    """p50, p95 and p99 per group of all its requests and, as ``served_...``, of the successful ones.

    Every group has a row: null where no request has a latency, 0 where no successful one has.
    """
    served = F.coalesce(success_flag(F.col("status")) == 1, F.lit(False))
    kinds = F.when(served, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    marked = requests.select(*by, "latency_ms", F.explode(kinds).alias("__served"))
    found = exact_quantiles(marked, [*by, "__served"], "latency_ms", NODE_QUANTILES)
    rows = found.unionByName(requests.select(*by).distinct(), allowMissingColumns=True)
    every = [F.max(F.when(~F.col("__served"), F.col(n))).alias(n) for n in NODE_QUANTILES]
    good = [F.coalesce(F.max(F.when(F.col("__served"), F.col(n))), F.lit(0.0)).alias(f"served_{n}") for n in NODE_QUANTILES]
    return rows.groupBy(*by).agg(*every, *good)


def with_sla_flag(quantiles: DataFrame, target_ms: float = SLA_P95_MS, kind: str = "") -> DataFrame:
    """p95 within target; a target of 0 or less, or no samples, always passes. ``kind`` precedes both columns' names."""
    p95 = F.col(f"{kind}latency_p95_ms")
    ok = F.lit(True) if target_ms <= 0 else (p95.isNull() | (p95 <= F.lit(float(target_ms))))
    return quantiles.withColumn(f"{kind}sla_ok", ok)


def status_histogram(
    requests: DataFrame, by: Sequence[str] = (), expected_ok: int | None = None
) -> DataFrame:
    """Requests per HTTP status; on the 200 row, whether the count is as expected."""
    counted = requests.groupBy(*by, "status").agg(F.count(F.lit(1)).alias("requests"))
    if expected_ok is None:
        return counted
    as_expected = F.when(F.col("status") == 200, F.col("requests") == F.lit(expected_ok))
    return counted.withColumn("as_expected", as_expected)


def traffic_by_minute(requests: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Requests, 4xx and 5xx per minute."""
    status = F.col("status")
    return _per_window(
        requests,
        by,
        "1 minute",
        F.count(F.lit(1)).alias("requests"),
        F.count_if((status >= 400) & (status < 500)).alias("errors_4xx"),
        F.count_if((status >= 500) & (status < 600)).alias("errors_5xx"),
    )


def _per_window(df: DataFrame, by: Sequence[str], width: str, *aggs: Column) -> DataFrame:
    return (
        df.groupBy(*by, F.window("ts", width).alias("w"))
        .agg(*aggs)
        .withColumn("window_start", F.col("w.start"))
        .drop("w")
    )


def latency_by_minute(requests: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean and p99 latency per minute."""
    keyed = requests.withColumn("window_start", F.date_trunc("minute", F.col("ts")))
    keys = [*by, "window_start"]
    means = keyed.groupBy(*keys).agg(F.avg("latency_ms").alias("avg_ms"))
    p99 = exact_quantiles(keyed, keys, "latency_ms", {"p99_ms": 0.99})
    return means.join(p99, keys, "left")


def rto_hourly(retries: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Largest and p99 time to first retry per hour."""
    keyed = retries.withColumn("window_start", F.date_trunc("hour", F.col("ts")))
    keys = [*by, "window_start"]
    largest = keyed.groupBy(*keys).agg(F.max("elapsed_seconds").alias("max_rto_s"))
    p99 = exact_quantiles(keyed, keys, "elapsed_seconds", {"p99_rto_s": 0.99})
    return largest.join(p99, keys, "left")


def alarm_eval(
    samples: DataFrame,
    rules: Sequence[AlarmRule] = ALARM_RULES,
    by: Sequence[str] = ("cluster_id",),
) -> DataFrame:
    """Each rule's mean per period and whether it breaches.

    The rules become case expressions on the metric name, so one pass over the samples
    serves all of them and the partial means shrink the shuffle to one row per period.
    """
    return evaluate_rules(
        samples.where(F.col("metric").isin(*[r.metric for r in rules]))
        .withColumn("period_s", rule_value(rules, "period_s"))
        .withColumn("window_start", period_start(F.col("ts"), F.col("period_s")))
        .groupBy(*by, "metric", "window_start")
        .agg(F.avg("value").alias("mean")),
        rules,
    )


def rule_value(rules: Sequence[AlarmRule], field: str) -> Column:
    out = F.lit(None)
    for rule in rules:
        out = F.when(F.col("metric") == rule.metric, F.lit(getattr(rule, field))).otherwise(out)
    return out


def period_start(ts: Column, period_s: Column) -> Column:
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / period_s) * period_s)


def evaluate_rules(means: DataFrame, rules: Sequence[AlarmRule]) -> DataFrame:
    below = rule_value(rules, "below")
    threshold = rule_value(rules, "threshold")
    breach = F.when(below, F.col("mean") < threshold).otherwise(F.col("mean") > threshold)
    return means.withColumn("alarm", rule_value(rules, "alarm")).withColumn("breach", breach)


def daily_quota(requests: DataFrame, limit: int = DAILY_LIMIT) -> DataFrame:
    """Requests per API key and UTC day, and how far each is over the limit."""
    return (
        requests.groupBy("api_key_id", F.to_date("ts").alias("day"))
        .agg(F.count(F.lit(1)).alias("requests"))
        .withColumn("over_quota", F.greatest(F.col("requests") - F.lit(limit), F.lit(0)))
    )


def rate_limit_pressure(
    requests: DataFrame,
    by: Sequence[str] = ("cluster_id",),
    *,
    limit: int = RATE_LIMIT,
    window_s: float = RATE_WINDOW_S,
) -> DataFrame:
    """Requests in the trailing window, this one included, compared with the limit."""
    now = F.unix_micros("ts")
    counted = running_totals(
        requests, by, now, now + F.lit(int(window_s * 1_000_000)), {"in_window": F.lit(1)}, split=True
    )
    return counted.withColumn("over_limit", F.col("in_window") > F.lit(limit))
