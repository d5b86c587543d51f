"""Streaming forms of the operators, each a transformation of a streaming DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.operators.slo import AlarmRule, evaluate_rules
from fleetlens.streaming import processors as p

LATENESS = "10 minutes"


def deduplicated(stream: DataFrame, ids: Sequence[str], lateness: str = LATENESS) -> DataFrame:
    """Drop repeats of at-least-once shipping within the watermark."""
    return stream.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(list(ids))


def _tumbling(
    stream: DataFrame, by: Sequence[str], period: str, lateness: str, *aggs: Column
) -> DataFrame:
    return (
        stream.withWatermark("ts", lateness)
        .groupBy(*by, F.window("ts", period).alias("__w"))
        .agg(*aggs)
        .withColumn("window_start", F.col("__w.start"))
        .drop("__w")
    )


def stream_sli(
    samples: DataFrame, rule: AlarmRule, by: Sequence[str] = ("cluster_id",), lateness: str = LATENESS
) -> DataFrame:
    """Mean of a rule's metric per period with its alarm flag, once the period has closed.

    Samples without a metric move the watermark, as the closing mark does, but are in no mean.
    """
    mine = F.col("metric") == rule.metric
    means = _tumbling(
        samples.where(mine | F.col("metric").isNull()), by, f"{rule.period_s} seconds", lateness,
        F.avg(F.when(mine, F.col("value"))).alias("mean"), F.count_if(mine).alias("__samples"),
    )
    return evaluate_rules(means.where("__samples > 0").withColumn("metric", F.lit(rule.metric)), [rule]).drop("__samples")


def stream_traffic(requests: DataFrame, by: Sequence[str] = (), lateness: str = LATENESS) -> DataFrame:
    """Requests, 4xx and 5xx per minute, once the minute has closed."""
    status = F.col("status")
    return _tumbling(
        requests,
        by,
        "1 minute",
        lateness,
        F.count(F.lit(1)).alias("requests"),
        F.count_if((status >= 400) & (status < 500)).alias("errors_4xx"),
        F.count_if((status >= 500) & (status < 600)).alias("errors_5xx"),
    )


def stream_outages(
    probes: DataFrame, threshold: int = 3, lateness: str = LATENESS, silent_s: float = p.SILENT_S
) -> DataFrame:
    """FAILOVER, RESPAWN and SILENT events per node; probes behind the watermark are flagged ``late``."""
    return p.ordered(probes, ["cluster_id", "node"], ["seq", "healthy"], p.OutageProcessor(threshold, silent_s), lateness)


def stream_sla_state(
    samples: DataFrame, target_ms: float = 30000.0, size: int = 1024, lateness: str = LATENESS, silent_s: float = p.SILENT_S
) -> DataFrame:
    """p95 and SLA flag of the last samples per node, one row per node and release.

    Where samples have ``success``, failed ones do not count; null latencies never do.
    """
    if "success" in samples.columns:
        samples = samples.where(F.col("success") | F.col("success").isNull() & F.col("latency_ms").isNull())
    machine = p.SlaProcessor(target_ms, size, silent_s)
    return p.ordered(samples, ["cluster_id", "node"], ["seq", "latency_ms"], machine, lateness)


def stream_alert_hold(
    samples: DataFrame, hold_s: float = 30.0, lateness: str = LATENESS, silent_s: float = p.SILENT_S
) -> DataFrame:
    """One firing event per run of zero status held long enough."""
    return p.ordered(samples, ["cluster_id", "node"], ["seq", "value"], p.AlertHoldProcessor(hold_s, silent_s), lateness)


def stream_rate_limit(requests: DataFrame, limit: int = 15, window_s: float = 10.0, lateness: str = LATENESS) -> DataFrame:
    """Accept or reject per API key."""
    return p.ordered(requests, ["api_key_id"], ["request_id"], p.RateLimitProcessor(limit, window_s), lateness)


def stream_rto(ops_events: DataFrame, lateness: str = LATENESS, silent_s: float = p.SILENT_S) -> DataFrame:
    """Time from failover to first retry per cluster; failovers with ``routing_impact`` false do not count."""
    # Rows without an event move the watermark; the machine passes over them.
    events = ops_events.where(F.col("event").isin("FAILOVER", "RETRY") | F.col("event").isNull())
    if "routing_impact" in ops_events.columns:
        events = events.where(~F.col("event").eqNullSafe("FAILOVER") | F.col("routing_impact"))
    return p.ordered(events, ["cluster_id"], ["seq", "event", "node"], p.RtoProcessor(silent_s), lateness)


def stream_job_state(job_events: DataFrame, lateness: str = LATENESS, silent_s: float = p.SILENT_S) -> DataFrame:
    """Newest status per job; later rows of a job supersede earlier ones."""
    return p.ordered(job_events, ["job_id"], ["seq", "ray_status"], p.JobStateProcessor(silent_s), lateness)


def stream_transcripts(chunks: DataFrame, timeout_s: float = 600.0, lateness: str = LATENESS) -> DataFrame:
    """Transcript and timing per streamed response; ``started_at`` is used where present."""
    columns = [c for c in ("request_id", "seq", "ts", "chunk", "started_at") if c in chunks.columns]
    timed = chunks.withWatermark("ts", lateness).select(p.shard("request_id"), *columns)
    return p.keyed(timed, ["shard"], p.TranscriptProcessor(timeout_s), ["request_id", "seq"], event_time=True)
