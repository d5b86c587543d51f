"""Request and SLO queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.status import memory_pct, success_flag
from fleetlens.operators import slo
from fleetlens.operators.incidents import failover_rto
from fleetlens.plans.fixtures import Tables, with_views
from fleetlens.plans.registry import Query


def _alarm_samples(t: Tables):
    """Availability, latency, batch reliability and RTO samples in one long table."""
    gateway = t.requests.select(
        "cluster_id",
        "ts",
        F.inline(
            F.array(
                F.struct(F.lit("availability").alias("metric"), success_flag(F.col("status")).alias("value")),
                F.struct(F.lit("latency_ms").alias("metric"), F.col("latency_ms").alias("value")),
            )
        ),
    )
    jobs = t.batch_jobs.select(
        F.lit(0).alias("cluster_id"),
        F.col("created_at").alias("ts"),
        F.lit("batch_reliability").alias("metric"),
        (F.upper("status") == "COMPLETED").cast("double").alias("value"),
    )
    rto = failover_rto(t.ops_events).select(
        "cluster_id", "ts", F.lit("failover_rto_seconds").alias("metric"), F.col("elapsed_seconds").alias("value")
    )
    return gateway.unionByName(jobs).unionByName(rto)


def _sla(t: Tables) -> DataFrame:
    """p95 and flag of each API key over all its requests, and over the successful ones."""
    found = slo.with_sla_flag(slo.request_quantiles(t.requests, ["api_key_id"]), 300.0)
    judged = slo.with_sla_flag(found, 300.0, "served_")
    return judged.select("api_key_id", *[f"{kind}{c}" for kind in ("", "served_") for c in ("latency_p95_ms", "sla_ok")])


_SERVED = "FILTER (status IN (200,201,302))"


def rto_sql(events: str = "ops_events", keys: str = "") -> str:
    return f"""SELECT {keys + ', ' if keys else ''}ts, node, failed_node, (epoch_us(ts) - epoch_us(prev_ts)) / 1e6 AS elapsed_seconds
    FROM (SELECT *, lag(event) OVER w AS prev_event, lag(ts) OVER w AS prev_ts, lag(node) OVER w AS failed_node
          FROM {events} WHERE event IN ('FAILOVER', 'RETRY') WINDOW w AS ({'PARTITION BY ' + keys if keys else ''} ORDER BY ts, seq))
    WHERE event = 'RETRY' AND prev_event = 'FAILOVER'"""


RTO_SQL = rto_sql()

QUERIES = {
    "sli_availability": Query(
        lambda t: slo.sli_availability(t.requests),
        with_views(
            "requests",
            sql="""SELECT round(coalesce(avg(CASE WHEN status IN (200,201,302) THEN 1.0 ELSE 0.0 END) * 100, 0), 6)
            AS availability FROM requests""",
        ),
    ),
    "sli_p95_latency": Query(
        lambda t: slo.sli_p95_latency(t.requests),
        with_views(
            "requests",
            sql="SELECT round(coalesce(quantile_cont(latency_ms, 0.95), 0), 6) AS p95_ms FROM requests",
        ),
    ),
    "latency_quantiles": Query(
        lambda t: slo.request_quantiles(t.requests, ["node"]),
        with_views(
            "requests",
            sql=f"""SELECT node, round(quantile_cont(latency_ms, 0.5), 6) AS latency_p50_ms,
            round(quantile_cont(latency_ms, 0.95), 6) AS latency_p95_ms,
            round(quantile_cont(latency_ms, 0.99), 6) AS latency_p99_ms,
            round(coalesce(quantile_cont(latency_ms, 0.5) {_SERVED}, 0), 6) AS served_latency_p50_ms,
            round(coalesce(quantile_cont(latency_ms, 0.95) {_SERVED}, 0), 6) AS served_latency_p95_ms,
            round(coalesce(quantile_cont(latency_ms, 0.99) {_SERVED}, 0), 6) AS served_latency_p99_ms FROM requests GROUP BY node""",
        ),
    ),
    "sla_flag": Query(
        _sla,
        with_views(
            "requests",
            sql=f"""SELECT api_key_id, round(p, 6) AS latency_p95_ms, coalesce(p <= 300.0, true) AS sla_ok,
            round(coalesce(s, 0), 6) AS served_latency_p95_ms, coalesce(s <= 300.0, true) AS served_sla_ok FROM
            (SELECT api_key_id, quantile_cont(latency_ms, 0.95) AS p, quantile_cont(latency_ms, 0.95) {_SERVED} AS s FROM requests GROUP BY 1)""",
        ),
    ),
    "sli_batch_reliability": Query(
        lambda t: slo.sli_batch_reliability(t.batch_jobs),
        with_views(
            "batch_jobs",
            sql="""SELECT round(coalesce(avg(CASE WHEN upper(status) = 'COMPLETED' THEN 1.0 ELSE 0.0 END) * 100, 0), 6)
            AS batch_reliability FROM batch_jobs""",
        ),
    ),
    "status_success_flag": Query(
        lambda t: t.requests.select("request_id", "status", success_flag(F.col("status")).alias("success")),
        with_views(
            "requests",
            sql="""SELECT request_id, status,
            CAST(CASE WHEN status IN (200,201,302) THEN 1 ELSE 0 END AS DOUBLE) AS success FROM requests""",
        ),
    ),
    "status_histogram": Query(
        lambda t: slo.status_histogram(t.requests, expected_ok=200),
        with_views(
            "requests",
            sql="""SELECT status, count(*) AS requests,
            CASE WHEN status = 200 THEN count(*) = 200 END AS as_expected FROM requests GROUP BY status""",
        ),
    ),
    "traffic_by_minute": Query(
        lambda t: slo.traffic_by_minute(t.requests),
        with_views(
            "requests",
            sql="""SELECT date_trunc('minute', ts) AS window_start, count(*) AS requests,
            count(*) FILTER (status >= 400 AND status < 500) AS errors_4xx,
            count(*) FILTER (status >= 500 AND status < 600) AS errors_5xx FROM requests GROUP BY 1""",
        ),
    ),
    "latency_by_minute": Query(
        lambda t: slo.latency_by_minute(t.requests),
        with_views(
            "requests",
            sql="""SELECT date_trunc('minute', ts) AS window_start, round(avg(latency_ms), 6) AS avg_ms,
            round(quantile_cont(latency_ms, 0.99), 6) AS p99_ms FROM requests GROUP BY 1""",
        ),
    ),
    "rto_hourly": Query(
        # Times are whole microseconds and the 99th percentile lies on hundredths between two of them, so hundredths
        # of microseconds are compared as whole numbers.
        lambda t: slo.rto_hourly(failover_rto(t.ops_events)).select(
            "window_start", "max_rto_s", F.round(F.col("p99_rto_s") * 1e8).cast("long").alias("p99_rto_e8")
        ),
        with_views(
            "ops_events",
            sql=f"""SELECT date_trunc('hour', ts) AS window_start, round(max(elapsed_seconds), 6) AS max_rto_s,
            round(quantile_cont(elapsed_seconds, 0.99) * 1e8)::BIGINT AS p99_rto_e8 FROM ({RTO_SQL}) GROUP BY 1""",
        ),
    ),
    "failover_rto": Query(
        lambda t: failover_rto(t.ops_events).drop("cluster_id"),
        with_views(
            "ops_events",
            sql=f"SELECT ts, node, failed_node, round(elapsed_seconds, 6) AS elapsed_seconds FROM ({RTO_SQL})",
        ),
    ),
    "alarm_eval": Query(
        lambda t: slo.alarm_eval(_alarm_samples(t)).drop("cluster_id"),
        with_views(
            "requests",
            "batch_jobs",
            "ops_events",
            sql=f"""WITH samples AS (
              SELECT ts, 'availability' AS metric, CASE WHEN status IN (200,201,302) THEN 1.0 ELSE 0.0 END::DOUBLE AS value FROM requests
              UNION ALL SELECT ts, 'latency_ms', latency_ms FROM requests
              UNION ALL SELECT created_at, 'batch_reliability', CASE WHEN status = 'completed' THEN 1.0 ELSE 0.0 END::DOUBLE FROM batch_jobs
              UNION ALL SELECT ts, 'failover_rto_seconds', elapsed_seconds FROM ({RTO_SQL})),
            rules(alarm, metric, threshold, period, below) AS (VALUES
              ('GatewayAvailabilityLow','availability',0.999,300,true),
              ('GatewayLatencyHigh','latency_ms',4500.0,300,false),
              ('BatchReliabilityLow','batch_reliability',0.995,3600,true),
              ('FailoverRTOHigh','failover_rto_seconds',30.0,60,false))
            SELECT r.metric, r.alarm, round(avg(value), 6) AS mean,
              make_timestamp((epoch_us(ts) // (period::BIGINT * 1000000)) * period::BIGINT * 1000000) AS window_start,
              CASE WHEN any_value(below) THEN avg(value) < any_value(threshold) ELSE avg(value) > any_value(threshold) END AS breach
            FROM samples s JOIN rules r ON s.metric = r.metric GROUP BY r.metric, r.alarm, 4""",
        ),
    ),
    "daily_quota": Query(
        lambda t: slo.daily_quota(t.requests, limit=3),
        with_views(
            "requests",
            sql="""SELECT api_key_id, CAST(ts AS DATE) AS day, count(*) AS requests,
            greatest(count(*) - 3, 0) AS over_quota FROM requests GROUP BY 1, 2""",
        ),
    ),
    "rate_limit_pressure": Query(
        lambda t: slo.rate_limit_pressure(t.requests, limit=15, window_s=3600).select(
            "request_id", "in_window", "over_limit"
        ),
        with_views(
            "requests",
            sql="""SELECT request_id, count(*) OVER w AS in_window, count(*) OVER w > 15 AS over_limit
            FROM requests WINDOW w AS (ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW)""",
        ),
    ),
    "rate_limit_pressure_by_key": Query(
        lambda t: slo.rate_limit_pressure(t.requests, ["api_key_id"], limit=3, window_s=86400).select(
            "request_id", "in_window", "over_limit"
        ),
        with_views(
            "requests",
            sql="""SELECT request_id, count(*) OVER w AS in_window, count(*) OVER w > 3 AS over_limit
            FROM requests WINDOW w AS (PARTITION BY api_key_id ORDER BY ts
            RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)""",
        ),
    ),
    "memory_pct": Query(
        lambda t: t.base("customer").select(
            "c_custkey", memory_pct(F.col("c_acctbal"), F.col("c_acctbal") + 100.0).alias("memory_pct")
        ),
        """SELECT c_custkey, round(CASE WHEN c_acctbal + 100.0 > 0 THEN c_acctbal / (c_acctbal + 100.0) * 100
        ELSE 0 END, 6) AS memory_pct FROM customer""",
    ),
}
