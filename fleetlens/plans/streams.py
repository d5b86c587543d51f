"""Streaming queries: the test tables read as streams, run to the end, compared to SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.status import success_flag
from fleetlens.operators.admission import rate_limit_labels
from fleetlens.operators.slo import ALARM_RULES
from fleetlens.plans import fixtures
from fleetlens.plans.batch import STREAM_EPOCH, TRANSCRIPT_SQL, stream_chunks
from fleetlens.plans.fixtures import Tables, with_views
from fleetlens.plans.incidents import alert_sql, down_sql, outage_sql
from fleetlens.plans.registry import Query
from fleetlens.plans.requests import rto_sql
from fleetlens.streaming import queries as sq
from fleetlens.streaming.run import parquet_stream, run_available, run_to_end

DAY = 86400
NODE = "cluster_id, node"
AVAILABILITY, LATENCY = ALARM_RULES[0], ALARM_RULES[1]


def _events(t: Tables) -> DataFrame:
    return fixtures.events_view(parquet_stream(t.spark, f"{t.sf_dir}/events.parquet"))


def _fleet(t: Tables) -> DataFrame:
    return fixtures.by_cluster(_events(t))


def _requests(t: Tables) -> DataFrame:
    return fixtures.requests_view(_events(t))


def _samples(t: Tables) -> DataFrame:
    success = (success_flag(F.col("status")) == 1).alias("success")
    return fixtures.requests_view(_fleet(t)).select("cluster_id", "node", "ts", F.col("request_id").alias("seq"), "latency_ms", success)


def _sli(t: Tables) -> DataFrame:
    long = _requests(t).select(
        "cluster_id", "ts", F.lit("availability").alias("metric"), success_flag(F.col("status")).alias("value")
    )
    return run_to_end(long, lambda s: sq.stream_sli(s, AVAILABILITY), "sli").drop("cluster_id")


def _sli_latency(t: Tables) -> DataFrame:
    long = _requests(t).select(
        "cluster_id", "ts", F.lit("latency_ms").alias("metric"), F.col("latency_ms").alias("value")
    )
    return run_to_end(long, lambda s: sq.stream_sli(s, LATENCY), "sli-latency").drop("cluster_id")


def _in_time(rows: DataFrame) -> DataFrame:
    """The table is in order of time, so no row may be late; SILENT closes what the data leaves open."""
    return rows.drop("late")


def _outages(t: Tables) -> DataFrame:
    events = run_to_end(fixtures.probes_view(_fleet(t)), sq.stream_outages, "outages")
    return _in_time(events.where("event is null or event <> 'SILENT'")).drop("seq")


def _sla(t: Tables) -> DataFrame:
    states = run_to_end(_samples(t), lambda s: sq.stream_sla_state(s, 300.0), "sla")
    newest = F.max_by(F.struct("samples", "latency_p95_ms", "sla_ok"), "seq")
    return _in_time(states).groupBy("cluster_id", "node").agg(newest.alias("s")).select("cluster_id", "node", "s.*")


def _jobs(t: Tables) -> DataFrame:
    changes = _in_time(run_to_end(fixtures.job_events_view(_events(t)), sq.stream_job_state, "jobs"))
    newest = F.max_by("status", F.struct("ts", "seq"))
    return changes.groupBy("job_id").agg(newest.alias("status"), F.max("ts").alias("updated_at"))


def _transcripts(t: Tables) -> DataFrame:
    messages = parquet_stream(t.spark, f"{t.sf_dir}/conversations.parquet")
    chunks = stream_chunks(messages).withColumn(
        "started_at", F.timestamp_millis(F.lit(STREAM_EPOCH * 1000 - 250) + F.col("conv_id") * 1000)
    )
    return run_available(sq.stream_transcripts(chunks), "transcripts")


def _sli_sql(metric: str, value: str, alarm: str, breach: str) -> str:
    return with_views(
        "requests",
        sql=f"""SELECT '{metric}' AS metric, '{alarm}' AS alarm, window_start, round(avg(v), 6) AS mean, avg(v) {breach} AS breach
        FROM (SELECT time_bucket(INTERVAL 300 SECONDS, ts) AS window_start, {value} AS v FROM requests)
        GROUP BY window_start""",
    )


_ADMISSION_SQL = with_views(
    "requests",
    sql=f"""WITH RECURSIVE q AS (SELECT api_key_id, request_id, epoch_us(ts) AS us,
        row_number() OVER (PARTITION BY api_key_id ORDER BY ts, request_id) AS rn FROM requests),
      steps AS (SELECT api_key_id, request_id, rn, true AS accepted, [us] AS kept FROM q WHERE rn = 1
        UNION ALL SELECT q.api_key_id, q.request_id, q.rn,
          len(list_filter(s.kept, lambda x: x >= q.us - {DAY * 1000000})) < 3,
          CASE WHEN len(list_filter(s.kept, lambda x: x >= q.us - {DAY * 1000000})) < 3
            THEN list_append(list_filter(s.kept, lambda x: x >= q.us - {DAY * 1000000}), q.us)
            ELSE list_filter(s.kept, lambda x: x >= q.us - {DAY * 1000000}) END
        FROM steps s JOIN q ON q.api_key_id = s.api_key_id AND q.rn = s.rn + 1)
      SELECT api_key_id, request_id, accepted FROM steps""",
)

QUERIES = {
    "stream_sli": Query(
        _sli,
        _sli_sql("availability", "CASE WHEN status IN (200,201,302) THEN 1.0 ELSE 0.0 END", AVAILABILITY.alarm, "< 0.999"),
    ),
    "stream_sli_latency": Query(_sli_latency, _sli_sql("latency_ms", "latency_ms", LATENCY.alarm, "> 4500")),
    "stream_traffic": Query(
        lambda t: run_to_end(_requests(t), sq.stream_traffic, "traffic"),
        with_views(
            "requests",
            sql="""SELECT date_trunc('minute', ts) AS window_start, count(*) AS requests,
            count(*) FILTER (status >= 400 AND status < 500) AS errors_4xx,
            count(*) FILTER (status >= 500 AND status < 600) AS errors_5xx FROM requests GROUP BY 1""",
        ),
    ),
    "stream_outages": Query(
        _outages,
        with_views(
            "fleet_probes",
            sql=f"""SELECT {NODE}, 'FAILOVER' AS event, outage_ts AS ts, CAST(NULL AS DOUBLE) AS downtime_s FROM ({outage_sql(3, 'fleet_probes', NODE)})
            UNION ALL SELECT {NODE}, 'RESPAWN', recovered_ts, round((epoch_us(recovered_ts) - epoch_us(outage_ts)) / 1e6, 6) FROM ({down_sql('fleet_probes', NODE)})""",
        ),
    ),
    "stream_sla_state": Query(
        _sla,
        with_views(
            "fleet_requests",
            sql=f"""SELECT {NODE}, CAST(count(*) AS INTEGER) AS samples, round(quantile_cont(latency_ms, 0.95), 6) AS latency_p95_ms,
            quantile_cont(latency_ms, 0.95) <= 300 AS sla_ok FROM (SELECT *, row_number() OVER
            (PARTITION BY {NODE} ORDER BY ts DESC, request_id DESC) AS back FROM fleet_requests WHERE status IN (200,201,302)) WHERE back <= 1024 GROUP BY ALL""",
        ),
    ),
    "stream_alert_hold": Query(
        lambda t: _in_time(run_to_end(fixtures.status_view(fixtures.probes_view(_fleet(t))), sq.stream_alert_hold, "alerts")),
        with_views("fleet_status_samples", sql=alert_sql("fleet_status_samples", NODE)),
    ),
    "stream_rate_limit": Query(
        lambda t: _in_time(run_to_end(_requests(t), lambda s: sq.stream_rate_limit(s, 3, DAY), "admission")).drop("ts"), _ADMISSION_SQL
    ),
    "rate_limit_labels": Query(
        lambda t: rate_limit_labels(t.requests, limit=3, window_s=DAY).select("api_key_id", "request_id", "accepted"),
        _ADMISSION_SQL,
    ),
    "stream_rto": Query(
        lambda t: _in_time(run_to_end(fixtures.ops_view(_fleet(t)), sq.stream_rto, "rto").where("late or node is not null")),
        with_views(
            "fleet_ops_events",
            sql=f"SELECT cluster_id, ts, node, failed_node, round(elapsed_seconds, 6) AS elapsed_seconds FROM ({rto_sql('fleet_ops_events', 'cluster_id')})",
        ),
    ),
    "stream_job_state": Query(
        _jobs,
        with_views(
            "job_events",
            sql="SELECT job_id, arg_max(ray_status, seq) AS status, max(ts) AS updated_at FROM job_events GROUP BY 1",
        ),
    ),
    "stream_transcripts": Query(_transcripts, TRANSCRIPT_SQL),
}
