"""Rolling, rate and log queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.status import success_flag
from fleetlens.functions.text import log_payload_text
from fleetlens.operators import logs, rolling
from fleetlens.plans.fixtures import Tables, with_views
from fleetlens.plans.registry import Query

RANGE_S = 6 * 3600
TAIL = 2000


def _successes(t: Tables) -> DataFrame:
    """Latencies of the requests that succeeded, as samples of their node."""
    return t.requests.where(success_flag(F.col("status")) == 1).select("cluster_id", "node", "ts", F.col("request_id").alias("seq"), "latency_ms")


def _payloads(t: Tables) -> DataFrame:
    """Log replies of five shapes made from whole pages."""
    html, kind = F.col("html"), F.col("page_id") % 5

    def obj(*fields):
        return F.to_json(F.struct(*fields))

    raw = (
        F.when(kind == 0, F.concat(F.lit("  "), html, F.lit("\n")))
        .when(kind == 1, obj(F.struct(html.alias("logs")).alias("data")))
        .when(kind == 2, obj(html.alias("contents")))
        .when(kind == 3, F.concat(F.lit("{"), html))
        .otherwise(obj(F.struct(F.lit(5).alias("logs")).alias("data"), html.alias("content")))
    )
    return t.base("pages").select("page_id", log_payload_text(raw).alias("text"))


def _document_logs(t: Tables) -> DataFrame:
    return t.documents.select(
        F.lit(0).alias("cluster_id"), F.col("lang").alias("replica_id"), F.col("doc_id").alias("seq"), F.col("text").alias("raw")
    )


QUERIES = {
    "rolling_p95": Query(
        lambda t: rolling.rolling_quantiles(_successes(t)).drop("cluster_id", "ts"),
        with_views(
            "requests",
            sql="""SELECT node, request_id AS seq, round(quantile_cont(latency_ms, 0.5) OVER w, 6) AS p50,
            round(quantile_cont(latency_ms, 0.95) OVER w, 6) AS p95, round(quantile_cont(latency_ms, 0.99) OVER w, 6) AS p99
            FROM requests WHERE status IN (200,201,302) WINDOW w AS (PARTITION BY node ORDER BY ts, request_id ROWS BETWEEN 1023 PRECEDING AND CURRENT ROW)""",
        ),
    ),
    "counter_rate": Query(
        lambda t: rolling.counter_rate(t.counter_samples, range_s=RANGE_S).drop("cluster_id", "ts"),
        with_views(
            "counter_samples",
            sql=f"""WITH d AS (SELECT *, lag(value) OVER (PARTITION BY node ORDER BY ts, seq) AS prev FROM counter_samples),
            s AS (SELECT *, coalesce(CASE WHEN value < prev THEN value ELSE value - prev END, 0) AS step FROM d),
            r AS (SELECT node, seq, CASE WHEN count(*) OVER w > 1 THEN (sum(step) OVER w - first_value(step) OVER w) / {RANGE_S}.0 END AS rate
              FROM s WINDOW w AS (PARTITION BY node ORDER BY ts RANGE BETWEEN INTERVAL {RANGE_S} SECONDS PRECEDING AND CURRENT ROW))
            SELECT node, seq, round(rate, 6) AS per_second, round(rate * 60, 6) AS per_minute FROM r""",
        ),
    ),
    "log_payload_text": Query(
        _payloads,
        r"""SELECT page_id, CASE WHEN page_id % 5 = 3 THEN concat('{', html)
        WHEN page_id % 5 = 0 THEN regexp_replace(html, '^\s+|\s+$', '', 'g') ELSE html END AS text FROM pages""",
    ),
    "needle_count": Query(
        lambda t: logs.needle_count(t.log_text, "href").drop("cluster_id"),
        with_views(
            "log_text",
            sql="""SELECT replica_id, CAST(sum((length(raw) - length(replace(raw, 'href', ''))) // 4) AS BIGINT) AS hits
            FROM log_text GROUP BY 1""",
        ),
    ),
    "log_tail": Query(
        lambda t: logs.log_tail(_document_logs(t), lines=TAIL).select("replica_id", "seq", "from_end", "line"),
        rf"""WITH l AS (SELECT lang AS replica_id, doc_id AS seq, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS lines FROM documents),
        u AS (SELECT replica_id, seq, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM l)
        SELECT replica_id, seq, line, from_end FROM (SELECT *, row_number() OVER (PARTITION BY replica_id ORDER BY seq DESC, pos DESC) AS from_end FROM u)
        WHERE from_end <= {TAIL}""",
    ),
}
