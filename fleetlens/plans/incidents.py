"""Incident queries: outages, downtime, held alerts, recovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.operators import incidents as inc
from fleetlens.plans.fixtures import Tables, by_cluster, with_views
from fleetlens.plans.registry import Query

HOURS = 3600.0


def outage_sql(threshold: int, probes: str = "probes", keys: str = "node") -> str:
    return f"""SELECT {keys}, ts AS outage_ts, seq FROM (
        SELECT *, row_number() OVER (PARTITION BY {keys}, run, healthy ORDER BY ts, seq) AS nth FROM (
          SELECT *, sum(CASE WHEN healthy THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY ts, seq) AS run FROM {probes}))
      WHERE NOT healthy AND nth = {threshold}"""


def down_sql(probes: str = "probes", keys: str = "node") -> str:
    same = " AND ".join(f"p.{k} = o.{k}" for k in keys.split(", "))
    return f"""SELECT {', '.join(f"o.{k}" for k in keys.split(', '))}, o.outage_ts, min(p.ts) AS recovered_ts
    FROM ({outage_sql(3, probes, keys)}) o JOIN {probes} p ON {same} AND p.healthy AND p.ts > o.outage_ts
    GROUP BY ALL"""


DOWN_SQL = down_sql()


def alert_sql(samples: str = "status_samples", keys: str = "node") -> str:
    """Runs of zeros that no other sample ends before the hold."""
    same = " AND ".join(f"r.{k} = z.{k}" for k in keys.split(", "))
    return f"""WITH r AS (SELECT *, sum(CASE WHEN value <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY ts, seq) AS run FROM {samples}),
    z AS (SELECT {keys}, run, min(ts) AS zero_since FROM r WHERE value = 0 GROUP BY ALL),
    e AS (SELECT z.*, min(r.ts) AS ended FROM z LEFT JOIN r ON {same} AND r.run = z.run + 1 AND r.value <> 0 GROUP BY ALL)
    SELECT {keys}, zero_since, zero_since + INTERVAL 30 SECONDS AS firing_ts FROM e
    WHERE ended IS NULL OR zero_since + INTERVAL 30 SECONDS <= ended"""


def _recovery(t: Tables, *, rollup: bool = False):
    samples = t.events.select(
        "cluster_id",
        "node",
        "ts",
        F.when(F.col("event_type") == "error", "DEAD")
        .when(F.col("event_type") == "view", "MISSING")
        .otherwise("ALIVE")
        .alias("state"),
    )
    targets = samples.select("cluster_id", "node", F.date_trunc("day", "ts").alias("t0")).distinct()
    phases = inc.recovery_phases(
        samples, targets, outage_timeout_s=2 * HOURS, rejoin_timeout_s=1 * HOURS
    )
    if rollup:
        return inc.phase_rollup(phases, ["node", "t0"])
    return phases.drop("cluster_id")


_RECOVERY_SQL = """s AS (SELECT node, ts, CASE event_type WHEN 'error' THEN 'DEAD' WHEN 'view' THEN 'MISSING' ELSE 'ALIVE' END AS state FROM ev),
    targets AS (SELECT DISTINCT node, date_trunc('day', ts) AS t0 FROM s),
    o AS (SELECT t.node, t.t0, min(s.ts) AS outage_ts FROM targets t LEFT JOIN s ON s.node = t.node AND s.state <> 'ALIVE'
          AND s.ts >= t.t0 AND s.ts <= t.t0 + INTERVAL 2 HOURS GROUP BY 1, 2),
    r AS (SELECT o.node, o.t0, o.outage_ts, min(s.ts) AS rejoin_ts FROM o LEFT JOIN s ON s.node = o.node AND s.state = 'ALIVE'
          AND s.ts > coalesce(o.outage_ts, o.t0 + INTERVAL 2 HOURS)
          AND s.ts <= coalesce(o.outage_ts, o.t0 + INTERVAL 2 HOURS) + INTERVAL 1 HOUR GROUP BY 1, 2, 3),
    phases AS (SELECT node, t0, 'outage-detected' AS phase, outage_ts IS NOT NULL AS passed, outage_ts AS at FROM r
          UNION ALL SELECT node, t0, 'rejoin-confirmed', rejoin_ts IS NOT NULL, rejoin_ts FROM r)"""

PRIMARIES = 30


def _failovers(t: Tables):
    """Every second event is a probe of its node, the errors among the others are failed requests."""
    events = by_cluster(t.events)
    rows = events.select("cluster_id", "node", "ts", F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("healthy"))
    probes, requests = rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1 AND NOT healthy").drop("healthy")
    nodes = events.select("cluster_id", "node").distinct().withColumn("priority", F.col("node"))
    return inc.node_failovers(probes, requests, nodes, primary_count=PRIMARIES)


_FAILOVER_SQL = f"""WITH r AS (SELECT cluster_id, node, ts, event_id AS seq, CASE WHEN event_id % 2 = 0 THEN 'probe' ELSE 'request' END AS cause,
      event_id % 2 = 0 AND event_type <> 'error' AS ok FROM fleet WHERE event_id % 2 = 0 OR event_type = 'error'),
    u AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY cluster_id, node ORDER BY ts, seq) AS up FROM r),
    n AS (SELECT *, count(*) FILTER (cause = 'probe' AND NOT ok) OVER (PARTITION BY cluster_id, node, up ORDER BY ts, seq) AS bad FROM u),
    d AS (SELECT cluster_id, node, up, min({{'ts': ts, 'seq': seq, 'cause': cause}}) AS down FROM n
      WHERE NOT ok AND (cause = 'request' OR bad >= 3) GROUP BY ALL),
    f AS (SELECT d.cluster_id, d.node, down.ts AS ts, down.seq AS seq, down.cause AS cause, u.ts AS back_ts, u.seq AS back_seq
      FROM d LEFT JOIN u ON u.cluster_id = d.cluster_id AND u.node = d.node AND u.ok AND u.up = d.up + 1),
    nodes AS (SELECT DISTINCT cluster_id, node FROM fleet),
    ahead AS (SELECT a.cluster_id, a.node, count(b.node) AS n FROM nodes a LEFT JOIN nodes b ON b.cluster_id = a.cluster_id AND b.node < a.node GROUP BY ALL),
    hit AS (SELECT f.cluster_id, f.node, f.seq, count(o.seq) AS down FROM f LEFT JOIN f o ON o.cluster_id = f.cluster_id AND o.node < f.node
      AND (o.ts, o.seq) < (f.ts, f.seq) AND (o.back_ts IS NULL OR (o.back_ts, o.back_seq) > (f.ts, f.seq)) GROUP BY ALL)
    SELECT f.cluster_id, f.node, f.ts AS failover_ts, f.seq, f.cause, f.back_ts AS recovered_ts, ahead.n - hit.down < {PRIMARIES} AS routing_impact
    FROM f JOIN hit ON hit.cluster_id = f.cluster_id AND hit.node = f.node AND hit.seq = f.seq
    JOIN ahead ON ahead.cluster_id = f.cluster_id AND ahead.node = f.node"""

QUERIES = {
    "node_failovers": Query(_failovers, with_views("fleet", sql=_FAILOVER_SQL)),
    "probe_outages": Query(
        lambda t: inc.probe_outages(t.probes).drop("cluster_id"),
        with_views("probes", sql=outage_sql(3)),
    ),
    "probe_outages_watchdog": Query(
        lambda t: inc.probe_outages(t.probes, threshold=inc.WATCHDOG_THRESHOLD).drop("cluster_id"),
        with_views("probes", sql=outage_sql(2)),
    ),
    "downtime": Query(
        lambda t: inc.downtime(t.probes).drop("cluster_id"),
        with_views(
            "probes",
            sql=f"SELECT *, round((epoch_us(recovered_ts) - epoch_us(outage_ts)) / 1e6, 6) AS downtime_s FROM ({DOWN_SQL})",
        ),
    ),
    "respawn_counts": Query(
        lambda t: inc.respawn_counts(inc.downtime(t.probes)).drop("cluster_id"),
        with_views(
            "probes",
            sql=f"""SELECT node, count(*) AS respawns,
            round(sum((epoch_us(recovered_ts) - epoch_us(outage_ts)) / 1e6), 6) AS downtime_s FROM ({DOWN_SQL}) GROUP BY node""",
        ),
    ),
    "alert_hold": Query(
        lambda t: inc.alert_hold(t.status_samples).drop("cluster_id"),
        with_views("status_samples", sql=alert_sql()),
    ),
    "recovery_phases": Query(
        _recovery, with_views("ev", sql=f"WITH {_RECOVERY_SQL} SELECT * FROM phases")
    ),
    "phase_rollup": Query(
        lambda t: _recovery(t, rollup=True),
        with_views(
            "ev",
            sql=f"WITH {_RECOVERY_SQL} SELECT node, t0, bool_and(passed) AS passed FROM phases GROUP BY 1, 2",
        ),
    ),
}
