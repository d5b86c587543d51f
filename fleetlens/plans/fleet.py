"""Fleet-state queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import scalars, status
from fleetlens.operators import fleet
from fleetlens.plans.fixtures import Tables, with_views
from fleetlens.plans.registry import Query

SCOPE = ("cluster_id",)

_WARMING = "('STARTING','UPDATING','DEPLOYING','RESTARTING','PENDING','RECOVERING')"
_FAILED = "('FAILED','STOPPING','STOPPED','UNHEALTHY')"
_GPU = """(resource_key IN ('GPU','AMD_GPU','NVIDIA_GPU','STANDBY_GPU') OR starts_with(resource_key, 'accelerator_type:'))"""
_ALIVE = f"state = 'ALIVE' AND NOT is_head_node AND {_GPU}"

_PREFERRED = """preferred AS (SELECT cluster_id, node_ip, CAST(replica_id AS VARCHAR) AS replica_id, state FROM (
    SELECT *, row_number() OVER (PARTITION BY cluster_id, node_ip ORDER BY CASE WHEN state = 'RUNNING' THEN 0
      WHEN state IN {w} THEN 1 WHEN state IN {f} THEN 2 ELSE 3 END, ordinal) AS rn FROM replicas) WHERE rn = 1),
  flags AS (SELECT cluster_id, node_ip, bool_or(state = 'RUNNING') AS r, bool_or(state IN {w}) AS w, bool_or(state IN {f}) AS f, string_agg(state, ',' ORDER BY ordinal) AS listed FROM replicas GROUP BY 1, 2)""".format(w=_WARMING, f=_FAILED)


def _lifecycle(joined: str, usable: str) -> str:
    return f"""CASE WHEN coalesce(r, false) THEN 'LIVE' WHEN coalesce(w, false) THEN 'WARMING'
      WHEN coalesce(f, false) THEN 'FAILED'
      WHEN NOT {usable} THEN CASE WHEN {joined} THEN 'FAILED' ELSE 'OFFLINE' END
      WHEN {joined} THEN 'IDLE' ELSE 'OFFLINE' END"""


_ROLE = """CASE WHEN {s} IS NULL THEN 'unmanaged' WHEN {s} = 'primary' THEN 'active'
  WHEN {s} = 'reserve' THEN 'standby' ELSE 'unavailable' END"""

_ROUTER_BY_IP = """by_ip AS (SELECT * FROM (
    SELECT i.node_ip, s.* EXCLUDE (node_ip),
      row_number() OVER (PARTITION BY i.cluster_id, i.node_ip ORDER BY g.priority DESC, i.name DESC) AS rn
    FROM identifiers i JOIN router_snapshot s ON s.name = i.name AND s.cluster_id = i.cluster_id
    JOIN node_registry g ON g.name = i.name AND g.cluster_id = i.cluster_id) WHERE rn = 1)"""

_VIEW_COLUMNS = ("cluster_id", "name", "node_ip", "node_id", "status", "role", "raw_status", "serve_replica_id",
                 "serve_replica_state", "replica_states", "joined", "last_check_iso", "last_error", "jobs_total", "jobs_failed",
                 "respawns", "inflight", "last_latency_ms", "latency_p50_ms", "latency_p95_ms", "latency_p99_ms", "sla_ok", "readiness_ok")

_VIEW_SQL = f"""view_rows AS (SELECT
    CASE WHEN regexp_full_match(n.node_name, '[0-9]+([.][0-9]+){{3}}') THEN coalesce(a.alias, n.node_name) ELSE n.node_name END AS name,
    n.cluster_id, n.node_ip, n.node_id, {_lifecycle('true', 'coalesce(b.readiness_ok, true)')} AS status, {_ROLE.format(s='b.status')} AS role,
    coalesce(b.status, 'unmanaged') AS raw_status, p.replica_id AS serve_replica_id, p.state AS serve_replica_state,
    true AS joined, coalesce(b.respawns, 0) AS respawns, coalesce(b.inflight, 0) AS inflight, round(coalesce(b.latency_p50_ms, 0), 6)::DOUBLE AS latency_p50_ms,
    round(coalesce(b.latency_p95_ms, 0), 6)::DOUBLE AS latency_p95_ms, round(coalesce(b.latency_p99_ms, 0), 6)::DOUBLE AS latency_p99_ms,
    coalesce(b.sla_ok, true) AS sla_ok, coalesce(fl.listed, '') AS replica_states,
    strftime(make_timestamp(CAST(b.last_check * 1000000 AS BIGINT)), '%Y-%m-%dT%H:%M:%S.%fZ') AS last_check_iso, b.last_error, coalesce(b.jobs_total, 0) AS jobs_total, coalesce(b.jobs_failed, 0) AS jobs_failed,
    CAST(coalesce(b.last_latency_ms, 0) AS DOUBLE) AS last_latency_ms, coalesce(b.readiness_ok, true) AS readiness_ok
    FROM (SELECT * FROM nodes WHERE {_ALIVE}) n LEFT JOIN flags fl ON fl.node_ip = n.node_ip AND fl.cluster_id = n.cluster_id
    LEFT JOIN preferred p ON p.node_ip = n.node_ip AND p.cluster_id = n.cluster_id LEFT JOIN by_ip b ON b.node_ip = n.node_ip AND b.cluster_id = n.cluster_id
    LEFT JOIN aliases a ON a.node_ip = n.node_ip AND a.cluster_id = n.cluster_id)"""

_ALIASES_SQL = """aliases AS (SELECT cluster_id, expected_ip AS node_ip, max(alias) AS alias FROM node_registry
    WHERE alias IS NOT NULL AND expected_ip <> '' GROUP BY 1, 2)"""

_OFFLINE_SQL = f"""offline AS (SELECT b.cluster_id, b.name, b.node_ip, CAST(NULL AS VARCHAR) AS node_id,
    {_lifecycle('false', 'coalesce(b.readiness_ok, false)')} AS status, {_ROLE.format(s='b.status')} AS role, b.status AS raw_status,
    p.replica_id AS serve_replica_id, p.state AS serve_replica_state, false AS joined, coalesce(b.respawns, 0) AS respawns, coalesce(b.inflight, 0) AS inflight, round(coalesce(b.latency_p50_ms, 0), 6)::DOUBLE AS latency_p50_ms,
    round(coalesce(b.latency_p95_ms, 0), 6)::DOUBLE AS latency_p95_ms, round(coalesce(b.latency_p99_ms, 0), 6)::DOUBLE AS latency_p99_ms,
    coalesce(b.sla_ok, true) AS sla_ok, coalesce(fl.listed, '') AS replica_states,
    strftime(make_timestamp(CAST(b.last_check * 1000000 AS BIGINT)), '%Y-%m-%dT%H:%M:%S.%fZ') AS last_check_iso,
    coalesce(nullif(b.last_error, ''), '{fleet.MISSING_NODE_ERROR}') AS last_error, b.jobs_total, b.jobs_failed,
    CAST(b.last_latency_ms AS DOUBLE) AS last_latency_ms, b.readiness_ok FROM by_ip b LEFT JOIN flags fl ON fl.node_ip = b.node_ip AND fl.cluster_id = b.cluster_id
    LEFT JOIN preferred p ON p.node_ip = b.node_ip AND p.cluster_id = b.cluster_id
    WHERE (b.cluster_id, b.node_ip) NOT IN (SELECT (cluster_id, node_ip) FROM nodes WHERE {_ALIVE}))"""


def _view(rows: DataFrame) -> DataFrame:
    return rows.withColumn("replica_states", F.array_join("replica_states", ",")).select(*_VIEW_COLUMNS)


def _aliases(t: Tables) -> DataFrame:
    named = t.node_registry.where(F.col("alias").isNotNull() & (F.col("expected_ip") != ""))
    return named.groupBy("cluster_id", F.col("expected_ip").alias("node_ip")).agg(F.max("alias").alias("alias"))


def _router(t: Tables) -> DataFrame:
    return fleet.router_by_ip(t.router_snapshot, t.node_registry, SCOPE)


def _expected(t: Tables) -> DataFrame:
    return t.node_registry.select("cluster_id", "name", "expected_ip")


def _labels(t: Tables) -> DataFrame:
    return t.base("nation").select(
        F.concat(F.lit("node-"), F.col("n_nationkey") * 2).alias("name"), F.col("n_name").alias("label")
    )


def _statuses(t: Tables) -> DataFrame:
    """Replicas of a node taken as the parts of its two apps."""
    key = F.col("replica_id")
    return t.replicas.select(
        "cluster_id",
        "node_ip",
        F.when(key % 2 == 0, "gateway").otherwise("model").alias("app"),
        F.when(key % 11 == 0, "UNHEALTHY").when(key % 5 == 0, "UPDATING").otherwise("RUNNING").alias("status"),
    )


def _heads(t: Tables) -> DataFrame:
    """One configuration row per cluster: the head address, none, or a wrong one."""
    key = F.col("cluster_id")
    return t.scopes.select(
        key,
        F.when(key % 3 == 0, "10.0.0.0").when(key % 3 == 1, "").otherwise("10.0.3.3").alias("expected_head_ip"),
    )


def _resource_expectations(t: Tables) -> DataFrame:
    """Wanted nodes per cluster: by address for even clusters, else by resource."""
    key = F.col("cluster_id")
    return t.scopes.select(
        key,
        F.lit("rented").alias("name"),
        F.when(key % 2 == 0, "10.0.3.3").otherwise("").alias("expected_ip"),
        F.when(key % 3 == 0, "GPU").when(key % 3 == 1, "TPU").otherwise("AMD_GPU").alias("resource_key"),
    )


def _required(t: Tables) -> DataFrame:
    roles = t.node_registry.select(
        "cluster_id",
        F.when(F.col("expected_ip") == "", "standby").otherwise("worker").alias("role"),
        F.col("expected_ip").alias("ip"),
    )
    return fleet.required_node_keys(roles)


def _usage(t: Tables) -> DataFrame:
    return t.up_nodes.where(F.col("state") == "ALIVE").select(
        "cluster_id", F.concat(F.lit("node:"), "node_ip").alias("key")
    )


def _deltas(t: Tables) -> DataFrame:
    return fleet.snapshot_delta(t.snapshot_counts(True), t.snapshot_counts(False))


def _lists_text(df: DataFrame) -> DataFrame:
    return df.select(
        "cluster_id",
        F.array_join("active", ",").alias("active"),
        F.array_join("standby", ",").alias("standby"),
    )


_DELTA_SQL = """deltas AS (SELECT b.cluster_id, b.replica_id, a.posts - b.posts AS delta, a.posts IS NULL AS missing
    FROM snap_before b LEFT JOIN snap_after a ON a.replica_id = b.replica_id)"""

_NODE_COUNTERS_SQL = """per_node AS (SELECT node, count(*) FILTER (kind = 'route') AS jobs_total,
      count(*) FILTER (kind = 'failure') AS jobs_failed,
      round(coalesce(arg_max(latency_ms, seq) FILTER (kind = 'success'), 0), 6) AS last_latency_ms FROM dispatch_events GROUP BY 1),
    last_rows AS (SELECT * FROM (SELECT node, CASE WHEN kind = 'failure' THEN error END AS last_error,
      row_number() OVER (PARTITION BY node ORDER BY seq DESC) AS rn FROM dispatch_events) WHERE rn = 1),
    flying AS (SELECT node, count(*) AS inflight FROM (SELECT node, kind,
      row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) AS rn FROM dispatch_events) WHERE rn = 1 AND kind = 'route' GROUP BY 1)"""

_SEEN_SQL = """(SELECT cluster_id, node_ip, bool_or(state = 'ALIVE') AS alive, arg_min(state, ordinal) AS first
      FROM up_nodes GROUP BY 1, 2)"""

_CHECK_TEXT = """CASE WHEN e.expected_ip = '' THEN 'skipped (no expected identity configured)'
      WHEN s.alive IS NULL THEN 'not joined to Ray cluster' WHEN NOT s.alive THEN concat('joined but state=', s.first)
      ELSE 'ALIVE' END"""

QUERIES = {
    "nodes_view": Query(
        lambda t: _view(fleet.nodes_view(t.nodes, t.replicas, _router(t), _aliases(t), scope=SCOPE)),
        with_views("nodes", "replicas", "router_snapshot", "node_registry", "identifiers",
                   sql=f"WITH {_PREFERRED}, {_ROUTER_BY_IP}, {_ALIASES_SQL}, {_VIEW_SQL} SELECT * FROM view_rows"),
    ),
    "nodes_view_offline": Query(
        lambda t: _view(fleet.nodes_view_offline(t.nodes, t.replicas, _router(t), _aliases(t), scope=SCOPE)),
        with_views("nodes", "replicas", "router_snapshot", "node_registry", "identifiers",
                   sql=f"""WITH {_PREFERRED}, {_ROUTER_BY_IP}, {_ALIASES_SQL}, {_VIEW_SQL}, {_OFFLINE_SQL}
                   SELECT * FROM view_rows UNION ALL BY NAME SELECT * FROM offline"""),
    ),
    "router_by_ip": Query(
        lambda t: _router(t).select("cluster_id", "node_ip", "name", "status", "jobs_total"),
        with_views("router_snapshot", "node_registry", "identifiers",
                   sql=f"WITH {_ROUTER_BY_IP} SELECT cluster_id, node_ip, name, status, jobs_total FROM by_ip"),
    ),
    "lifecycle_by_name": Query(
        lambda t: fleet.lifecycle_by_name(t.node_registry, t.up_nodes, t.up_replicas, t.router_snapshot, scope=SCOPE, scopes=t.scopes),
        with_views("up_nodes", "up_replicas", "router_snapshot", "node_registry", "identifiers",
                   sql=f"""WITH {_PREFERRED.replace('FROM replicas', 'FROM up_replicas')}, per AS (SELECT g.cluster_id, g.name, coalesce(bool_or(n.node_ip IS NOT NULL), false) AS joined,
                     bool_or(fl.r) AS r, bool_or(fl.w) AS w, bool_or(fl.f) AS f FROM node_registry g
                     LEFT JOIN identifiers i ON i.name = g.name AND i.cluster_id = g.cluster_id
                     LEFT JOIN (SELECT cluster_id, node_ip FROM up_nodes WHERE {_ALIVE}) n ON n.node_ip = i.node_ip AND n.cluster_id = i.cluster_id
                     LEFT JOIN flags fl ON fl.node_ip = i.node_ip AND fl.cluster_id = i.cluster_id GROUP BY 1, 2)
                   SELECT per.cluster_id, per.name, joined, coalesce(s.readiness_ok, false) AS readiness_ok,
                     {_lifecycle('joined', 'coalesce(s.readiness_ok, false)')} AS lifecycle
                   FROM per LEFT JOIN router_snapshot s ON s.name = per.name AND s.cluster_id = per.cluster_id"""),
    ),
    "expected_node_checks": Query(
        lambda t: fleet.expected_node_checks(_expected(t), t.nodes, SCOPE, t.scopes),
        with_views("nodes", "node_registry",
                   sql=f"""SELECT e.cluster_id, e.name, e.expected_ip AS expected, e.expected_ip = '' OR coalesce(s.alive, false) AS passed,
                   {_CHECK_TEXT} AS detail FROM node_registry e LEFT JOIN {_SEEN_SQL.replace('up_nodes', 'nodes')} s
                   ON s.node_ip = e.expected_ip AND s.cluster_id = e.cluster_id"""),
    ),
    "head_check": Query(
        lambda t: fleet.head_check(_heads(t), t.up_nodes, SCOPE, t.scopes),
        with_views("up_nodes", sql="""WITH n AS (SELECT s.cluster_id, node_ip, state, ordinal, coalesce(is_head_node, false) AS head,
              CASE s.cluster_id % 3 WHEN 0 THEN '10.0.0.0' WHEN 1 THEN '' ELSE '10.0.3.3' END AS expected
              FROM (SELECT DISTINCT cluster_id FROM members) s LEFT JOIN up_nodes ON up_nodes.cluster_id = s.cluster_id),
            a AS (SELECT cluster_id, expected, count(*) FILTER (head) AS heads,
              bool_or(head AND node_ip = expected) AS hit, bool_or(head AND state = 'ALIVE') AS alive,
              arg_min(node_ip, ordinal) FILTER (head) AS first FROM n GROUP BY 1, 2)
            SELECT cluster_id, 'head' AS name, expected, coalesce(heads > 0 AND (expected = '' OR hit) AND alive, false) AS passed,
              CASE WHEN heads = 0 THEN 'no head node reported'
                   WHEN expected <> '' AND NOT hit THEN concat('head ip mismatch (saw ', first, ')')
                   WHEN alive THEN 'ALIVE' ELSE 'head not ALIVE' END AS detail FROM a"""),
    ),
    "resource_key_check": Query(
        lambda t: fleet.resource_key_check(_resource_expectations(t), t.up_nodes, SCOPE, t.scopes),
        with_views("up_nodes", sql=f"""WITH e AS (SELECT DISTINCT cluster_id, 'rented' AS name,
              CASE WHEN cluster_id % 2 = 0 THEN '10.0.3.3' ELSE '' END AS expected_ip,
              CASE cluster_id % 3 WHEN 0 THEN 'GPU' WHEN 1 THEN 'TPU' ELSE 'AMD_GPU' END AS resource_key FROM members)
            SELECT e.cluster_id, e.name, e.expected_ip AS expected, coalesce(s.alive, false) AS passed, {_CHECK_TEXT} AS detail
            FROM e LEFT JOIN {_SEEN_SQL} s ON s.node_ip = e.expected_ip AND s.cluster_id = e.cluster_id WHERE e.expected_ip <> ''
            UNION ALL SELECT e.cluster_id, e.name, e.resource_key, coalesce(s.alive, false),
              CASE WHEN s.alive IS NULL THEN 'no node advertises expected resource key' WHEN s.alive THEN 'ALIVE'
                   ELSE 'matched node not ALIVE' END
            FROM e LEFT JOIN (SELECT cluster_id, resource_key, bool_or(state = 'ALIVE') AS alive FROM up_nodes GROUP BY 1, 2) s
              ON s.resource_key = e.resource_key AND s.cluster_id = e.cluster_id WHERE e.expected_ip = ''"""),
    ),
    "missing_nodes": Query(
        lambda t: fleet.missing_nodes(_required(t), _usage(t), SCOPE, t.scopes),
        with_views("up_nodes", "node_registry", sql="""SELECT DISTINCT cluster_id, key FROM (
            SELECT cluster_id, concat('node:', expected_ip) AS key FROM node_registry WHERE expected_ip <> ''
            UNION ALL SELECT cluster_id, 'node:InternalHead' FROM node_registry)
            WHERE (cluster_id, key) NOT IN (SELECT (cluster_id, concat('node:', node_ip)) FROM up_nodes WHERE state = 'ALIVE')"""),
    ),
    "expected_covered": Query(
        lambda t: fleet.expected_covered(
            t.node_registry.select("cluster_id", F.col("expected_ip").alias("node_ip")), t.replicas, SCOPE, t.scopes
        ),
        with_views("replicas", "node_registry", sql="""SELECT g.cluster_id, count(*) FILTER (r.node_ip IS NULL) AS missing,
            bool_and(r.node_ip IS NOT NULL) AS covered FROM node_registry g
            LEFT JOIN (SELECT DISTINCT cluster_id, node_ip FROM replicas WHERE state = 'RUNNING') r
            ON r.node_ip = g.expected_ip AND r.cluster_id = g.cluster_id GROUP BY 1"""),
    ),
    "replica_spread": Query(
        lambda t: fleet.replica_spread(t.up_replicas, SCOPE, t.scopes),
        with_views("members", "up_replicas", sql="""SELECT s.cluster_id, count(*) FILTER (state = 'RUNNING') AS running,
            count(DISTINCT node_ip) FILTER (state = 'RUNNING') AS distinct_nodes,
            count(*) FILTER (state = 'RUNNING') >= 2 AND count(DISTINCT node_ip) FILTER (state = 'RUNNING') >= 2 AS spread
            FROM (SELECT DISTINCT cluster_id FROM members) s LEFT JOIN up_replicas r ON r.cluster_id = s.cluster_id GROUP BY 1"""),
    ),
    "health_rollup": Query(
        lambda t: fleet.health_rollup(_statuses(t), ["gateway", "model"], ["cluster_id", "node_ip"]),
        with_views("replicas", sql="""WITH s AS (SELECT cluster_id, node_ip, CASE WHEN replica_id % 2 = 0 THEN 'gateway' ELSE 'model' END AS app,
            CASE WHEN replica_id % 11 = 0 THEN 'UNHEALTHY' WHEN replica_id % 5 = 0 THEN 'UPDATING' ELSE 'RUNNING' END AS status FROM replicas)
            SELECT cluster_id, node_ip, CASE WHEN bool_or(status = 'UNHEALTHY') THEN 'UNHEALTHY'
              WHEN bool_or(status IN ('DEPLOYING','UPDATING','RESTARTING')) THEN 'UPDATING'
              WHEN bool_and(status IN ('RUNNING','HEALTHY')) AND count(DISTINCT app) = 2 THEN 'HEALTHY'
              ELSE 'pending' END AS health FROM s GROUP BY 1, 2"""),
    ),
    "replica_states_by_ip": Query(
        lambda t: fleet.replica_states_by_ip(t.replicas, SCOPE),
        with_views("replicas", sql="""SELECT cluster_id, node_ip, CAST(replica_id AS VARCHAR) AS replica_id, state AS listed_state,
            row_number() OVER (PARTITION BY cluster_id, node_ip ORDER BY ordinal) AS position FROM replicas"""),
    ),
    "resolve_lifecycle": Query(
        lambda t: fleet.node_lifecycle(t.nodes, t.replicas, F.col("ordinal") % 2 == 0, SCOPE),
        with_views("nodes", "replicas", sql=f"""WITH {_PREFERRED} SELECT n.cluster_id, n.node_ip, n.node_id,
            {_lifecycle("(n.state = 'ALIVE')", "(n.ordinal % 2 = 0)")} AS lifecycle
            FROM nodes n LEFT JOIN flags fl ON fl.node_ip = n.node_ip AND fl.cluster_id = n.cluster_id"""),
    ),
    "preferred_replica": Query(
        lambda t: fleet.preferred_replica(t.replicas, SCOPE),
        with_views("replicas", sql=f"WITH {_PREFERRED} SELECT * FROM preferred"),
    ),
    "running_replicas": Query(
        lambda t: fleet.running_replicas(t.replicas).select("replica_id", "node_id", "node_ip", "log_file_path"),
        with_views("replicas", sql="SELECT replica_id, node_id, node_ip, log_file_path FROM replicas WHERE state = 'RUNNING'"),
    ),
    "alive_gpu_workers": Query(
        lambda t: fleet.alive_gpu_workers(t.nodes).select("node_id", "node_ip"),
        with_views("nodes", sql=f"SELECT node_id, node_ip FROM nodes WHERE {_ALIVE}"),
    ),
    "node_display_name": Query(
        lambda t: t.nodes.join(_aliases(t), ["cluster_id", "node_ip"], "left").select(
            "node_id", scalars.node_display_name(F.col("node_name"), F.col("node_ip"), F.col("alias")).alias("name")
        ),
        with_views("nodes", "node_registry", sql=f"""WITH {_ALIASES_SQL} SELECT n.node_id,
            CASE WHEN regexp_full_match(node_name, '[0-9]+([.][0-9]+){{3}}') THEN coalesce(a.alias, node_name) ELSE node_name END AS name
            FROM nodes n LEFT JOIN aliases a ON a.node_ip = n.node_ip AND a.cluster_id = n.cluster_id"""),
    ),
    "node_label": Query(
        lambda t: fleet.node_label(t.router_snapshot.select("cluster_id", "name"), _labels(t), "name", "label"),
        with_views("router_snapshot", sql="""SELECT s.cluster_id, s.name, coalesce(r.n_name, s.name) AS label FROM router_snapshot s
            LEFT JOIN nation r ON s.name = concat('node-', n_nationkey * 2)"""),
    ),
    "router_role": Query(
        lambda t: t.nodes.select("cluster_id", "node_ip")
        .join(t.router_snapshot.select("cluster_id", "node_ip", "status"), ["cluster_id", "node_ip"], "left")
        .select("cluster_id", "node_ip", status.router_role(F.col("status")).alias("role"),
                status.router_lifecycle(F.coalesce("status", F.lit(""))).alias("lifecycle")),
        with_views("nodes", "router_snapshot", sql=f"""SELECT n.cluster_id, n.node_ip, {_ROLE.format(s='s.status')} AS role,
            CASE WHEN s.status IN ('primary','reserve') THEN 'LIVE' WHEN s.status IN ('respawning','starting') THEN 'WARMING'
            ELSE 'OFFLINE' END AS lifecycle FROM nodes n LEFT JOIN router_snapshot s
            ON s.node_ip = n.node_ip AND s.cluster_id = n.cluster_id"""),
    ),
    "active_standby_lists": Query(
        lambda t: _lists_text(fleet.active_standby_lists(t.router_snapshot, SCOPE)),
        with_views("router_snapshot", sql="""SELECT cluster_id,
            coalesce(string_agg(name, ',' ORDER BY name) FILTER (status = 'primary'), '') AS active,
            coalesce(string_agg(name, ',' ORDER BY name) FILTER (status = 'reserve'), '') AS standby
            FROM router_snapshot GROUP BY 1"""),
    ),
    "routable_check": Query(
        lambda t: fleet.routable_check(t.router_snapshot, 12, SCOPE),
        with_views("router_snapshot", sql="""SELECT cluster_id, count(*) FILTER (status IN ('primary','reserve')) AS routable,
            count(*) FILTER (status IN ('primary','reserve')) >= 12 AS passed,
            string_agg(concat(name, '=', status), ', ' ORDER BY name) AS detail FROM router_snapshot GROUP BY 1"""),
    ),
    "stuck_check": Query(
        lambda t: fleet.stuck_check(t.router_snapshot, SCOPE),
        with_views("router_snapshot", sql="""WITH a AS (SELECT cluster_id,
              string_agg(name, ''', ''' ORDER BY name) FILTER (status IN ('failed','respawning')) AS stuck,
              string_agg(name, ''', ''' ORDER BY name) FILTER (status IN ('primary','reserve') AND NOT readiness_ok) AS bad
              FROM router_snapshot GROUP BY 1)
            SELECT cluster_id, stuck IS NULL AND bad IS NULL AS passed,
              CASE WHEN stuck IS NOT NULL THEN concat('nodes stuck in recovery: [''', stuck, ''']')
              WHEN bad IS NOT NULL THEN concat('routable nodes failing readiness: [''', bad, ''']')
              ELSE 'all nodes recovered and ready' END AS detail FROM a"""),
    ),
    "elect_primaries": Query(
        lambda t: fleet.elect_primaries(t.router_snapshot, 2, SCOPE),
        with_views("router_snapshot", sql="""SELECT cluster_id, name, priority,
            CASE WHEN row_number() OVER (PARTITION BY cluster_id ORDER BY priority) <= 2 THEN 'primary' ELSE 'reserve' END AS elected
            FROM router_snapshot WHERE status IN ('primary','reserve')"""),
    ),
    "failover_promotion": Query(
        lambda t: fleet.failover_promotion(t.router_snapshot, SCOPE),
        with_views("router_snapshot", sql="""SELECT f.cluster_id, f.name AS failed_node, p.promoted FROM router_snapshot f
            LEFT JOIN (SELECT cluster_id, arg_min(name, priority) AS promoted FROM router_snapshot
              WHERE status = 'reserve' AND readiness_ok GROUP BY 1) p ON p.cluster_id = f.cluster_id
            WHERE f.status = 'failed'"""),
    ),
    "round_robin_assign": Query(
        lambda t: fleet.round_robin_assign(
            t.requests.withColumn("cluster_id", F.col("api_key_id") % 7), t.router_snapshot
        ).select("request_id", "cluster_id", "turn", "assigned"),
        with_views("requests", "router_snapshot", sql="""WITH tiers AS (SELECT *, min(tier) OVER (PARTITION BY cluster_id) AS best FROM (
              SELECT cluster_id, name, priority, CASE WHEN status = 'primary' THEN 0 ELSE 2 END + CASE WHEN sla_ok THEN 0 ELSE 1 END AS tier
              FROM router_snapshot WHERE status IN ('primary','reserve'))),
            e AS (SELECT cluster_id, name, row_number() OVER (PARTITION BY cluster_id ORDER BY priority) - 1 AS slot,
              count(*) OVER (PARTITION BY cluster_id) AS n FROM tiers WHERE tier = best),
            q AS (SELECT request_id, api_key_id % 7 AS cluster_id,
              row_number() OVER (PARTITION BY api_key_id % 7 ORDER BY ts, request_id) AS turn FROM requests)
            SELECT request_id, q.cluster_id, turn, name AS assigned FROM q LEFT JOIN e
            ON q.cluster_id = e.cluster_id AND (turn - 1) % n = slot"""),
    ),
    "snapshot_delta": Query(
        _deltas,
        with_views("snap_before", "snap_after", sql=f"WITH {_DELTA_SQL} SELECT * FROM deltas"),
    ),
    "traffic_shares": Query(
        lambda t: fleet.traffic_shares(_deltas(t)).drop("missing"),
        with_views("snap_before", "snap_after", sql=f"""WITH {_DELTA_SQL} SELECT cluster_id, replica_id, delta,
            round(delta * 100.0 / sum(delta) OVER (PARTITION BY cluster_id), 6) AS share_pct FROM deltas"""),
    ),
    "traffic_split": Query(
        lambda t: fleet.traffic_split(_deltas(t), target_pct=20.0, tolerance_pct=5.0),
        with_views("snap_before", "snap_after", sql=f"""WITH {_DELTA_SQL}, d AS (SELECT *,
              delta * 100.0 / sum(delta) OVER (PARTITION BY cluster_id) AS share FROM deltas)
            SELECT cluster_id, bool_or(missing OR delta <= 0) AS no_traffic, round(max(abs(share - 20)), 6) AS max_error_pct,
              NOT bool_or(missing OR delta <= 0) AND max(abs(share - 20)) <= 5 AS passed FROM d GROUP BY 1"""),
    ),
    "node_counters": Query(
        lambda t: fleet.node_counters(t.dispatch_events).drop("cluster_id"),
        with_views("dispatch_events", sql=f"""WITH {_NODE_COUNTERS_SQL} SELECT p.*, l.last_error, coalesce(f.inflight, 0) AS inflight
            FROM per_node p JOIN last_rows l ON l.node = p.node LEFT JOIN flying f ON f.node = p.node"""),
    ),
    "iso_time": Query(
        lambda t: t.router_snapshot.select("cluster_id", "name", scalars.iso_time(F.col("last_check")).alias("last_check_iso")),
        with_views("router_snapshot", sql="""SELECT cluster_id, name,
            strftime(make_timestamp(CAST(last_check * 1000000 AS BIGINT)), '%Y-%m-%dT%H:%M:%S.%fZ') AS last_check_iso FROM router_snapshot"""),
    ),
    "url_host": Query(
        lambda t: t.base("pages").select(
            "page_id",
            scalars.url_host(F.col("url")).alias("host"),
            F.array_join(scalars.node_identifiers(F.lit("127.0.0.1"), F.col("url")), ",").alias("identifiers"),
        ),
        """SELECT page_id, lower(regexp_extract(url, '://([^/:?#]+)', 1)) AS host,
        lower(regexp_extract(url, '://([^/:?#]+)', 1)) AS identifiers FROM pages""",
    ),
    "log_filename": Query(
        lambda t: t.replicas.select("replica_id", scalars.log_filename(
            F.when(F.col("replica_id") % 2 == 0, F.col("log_file_path")).otherwise(F.concat(F.lit("//"), "replica_id"))
        ).alias("filename")),
        with_views("replicas", sql="""SELECT replica_id, CASE WHEN replica_id % 2 = 0 THEN concat('serve/', replica_id, '.log')
            ELSE CAST(replica_id AS VARCHAR) END AS filename FROM replicas"""),
    ),
}
