"""Adapter views: the canonical telemetry tables, derived from the test tables.

``Tables`` builds them as DataFrames; ``VIEW_SQL`` states the same views for the SQL
oracles. Both read whole tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.operators.scan import by_number, int_chunk, row_index
from fleetlens.session import prepare


CLUSTER_SIZE = 25


def node_ip(ordinal: Column) -> Column:
    """Address of a node, unique within its cluster."""
    return F.concat(F.lit("10.0."), ordinal % 5, F.lit("."), ordinal)


class Tables:
    """Lazily built views over one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = prepare(spark)
        self.sf_dir = sf_dir.rstrip("/")

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return events_view(self.base("events"))

    @cached_property
    def requests(self) -> DataFrame:
        return requests_view(self.events)

    @cached_property
    def probes(self) -> DataFrame:
        return probes_view(self.events)

    @cached_property
    def dispatch_events(self) -> DataFrame:
        return self.events.select(
            "cluster_id",
            F.col("user_id").alias("job_id"),
            F.col("event_id").alias("seq"),
            "ts",
            "node",
            F.col("value").alias("latency_ms"),
            dispatch_kind(F.col("event_type")).alias("kind"),
            F.when(
                F.col("event_type") == "error", F.concat(F.lit("err-"), F.col("event_id"))
            ).alias("error"),
        )

    @cached_property
    def ops_events(self) -> DataFrame:
        return ops_view(self.events)

    @cached_property
    def counter_samples(self) -> DataFrame:
        numbered = row_index(
            self.events.select("cluster_id", "event_id", "ts", "node"),
            ["node"],
            [F.col("event_id")],
            by_number(F.col("event_id"), 4096),
            "rn",
        )
        return numbered.select(
            "cluster_id",
            "ts",
            F.col("event_id").alias("seq"),
            "node",
            (F.col("rn") % 100).cast("double").alias("value"),
        )

    @cached_property
    def status_samples(self) -> DataFrame:
        return status_view(self.probes)

    @cached_property
    def job_events(self) -> DataFrame:
        return job_events_view(self.events)

    @cached_property
    def batch_items(self) -> DataFrame:
        """Items in listing order per job; the order keys tie only on equal rows.

        A job is an order, which has few lines, so a window numbers them.
        """
        order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"]
        lines = self.base("lineitem").select(
            "l_orderkey", *order, "l_returnflag", "l_linestatus"
        )
        along = Window.partitionBy("l_orderkey").orderBy(*order)
        numbered = lines.withColumn("ordinal", F.row_number().over(along).cast("long"))
        return numbered.select(
            F.col("l_orderkey").alias("job_id"),
            "ordinal",
            *item_outcome(),
            F.col("l_quantity").cast("int").alias("prompt_tokens"),
            F.col("l_linenumber").alias("completion_tokens"),
        )

    @cached_property
    def item_flags(self) -> DataFrame:
        """Outcome columns of ``batch_items`` without the ordinal, so without its sort."""
        return self.base("lineitem").select(F.col("l_orderkey").alias("job_id"), *item_outcome())

    @cached_property
    def batch_jobs(self) -> DataFrame:
        return self.base("orders").select(
            F.col("o_orderkey").alias("job_id"),
            F.when(F.col("o_orderstatus") == "F", "completed")
            .when(F.col("o_orderstatus") == "O", "failed")
            .otherwise("cancelled")
            .alias("status"),
            F.col("o_orderdate").cast("timestamp").alias("created_at"),
        )

    @cached_property
    def chat_messages(self) -> DataFrame:
        return self.base("conversations")

    @cached_property
    def token_jobs(self) -> DataFrame:
        return self.base("lineitem").select(
            F.col("l_quantity").cast("int").alias("input_tokens"),
            ((F.col("l_partkey") % 200) + 100).cast("int").alias("output_tokens"),
        )

    @cached_property
    def nodes(self) -> DataFrame:
        """Clusters of up to 25 nodes; every customer is a node of one cluster."""
        ordinal, nation = F.col("ordinal"), F.col("c_nationkey")
        resource = (
            F.when(nation % 4 == 0, "CPU")
            .when(nation % 4 == 1, "GPU")
            .when(nation % 4 == 2, "AMD_GPU")
            .otherwise("accelerator_type:X")
        )
        return self._members("customer", "c_custkey").select(
            "cluster_id",
            F.concat(F.lit("ray-"), "c_custkey").alias("node_id"),
            "ordinal",
            node_ip(ordinal).alias("node_ip"),
            F.when(ordinal % 3 == 0, node_ip(ordinal)).otherwise(F.col("c_name")).alias("node_name"),
            F.when(nation % 7 == 3, "DEAD").otherwise("ALIVE").alias("state"),
            (ordinal == 0).alias("is_head_node"),
            F.create_map(resource, F.lit(1.0)).alias("resources"),
        )

    def _members(self, table: str, key: str) -> DataFrame:
        """Rows of a table with the cluster and the node ordinal their customer stands for."""
        return self.base(table).select(
            "*",
            int_chunk(F.col(key), CLUSTER_SIZE).alias("cluster_id"),
            (F.col(key) % CLUSTER_SIZE).alias("ordinal"),
        )

    @cached_property
    def replicas(self) -> DataFrame:
        """Replica listing: an order is a replica on the node of its customer, stopped unless it is open."""
        key = F.col("o_orderkey")
        state = (
            F.when(F.col("o_orderstatus") != "O", "STOPPED")
            .when(key % 6 == 1, "STARTING")
            .when(key % 6 == 2, "FAILED")
            .when(key % 6 == 3, "RECOVERING")
            .when(key % 6 == 4, "UNHEALTHY")
            .otherwise("RUNNING")
        )
        return self._members("orders", "o_custkey").select(
            "cluster_id",
            key.alias("replica_id"),
            F.concat(F.lit("ray-"), "o_custkey").alias("node_id"),
            node_ip(F.col("ordinal")).alias("node_ip"),
            state.alias("state"),
            F.concat(F.lit("/tmp/session/logs/serve/"), key, F.lit(".log")).alias("log_file_path"),
            key.alias("ordinal"),
        )

    @cached_property
    def up_nodes(self) -> DataFrame:
        """Nodes of the clusters that report anything; every sixth cluster is down."""
        return self.nodes.where(F.col("cluster_id") % 6 != 5)

    @cached_property
    def up_replicas(self) -> DataFrame:
        return self.replicas.where(F.col("cluster_id") % 6 != 5)

    @cached_property
    def scopes(self) -> DataFrame:
        """All configured clusters, those that are down too."""
        return self.base("customer").select(int_chunk(F.col("c_custkey"), CLUSTER_SIZE).alias("cluster_id")).distinct()

    @cached_property
    def router_snapshot(self) -> DataFrame:
        """Router rows of all nodes; those of one market segment have an address that no node reports."""
        key, nation, ordinal = F.col("c_custkey"), F.col("c_nationkey"), F.col("ordinal")
        status = (
            F.when(nation % 5 == 0, "failed")
            .when(nation % 5 == 1, "primary")
            .when(nation % 5 == 2, "respawning")
            .otherwise("reserve")
        )
        away = F.concat(F.lit("10.8.0."), ordinal)
        managed = self._members("customer", "c_custkey")
        return managed.select(
            "cluster_id",
            F.concat(F.lit("node-"), ordinal).alias("name"),
            F.when(F.col("c_mktsegment") == "MACHINERY", away).otherwise(node_ip(ordinal)).alias("node_ip"),
            status.alias("status"),
            (key % 97).alias("jobs_total"),
            (key % 7).alias("jobs_failed"),
            (key % 13).alias("respawns"),
            (key % 3).alias("inflight"),
            (nation % 3 != 0).alias("readiness_ok"),
            (key % 11 != 0).alias("sla_ok"),
            ordinal.alias("priority"),
            F.when(nation % 5 == 0, F.concat(F.lit("down "), key)).alias("last_error"),
            F.col("c_acctbal").alias("last_latency_ms"),
            (F.lit(1_700_000_000.25) + key).alias("last_check"),
            F.abs("c_acctbal").alias("latency_p50_ms"),
            (F.abs("c_acctbal") * 2).alias("latency_p95_ms"),
            (F.abs("c_acctbal") * 3).alias("latency_p99_ms"),
        )

    @cached_property
    def node_registry(self) -> DataFrame:
        """Configured nodes; some share an outside address, some have none, and those of three segments report nowhere."""
        ordinal = F.col("ordinal")
        here = F.col("c_mktsegment").isin("BUILDING", "FURNITURE")
        ip = F.when(here, node_ip(ordinal)).otherwise(F.concat(F.lit("10.7.0."), ordinal))
        host = F.when(ordinal % 11 == 0, "localhost").otherwise(ip)
        listed = self._members("customer", "c_custkey")
        return listed.select(
            "cluster_id",
            F.concat(F.lit("node-"), ordinal).alias("name"),
            F.when(ordinal % 3 == 2, "10.9.9.9").when(ordinal % 5 == 0, "").otherwise(ip).alias("expected_ip"),
            F.concat(F.lit("http://"), host, F.lit(":8000/infer/v1/chat/completions")).alias("infer_url"),
            ordinal.alias("priority"),
            F.concat(F.lit("alias-"), F.col("c_custkey")).alias("alias"),
        )

    def snapshot_counts(self, before: bool) -> DataFrame:
        lines = self.base("lineitem")
        if before:
            lines = lines.where(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz"))
        return lines.groupBy(F.col("l_suppkey").alias("replica_id")).agg(
            F.count(F.lit(1)).alias("posts")
        ).select(int_chunk(F.col("replica_id"), 5).alias("cluster_id"), "replica_id", "posts")

    @cached_property
    def log_text(self) -> DataFrame:
        return self.base("pages").select(
            F.lit(0).alias("cluster_id"),
            F.col("page_id").alias("replica_id"),
            F.lit(0).alias("seq"),
            F.col("html").alias("raw"),
        )

    @cached_property
    def documents(self) -> DataFrame:
        return self.base("documents")


def item_outcome() -> list[Column]:
    """Response id of succeeded items and error of failed ones; pending items have neither."""
    failed = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")
    pending = (F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F")
    return [
        F.when(~failed & ~pending, F.concat(F.lit("chatcmpl-"), F.col("l_partkey"))).alias("response_id"),
        F.when(failed, F.concat(F.lit("err "), F.col("l_suppkey"))).alias("error"),
    ]


def events_view(raw: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return raw.select(
        # One cluster, as a computed column: a literal key would be folded out of the sorts
        # that the keyed streams rely on.
        (F.col("event_id") * 0).cast("int").alias("cluster_id"),
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        "event_type",
        "value",
        k.alias("k"),
        (k % 4).alias("node"),
    )


CLUSTERS = 20


def by_cluster(events: DataFrame) -> DataFrame:
    """Events of many clusters, each with as many nodes as ``k`` has values."""
    return events.withColumns({"cluster_id": (F.col("user_id") % CLUSTERS).cast("int"), "node": F.col("k")})


def dispatch_kind(event_type: Column) -> Column:
    return (
        F.when(event_type == "error", "failure")
        .when(event_type.isin("purchase", "signup"), "success")
        .otherwise("route")
    )


def requests_view(events: DataFrame) -> DataFrame:
    is_error = F.col("event_type") == "error"
    return events.select(
        "cluster_id",
        F.col("event_id").alias("request_id"),
        "ts",
        F.col("user_id").alias("api_key_id"),
        "node",
        F.col("value").alias("latency_ms"),
        F.when(is_error & (F.col("k") % 2 == 0), 500)
        .when(is_error, 429)
        .when(F.col("event_type") == "signup", 201)
        .when(F.col("event_type") == "purchase", 302)
        .otherwise(200)
        .alias("status"),
    )


def probes_view(events: DataFrame) -> DataFrame:
    return events.select(
        "cluster_id",
        "ts",
        F.col("event_id").alias("seq"),
        "node",
        (F.col("event_type") != "error").alias("healthy"),
    )


def ops_view(events: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "FAILOVER").when(F.col("event_type") == "click", "RETRY")
    return events.select(
        "cluster_id",
        "ts",
        F.col("event_id").alias("seq"),
        kind.otherwise("RESPAWN").alias("event"),
        "node",
    )


def status_view(probes: DataFrame) -> DataFrame:
    return probes.select(
        "cluster_id", "ts", "seq", "node", F.col("healthy").cast("double").alias("value")
    )


def job_events_view(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("job_id"),
        "ts",
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "signup", "PENDING")
        .when(F.col("event_type") == "view", "RUNNING")
        .when(F.col("event_type") == "purchase", "SUCCEEDED")
        .when(F.col("event_type") == "error", "FAILED")
        .otherwise("STOPPED")
        .alias("ray_status"),
    )


_K = "CAST(json_extract_string(props,'$.k') AS INTEGER)"
_ITEM_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate"

VIEW_SQL = {
    "ev": f"SELECT event_id, ts, user_id, event_type, value, {_K} AS k, {_K} % 4 AS node FROM events",
    "requests": """SELECT event_id AS request_id, ts, user_id AS api_key_id, node, value AS latency_ms,
        CASE WHEN event_type='error' AND k % 2 = 0 THEN 500 WHEN event_type='error' THEN 429
             WHEN event_type='signup' THEN 201 WHEN event_type='purchase' THEN 302 ELSE 200 END AS status
        FROM ev""",
    "probes": "SELECT ts, event_id AS seq, node, event_type <> 'error' AS healthy FROM ev",
    "dispatch_events": """SELECT user_id AS job_id, event_id AS seq, ts, node, value AS latency_ms,
        CASE event_type WHEN 'error' THEN 'failure' WHEN 'purchase' THEN 'success'
             WHEN 'signup' THEN 'success' ELSE 'route' END AS kind,
        CASE WHEN event_type='error' THEN concat('err-', event_id) END AS error FROM ev""",
    "ops_events": """SELECT ts, event_id AS seq, node,
        CASE event_type WHEN 'error' THEN 'FAILOVER' WHEN 'click' THEN 'RETRY' ELSE 'RESPAWN' END AS event FROM ev""",
    "counter_samples": """SELECT ts, event_id AS seq, node,
        CAST((row_number() OVER (PARTITION BY node ORDER BY event_id)) % 100 AS DOUBLE) AS value FROM ev""",
    "status_samples": """SELECT ts, event_id AS seq, node,
        CAST(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS DOUBLE) AS value FROM ev""",
    "job_events": """SELECT user_id AS job_id, ts, event_id AS seq,
        CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'view' THEN 'RUNNING'
             WHEN 'purchase' THEN 'SUCCEEDED' WHEN 'error' THEN 'FAILED' ELSE 'STOPPED' END AS ray_status
        FROM ev""",
    "batch_items": f"""SELECT l_orderkey AS job_id,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ITEM_ORDER}) AS ordinal,
        CASE WHEN NOT (l_returnflag IN ('R','N') AND l_linestatus='F')
             THEN concat('chatcmpl-', l_partkey) END AS response_id,
        CASE WHEN l_returnflag='R' AND l_linestatus='F' THEN concat('err ', l_suppkey) END AS error,
        CAST(l_quantity AS INTEGER) AS prompt_tokens, l_linenumber AS completion_tokens FROM lineitem""",
    "batch_jobs": """SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'completed'
        WHEN 'O' THEN 'failed' ELSE 'cancelled' END AS status, o_orderdate AS created_at FROM orders""",
    "token_jobs": """SELECT CAST(l_quantity AS INTEGER) AS input_tokens,
        CAST(l_partkey % 200 AS INTEGER) + 100 AS output_tokens FROM lineitem""",
    "members": """SELECT c_custkey // 25 AS cluster_id, c_custkey % 25 AS ordinal,
        concat('10.0.', (c_custkey % 25) % 5, '.', c_custkey % 25) AS ip, * FROM customer""",
    "nodes": """SELECT cluster_id, concat('ray-', c_custkey) AS node_id, ordinal, ip AS node_ip,
        CASE WHEN ordinal % 3 = 0 THEN ip ELSE c_name END AS node_name,
        CASE WHEN c_nationkey % 7 = 3 THEN 'DEAD' ELSE 'ALIVE' END AS state, ordinal = 0 AS is_head_node,
        CASE c_nationkey % 4 WHEN 0 THEN 'CPU' WHEN 1 THEN 'GPU' WHEN 2 THEN 'AMD_GPU'
             ELSE 'accelerator_type:X' END AS resource_key FROM members""",
    "up_nodes": "SELECT * FROM nodes WHERE cluster_id % 6 <> 5",
    "up_replicas": "SELECT * FROM replicas WHERE cluster_id % 6 <> 5",
    "replicas": """SELECT o_custkey // 25 AS cluster_id, o_orderkey AS replica_id, o_orderkey AS ordinal,
        concat('ray-', o_custkey) AS node_id,
        concat('10.0.', (o_custkey % 25) % 5, '.', o_custkey % 25) AS node_ip,
        CASE WHEN o_orderstatus <> 'O' THEN 'STOPPED' ELSE CASE o_orderkey % 6 WHEN 1 THEN 'STARTING' WHEN 2 THEN 'FAILED'
             WHEN 3 THEN 'RECOVERING' WHEN 4 THEN 'UNHEALTHY' ELSE 'RUNNING' END END AS state,
        concat('/tmp/session/logs/serve/', o_orderkey, '.log') AS log_file_path
        FROM orders""",
    "router_snapshot": """SELECT cluster_id, concat('node-', ordinal) AS name,
        CASE WHEN c_mktsegment = 'MACHINERY' THEN concat('10.8.0.', ordinal) ELSE ip END AS node_ip,
        CASE c_nationkey % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'primary' WHEN 2 THEN 'respawning'
             ELSE 'reserve' END AS status,
        c_custkey % 97 AS jobs_total, c_custkey % 7 AS jobs_failed, c_custkey % 13 AS respawns,
        c_custkey % 3 AS inflight, c_nationkey % 3 <> 0 AS readiness_ok, c_custkey % 11 <> 0 AS sla_ok,
        ordinal AS priority, CASE WHEN c_nationkey % 5 = 0 THEN concat('down ', c_custkey) END AS last_error,
        c_acctbal AS last_latency_ms, 1700000000.25::DOUBLE + c_custkey AS last_check,
        abs(c_acctbal) AS latency_p50_ms, abs(c_acctbal) * 2 AS latency_p95_ms, abs(c_acctbal) * 3 AS latency_p99_ms
        FROM members""",
    "node_registry": """SELECT cluster_id, concat('node-', ordinal) AS name,
        CASE WHEN ordinal % 3 = 2 THEN '10.9.9.9' WHEN ordinal % 5 = 0 THEN '' ELSE own END AS expected_ip,
        CASE WHEN ordinal % 11 = 0 THEN 'localhost' ELSE own END AS url_ip,
        ordinal AS priority, concat('alias-', c_custkey) AS alias
        FROM (SELECT *, CASE WHEN c_mktsegment IN ('BUILDING','FURNITURE') THEN ip
              ELSE concat('10.7.0.', ordinal) END AS own FROM members)""",
    "identifiers": """SELECT DISTINCT cluster_id, name, ip AS node_ip FROM (
        SELECT cluster_id, name, expected_ip AS ip FROM node_registry
        UNION ALL SELECT cluster_id, name, url_ip FROM node_registry)
        WHERE ip NOT IN ('', '127.0.0.1', 'localhost', '0.0.0.0')""",
    "snap_before": """SELECT l_suppkey // 5 AS cluster_id, l_suppkey AS replica_id, count(*) AS posts FROM lineitem
        WHERE l_shipdate < TIMESTAMP '1998-01-01' GROUP BY 1, 2""",
    "snap_after": "SELECT l_suppkey // 5 AS cluster_id, l_suppkey AS replica_id, count(*) AS posts FROM lineitem GROUP BY 1, 2",
    "log_text": "SELECT page_id AS replica_id, html AS raw FROM pages",
    "fleet": f"SELECT event_id, ts, user_id, event_type, value, k, CAST(user_id % {CLUSTERS} AS INTEGER) AS cluster_id, k AS node FROM ev",
}
# The same views over the events of many clusters.
for _name in ("requests", "probes", "ops_events", "status_samples"):
    _select, _, _source = VIEW_SQL[_name].rpartition(" FROM ev")
    VIEW_SQL[f"fleet_{_name}"] = f"{_select.replace('SELECT ', 'SELECT cluster_id, ', 1)} FROM fleet"

_NEEDS = {
    "requests": ["ev"],
    "probes": ["ev"],
    "dispatch_events": ["ev"],
    "ops_events": ["ev"],
    "counter_samples": ["ev"],
    "status_samples": ["ev"],
    "job_events": ["ev"],
    "nodes": ["members"],
    "up_nodes": ["members", "nodes"],
    "up_replicas": ["replicas"],
    "router_snapshot": ["members"],
    "node_registry": ["members"],
    "identifiers": ["members", "node_registry"],
    "fleet": ["ev"],
    **{f"fleet_{name}": ["ev", "fleet"] for name in ("requests", "probes", "ops_events", "status_samples")},
}


def with_views(*names: str, sql: str) -> str:
    """Prefix ``sql`` with the named views as common table expressions."""
    ordered: list[str] = []
    for name in names:
        for needed in [*_NEEDS.get(name, []), name]:
            if needed not in ordered:
                ordered.append(needed)
    parts = ",\n".join(f"{n} AS ({VIEW_SQL[n]})" for n in ordered)
    rest = sql.strip()
    if rest.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {parts},\n{rest[15:]}"
    if rest.upper().startswith("WITH "):
        return f"WITH {parts},\n{rest[5:]}"
    return f"WITH {parts}\n{rest}"
