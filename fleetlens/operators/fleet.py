"""Fleet state: nodes, replicas and router rows joined per cluster and snapshot.

``scope`` lists the columns that identify one snapshot of one cluster; every join and
grouping includes them, so a history of snapshots is processed at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.scalars import iso_time, node_display_name, node_identifiers
from fleetlens.functions.status import (
    FAILED_STATES,
    WARMING_STATES,
    is_alive_gpu_worker,
    is_routable,
    lifecycle_from_flags,
    replica_priority,
    router_role,
)
from fleetlens.operators.scan import by_number, by_time, row_index

SCOPE = ("cluster_id", "snapshot_ts")

# The texts of the checks.
MISSING_NODE_ERROR = "Node missing from Ray cluster"
CHECK_SKIPPED = "skipped (no expected identity configured)"
NODE_NOT_JOINED = "not joined to Ray cluster"
NODE_IN_STATE = "joined but state="
ALIVE = "ALIVE"
NO_HEAD = "no head node reported"
HEAD_MISMATCH = "head ip mismatch (saw "
HEAD_NOT_ALIVE = "head not ALIVE"
KEY_NOT_ADVERTISED = "no node advertises expected resource key"
MATCH_NOT_ALIVE = "matched node not ALIVE"
NODES_STUCK = "nodes stuck in recovery: "
NODES_NOT_READY = "routable nodes failing readiness: "
ALL_RECOVERED = "all nodes recovered and ready"
MOVING_STATUSES = ("DEPLOYING", "UPDATING", "RESTARTING")
SETTLED_STATUSES = ("RUNNING", "HEALTHY")
INTERNAL_HEAD_KEY = "node:InternalHead"

LISTING_CHUNK = 65536
# The default traffic split.
SPLIT_TARGET_PCT = 50.0
SPLIT_TOLERANCE_PCT = 5.0

# Router telemetry carried into the node view, with the value used when it is absent.
TELEMETRY_DEFAULTS = {
    "jobs_total": 0,
    "jobs_failed": 0,
    "respawns": 0,
    "inflight": 0,
    "last_latency_ms": 0.0,
    "latency_p50_ms": 0.0,
    "latency_p95_ms": 0.0,
    "latency_p99_ms": 0.0,
    "sla_ok": True,
    "sla_p95_target_ms": 0.0,
}


def _shared(scope: Sequence[str], df: DataFrame) -> list[str]:
    """The scope columns a configuration table has; it must at least name the cluster."""
    keys = [k for k in scope if k in df.columns]
    if not keys:
        raise ValueError(f"the configuration needs at least one of the columns {list(scope)}")
    return keys


def _in_scopes(wanted: DataFrame, observed: DataFrame, scope: list[str], keys: list[str], scopes: DataFrame | None) -> DataFrame:
    """``wanted`` for every scope it applies to: those of ``scopes``, or else those that report anything."""
    if keys == scope and scopes is None:
        return wanted
    every = (observed if scopes is None else scopes).select(*scope).distinct()
    return every.join(wanted, keys)


def _trimmed(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name).cast("string"), F.lit("")))


def alive_gpu_workers(nodes: DataFrame) -> DataFrame:
    return nodes.where(
        is_alive_gpu_worker(F.col("state"), F.col("is_head_node"), F.col("resources"))
    )


def running_replicas(replicas: DataFrame) -> DataFrame:
    return replicas.where(F.col("state") == "RUNNING")


def preferred_replica(replicas: DataFrame, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Best replica per node: running, warming, failed, other; then listing order."""
    state = _trimmed("state")
    best = F.min_by(
        F.struct(_trimmed("replica_id").alias("replica_id"), state.alias("state")),
        F.struct(replica_priority(state), F.col("ordinal")),
    )
    return (
        replicas.where(_trimmed("node_ip") != "")
        .groupBy(*scope, _trimmed("node_ip").alias("node_ip"))
        .agg(best.alias("__best"))
        .select(
            *scope,
            "node_ip",
            F.col("__best.replica_id").alias("replica_id"),
            F.col("__best.state").alias("state"),
        )
    )


def _replica_flags(replicas: DataFrame, scope: Sequence[str]) -> DataFrame:
    """One row per node: the preferred replica and which kinds of state occur."""
    state = _trimmed("state")
    best = F.min_by(
        F.struct(_trimmed("replica_id").alias("replica_id"), state.alias("state")),
        F.struct(replica_priority(state), F.col("ordinal")),
    )
    return (
        replicas.where(_trimmed("node_ip") != "")
        .groupBy(*scope, _trimmed("node_ip").alias("node_ip"))
        .agg(
            best.alias("__best"),
            F.some(state == "RUNNING").alias("__running"),
            F.some(state.isin(*WARMING_STATES)).alias("__warming"),
            F.some(state.isin(*FAILED_STATES)).alias("__failed"),
            F.array_sort(F.collect_list(F.when(state != "", F.struct("ordinal", state.alias("state"))))).alias("__listed"),
        )
    )


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def replica_states_by_ip(replicas: DataFrame, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Replica states per node in listing order, one row per replica; blank nodes skipped.

    ``position`` counts all replicas of the node. Rows rather than lists, so a node with
    very many replicas is no heavier than others. ``listed_state`` is null when blank.
    """
    rows = replicas.select(
        *scope,
        _trimmed("node_ip").alias("node_ip"),
        _trimmed("replica_id").alias("replica_id"),
        F.nullif(_trimmed("state"), F.lit("")).alias("listed_state"),
        "ordinal",
    ).where(F.col("node_ip") != "")
    slices = by_number(F.col("ordinal"), LISTING_CHUNK)
    return row_index(rows, [*scope, "node_ip"], [F.col("ordinal")], slices, "position").drop("ordinal")


def node_lifecycle(
    nodes: DataFrame, replicas: DataFrame, usable: Column, scope: Sequence[str] = SCOPE
) -> DataFrame:
    """Lifecycle of every listed node from all its replica states; joined means ALIVE."""
    scope = list(scope)
    joined = F.coalesce(F.col("state") == ALIVE, F.lit(False))
    return (
        nodes.select("*", joined.alias("__joined"), usable.alias("__usable"))
        .join(_replica_flags(replicas, scope), [*scope, "node_ip"], "left")
        .select(
            *scope,
            "node_ip",
            "node_id",
            lifecycle_from_flags(
                _flag("__running"), _flag("__warming"), _flag("__failed"), F.col("__joined"), F.col("__usable")
            ).alias("lifecycle"),
        )
    )


def router_by_ip(
    router: DataFrame, registry: DataFrame, scope: Sequence[str] = SCOPE
) -> DataFrame:
    """Router rows repeated for every address configured for their name.

    An address shared by several names belongs to the last of them in priority order.
    """
    keys = _shared(scope, registry)
    addresses = registry.select(
        *keys,
        "name",
        F.col("priority").alias("__rank"),
        F.explode(node_identifiers(F.col("expected_ip"), F.col("infer_url"))).alias("node_ip"),
    )
    rows = router.drop("node_ip").join(addresses, [*keys, "name"])
    carried = [c for c in rows.columns if c not in (*scope, "node_ip", "__rank")]
    return (
        rows.groupBy(*scope, "node_ip")
        .agg(F.max_by(F.struct(*carried), F.struct("__rank", "name")).alias("__row"))
        .select(*scope, "node_ip", "__row.*")
    )


def _telemetry(columns: Sequence[str]) -> list[Column]:
    return [
        F.coalesce(F.col(c), F.lit(default)).alias(c)
        for c, default in TELEMETRY_DEFAULTS.items()
        if c in columns
    ]


def _view_row(columns: Sequence[str], scope: Sequence[str], joined: bool, usable_default: bool):
    usable = F.coalesce("readiness_ok", F.lit(usable_default))
    status = lifecycle_from_flags(
        _flag("__running"), _flag("__warming"), _flag("__failed"), F.lit(joined), usable
    )
    return [
        *scope,
        "node_ip",
        status.alias("status"),
        router_role(
            F.when(F.col("router_name").isNotNull(), F.coalesce("raw_status", F.lit("")))
        ).alias("role"),
        F.coalesce("raw_status", F.lit("unmanaged")).alias("raw_status"),
        F.col("__best.replica_id").alias("serve_replica_id"),
        F.col("__best.state").alias("serve_replica_state"),
        F.coalesce(F.col("__listed.state"), F.array().cast("array<string>")).alias("replica_states"),
        F.lit(joined).alias("joined"),
        *([iso_time(F.col("last_check")).alias("last_check_iso")] if "last_check" in columns else []),
        *_telemetry(columns),
        F.coalesce("readiness_ok", F.lit(True)).alias("readiness_ok"),
    ]


def nodes_view(
    nodes: DataFrame,
    replicas: DataFrame,
    router: DataFrame,
    aliases: DataFrame | None = None,
    *,
    scope: Sequence[str] = SCOPE,
) -> DataFrame:
    """Live GPU workers with lifecycle, role, preferred replica and router telemetry.

    ``router`` carries one row per (scope, node_ip); see :func:`router_by_ip`. Of several
    live nodes listed under one address the last is shown. ``replica_states`` lists the states of the
    node's replicas in listing order, and ``last_check_iso`` is the router's last check where it knows the node.
    ``aliases`` maps node_ip, once each, to a display name for nodes named by address.
    """
    scope = list(scope)
    live = (
        alive_gpu_workers(nodes)
        .where(_trimmed("node_ip") != "")
        .groupBy(*scope, _trimmed("node_ip").alias("node_ip"))
        .agg(F.max_by(F.struct("node_id", "node_name"), "ordinal").alias("__node"))
        .select(*scope, "node_ip", "__node.*")
    )
    rows = router.withColumnRenamed("status", "raw_status").withColumnRenamed("name", "router_name")
    joined = live.join(_replica_flags(replicas, scope), [*scope, "node_ip"], "left").join(
        rows, [*scope, "node_ip"], "left"
    )
    alias = F.lit(None).cast("string")
    if aliases is not None:
        keys = [*[k for k in scope if k in aliases.columns], "node_ip"]
        joined = joined.join(aliases.select(*keys, F.col("alias").alias("__alias")), keys, "left")
        alias = F.col("__alias")
    return joined.select(
        node_display_name(F.col("node_name"), F.col("node_ip"), alias).alias("name"),
        F.nullif(F.col("node_id"), F.lit("")).alias("node_id"),
        F.col("last_error"),
        *_view_row(joined.columns, scope, True, True),
    )


def offline_rows(
    nodes: DataFrame,
    replicas: DataFrame,
    router: DataFrame,
    labels: DataFrame | None = None,
    *,
    scope: Sequence[str] = SCOPE,
) -> DataFrame:
    """Router rows whose address is not a live GPU worker."""
    scope = list(scope)
    live = alive_gpu_workers(nodes).select(*scope, _trimmed("node_ip").alias("node_ip"))
    rows = router.withColumnRenamed("status", "raw_status").withColumnRenamed("name", "router_name")
    joined = rows.join(live, [*scope, "node_ip"], "left_anti").join(
        _replica_flags(replicas, scope), [*scope, "node_ip"], "left"
    )
    name = F.coalesce("router_name", F.lit("unknown"))
    if labels is not None:
        joined = node_label(joined, labels, "router_name", "__label")
        name = F.coalesce("__label", F.lit("unknown"))
    error = F.when(F.coalesce("last_error", F.lit("")) == "", MISSING_NODE_ERROR).otherwise(F.col("last_error"))
    return joined.select(
        name.alias("name"),
        F.lit(None).cast("string").alias("node_id"),
        error.alias("last_error"),
        *_view_row(joined.columns, scope, False, False),
    )


def nodes_view_offline(
    nodes: DataFrame,
    replicas: DataFrame,
    router: DataFrame,
    aliases: DataFrame | None = None,
    labels: DataFrame | None = None,
    *,
    scope: Sequence[str] = SCOPE,
) -> DataFrame:
    """The node view with the router rows of absent nodes appended."""
    return nodes_view(nodes, replicas, router, aliases, scope=scope).unionByName(
        offline_rows(nodes, replicas, router, labels, scope=scope)
    )


def node_label(df: DataFrame, labels: DataFrame, name: str, out: str) -> DataFrame:
    """Label of a node name from a (name, label) dimension, the name itself by default."""
    known = labels.select(F.col("name").alias(name), F.col("label").alias("__known"))
    return df.join(known, name, "left").withColumn(out, F.coalesce("__known", name)).drop("__known")


def lifecycle_by_name(
    registry: DataFrame,
    nodes: DataFrame,
    replicas: DataFrame,
    router: DataFrame,
    *,
    scope: Sequence[str] = SCOPE,
    scopes: DataFrame | None = None,
) -> DataFrame:
    """Lifecycle per configured name over all of its addresses.

    ``router`` gives (scope, name, readiness_ok). Names of a scope without any node are there too: ``scopes`` lists
    the scopes where ``registry`` does not name them in full.
    """
    scope = list(scope)
    keys = _shared(scope, registry)
    named = _in_scopes(registry.select(*keys, "name", "expected_ip", "infer_url"), nodes, scope, keys, scopes)
    addresses = named.select(
        *scope,
        "name",
        F.explode_outer(node_identifiers(F.col("expected_ip"), F.col("infer_url"))).alias("node_ip"),
    )
    live = (
        alive_gpu_workers(nodes)
        .select(*scope, _trimmed("node_ip").alias("node_ip"))
        .distinct()
        .withColumn("__joined", F.lit(True))
    )
    per_name = (
        addresses.join(live, [*scope, "node_ip"], "left")
        .join(_replica_flags(replicas, scope), [*scope, "node_ip"], "left")
        .groupBy(*scope, "name")
        .agg(
            F.some(_flag("__joined")).alias("joined"),
            *[F.some(_flag(f)).alias(f) for f in ("__running", "__warming", "__failed")],
        )
    )
    ready = router.select(*scope, "name", "readiness_ok")
    usable = _flag("readiness_ok")
    return per_name.join(ready, [*scope, "name"], "left").select(
        *scope,
        "name",
        "joined",
        usable.alias("readiness_ok"),
        lifecycle_from_flags(
            F.col("__running"), F.col("__warming"), F.col("__failed"), F.col("joined"), usable
        ).alias("lifecycle"),
    )


def expected_node_checks(
    expected: DataFrame, nodes: DataFrame, scope: Sequence[str] = SCOPE, scopes: DataFrame | None = None
) -> DataFrame:
    """Expected (name, expected_ip) against the node list: pass flag and reason.

    ``scopes`` lists the scopes to judge, so that one without any node fails instead of vanishing.
    """
    scope = list(scope)
    keys = _shared(scope, expected)
    seen = nodes.groupBy(*scope, _trimmed("node_ip").alias("expected_ip")).agg(
        F.some(F.coalesce(F.col("state") == ALIVE, F.lit(False))).alias("__alive"),
        F.min_by("state", "ordinal").alias("__first"),
    )
    wanted = expected.select(*keys, "name", F.coalesce("expected_ip", F.lit("")).alias("expected_ip"))
    wanted = _in_scopes(wanted, nodes, scope, keys, scopes)
    absent = F.col("__alive").isNull()
    skipped = F.col("expected_ip") == ""
    passed = skipped | F.coalesce("__alive", F.lit(False))
    detail = (
        F.when(skipped, CHECK_SKIPPED)
        .when(absent, NODE_NOT_JOINED)
        .when(~F.col("__alive"), F.concat(F.lit(NODE_IN_STATE), F.coalesce("__first", F.lit("None"))))
        .otherwise(ALIVE)
    )
    return wanted.join(seen, [*scope, "expected_ip"], "left").select(
        *scope, "name", F.col("expected_ip").alias("expected"), passed.alias("passed"), detail.alias("detail")
    )


def head_check(
    config: DataFrame, nodes: DataFrame, scope: Sequence[str] = SCOPE, scopes: DataFrame | None = None
) -> DataFrame:
    """Whether the expected head is reported and alive; ``config`` has expected_head_ip.

    A configured scope without nodes fails; ``scopes`` lists the scopes where ``config`` does not name them in full.
    """
    scope = list(scope)
    keys = _shared(scope, config)
    ip = _trimmed("node_ip")
    is_head = F.coalesce("is_head_node", F.lit(False))
    wanted = config.select(*keys, F.coalesce("expected_head_ip", F.lit("")).alias("expected"))
    per_scope = (
        _in_scopes(wanted, nodes, scope, keys, scopes).join(nodes, scope, "left")
        .groupBy(*scope, "expected")
        .agg(
            F.count_if(is_head).alias("__heads"),
            F.some(is_head & (ip == F.col("expected"))).alias("__matches"),
            F.some(is_head & F.coalesce(F.col("state") == ALIVE, F.lit(False))).alias("__alive"),
            F.min_by(F.when(is_head, ip), F.when(is_head, F.col("ordinal"))).alias("__first"),
        )
    )
    mismatch = (F.col("expected") != "") & ~F.col("__matches")
    detail = (
        F.when(F.col("__heads") == 0, NO_HEAD)
        .when(mismatch, F.concat(F.lit(HEAD_MISMATCH), F.col("__first"), F.lit(")")))
        .when(F.col("__alive"), ALIVE)
        .otherwise(HEAD_NOT_ALIVE)
    )
    passed = F.coalesce((F.col("__heads") > 0) & ~mismatch & F.col("__alive"), F.lit(False))
    return per_scope.select(
        *scope, F.lit("head").alias("name"), "expected", passed.alias("passed"), detail.alias("detail")
    )


def resource_key_check(
    expected: DataFrame, nodes: DataFrame, scope: Sequence[str] = SCOPE, scopes: DataFrame | None = None
) -> DataFrame:
    """Nodes identified by address, else by any node advertising ``resource_key``.

    The map is exploded to one row per advertised key, so the match is an equi-join.
    """
    scope = list(scope)
    keys = _shared(scope, expected)
    by_ip = F.coalesce("expected_ip", F.lit("")) != ""
    direct = expected_node_checks(expected.where(by_ip), nodes, scope, scopes)
    advertised = (
        nodes.select(*scope, "state", F.explode(F.map_keys("resources")).alias("expected"))
        .groupBy(*scope, "expected")
        .agg(F.some(F.coalesce(F.col("state") == ALIVE, F.lit(False))).alias("__alive"))
    )
    wanted = expected.where(~by_ip).select(*keys, "name", F.col("resource_key").alias("expected"))
    wanted = _in_scopes(wanted, nodes, scope, keys, scopes)
    detail = (
        F.when(F.col("__alive").isNull(), KEY_NOT_ADVERTISED)
        .when(F.col("__alive"), ALIVE)
        .otherwise(MATCH_NOT_ALIVE)
    )
    by_key = wanted.join(advertised, [*scope, "expected"], "left").select(
        *scope,
        "name",
        "expected",
        F.coalesce("__alive", F.lit(False)).alias("passed"),
        detail.alias("detail"),
    )
    return direct.unionByName(by_key)


def required_node_keys(expected: DataFrame) -> DataFrame:
    """Usage keys each cluster must report: ``node:<ip>`` per role.

    ``expected`` has (cluster_id, role, ip). A standby without a real address is optional;
    the internal head key is always required.
    """
    optional = (F.col("role") == "standby") & F.coalesce("ip", F.lit("")).isin("", "127.0.0.1")
    listed = expected.where(~optional).select("cluster_id", F.concat(F.lit("node:"), "ip").alias("key"))
    internal = expected.select("cluster_id", F.lit(INTERNAL_HEAD_KEY).alias("key"))
    return listed.unionByName(internal).distinct()


def missing_nodes(
    required: DataFrame, usage: DataFrame, scope: Sequence[str] = SCOPE, scopes: DataFrame | None = None
) -> DataFrame:
    """Required keys absent from the reported usage keys ``(scope, key)``; ``scopes`` lists the scopes to judge."""
    scope = list(scope)
    keys = _shared(scope, required)
    required = _in_scopes(required, usage, scope, keys, scopes)
    return required.join(usage.select(*scope, "key"), [*scope, "key"], "left_anti")


def expected_covered(
    expected: DataFrame, replicas: DataFrame, scope: Sequence[str] = SCOPE, scopes: DataFrame | None = None
) -> DataFrame:
    """Whether every expected address of a scope has a running replica; ``scopes`` lists the scopes to judge."""
    scope = list(scope)
    keys = _shared(scope, expected)
    wanted = expected.select(*keys, "node_ip")
    wanted = _in_scopes(wanted, replicas, scope, keys, scopes)
    running = running_replicas(replicas).select(*scope, "node_ip").distinct()
    return (
        wanted.join(running.withColumn("__hit", F.lit(True)), [*scope, "node_ip"], "left")
        .groupBy(*scope)
        .agg(
            F.count_if(F.col("__hit").isNull()).alias("missing"),
            F.every(F.col("__hit").isNotNull()).alias("covered"),
        )
    )


def replica_spread(replicas: DataFrame, scope: Sequence[str] = SCOPE, scopes: DataFrame | None = None) -> DataFrame:
    """At least two running replicas on at least two distinct nodes; a scope of ``scopes`` without replicas has none."""
    running = F.col("state") == "RUNNING"
    per_node = replicas.groupBy(*scope, "node_ip").agg(F.count_if(running).alias("__running"))
    counts = per_node.groupBy(*scope).agg(
        F.sum("__running").alias("running"),
        F.count_if(F.col("__running") > 0).alias("distinct_nodes"),
    )
    if scopes is not None:
        counts = scopes.select(*scope).distinct().join(counts, list(scope), "left").fillna(0, ["running", "distinct_nodes"])
    return (
        counts.withColumn("spread", (F.col("running") >= 2) & (F.col("distinct_nodes") >= 2))
    )


def health_rollup(
    statuses: DataFrame, apps: Sequence[str], scope: Sequence[str] = SCOPE, scopes: DataFrame | None = None
) -> DataFrame:
    """Overall health of the named apps with their deployments.

    ``statuses`` has one row per app and per deployment: (scope, app, status). A missing
    app counts as a blank status, so the whole is pending at best. So are scopes that have
    none of the apps, and those of ``scopes`` that report nothing.
    """
    status = F.coalesce("status", F.lit(""))
    bad = F.some(status == "UNHEALTHY")
    moving = F.some(status.isin(*MOVING_STATUSES))
    fine = F.every(status.isin(*SETTLED_STATUSES))
    present = [F.some(F.col("app") == app) for app in apps]
    for seen in present:
        fine = fine & seen
    named = F.col("app").isin(*apps)
    found = (
        statuses.where(named)
        .groupBy(*scope)
        .agg(
            F.when(bad, "UNHEALTHY")
            .when(moving, "UPDATING")
            .when(fine, "HEALTHY")
            .otherwise("pending")
            .alias("health")
        )
    )
    every = (statuses if scopes is None else scopes).select(*scope).distinct()
    return every.join(found, list(scope), "left").fillna("pending", ["health"])


def active_standby_lists(router: DataFrame, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Sorted names of the primaries and of the reserves."""

    def names(status: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("status") == status, F.col("name"))))

    return router.groupBy(*scope).agg(
        names("primary").alias("active"), names("reserve").alias("standby")
    )


def routable_check(
    router: DataFrame, primary_count: int = 1, scope: Sequence[str] = SCOPE
) -> DataFrame:
    """Enough routable nodes, with every node's status in name order."""
    described = F.struct("name", F.concat_ws("=", "name", F.coalesce("status", F.lit("None"))).alias("text"))
    return (
        router.groupBy(*scope)
        .agg(
            F.count_if(is_routable(F.col("status"))).alias("routable"),
            F.array_sort(F.collect_list(described)).alias("__all"),
        )
        .select(
            *scope,
            "routable",
            (F.col("routable") >= primary_count).alias("passed"),
            F.array_join(F.col("__all.text"), ", ").alias("detail"),
        )
    )


def stuck_check(router: DataFrame, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Nodes stuck in recovery, else routable nodes that are not ready."""
    stuck = F.col("status").isin("failed", "respawning")
    unready = is_routable(F.col("status")) & ~F.coalesce("readiness_ok", F.lit(False))

    def names(condition: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(condition, F.col("name"))))

    def listed(column: str) -> Column:
        return F.concat(F.lit("['"), F.array_join(F.col(column), "', '"), F.lit("']"))

    detail = (
        F.when(F.size("stuck") > 0, F.concat(F.lit(NODES_STUCK), listed("stuck")))
        .when(
            F.size("not_ready") > 0,
            F.concat(F.lit(NODES_NOT_READY), listed("not_ready")),
        )
        .otherwise(ALL_RECOVERED)
    )
    return (
        router.groupBy(*scope)
        .agg(names(stuck).alias("stuck"), names(unready).alias("not_ready"))
        .select(
            *scope,
            ((F.size("stuck") == 0) & (F.size("not_ready") == 0)).alias("passed"),
            detail.alias("detail"),
        )
    )


def _by_priority(df: DataFrame, scope: Sequence[str], out: str) -> DataFrame:
    """Position within the scope by priority, then listing name; a scope has no more rows than nodes in one snapshot."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*scope).orderBy("priority", "name")).cast("long"))


def elect_primaries(
    router: DataFrame, primary_count: int = 1, scope: Sequence[str] = SCOPE
) -> DataFrame:
    """Among routable nodes, the first by priority become primary, the rest reserve."""
    ranked = _by_priority(router.where(is_routable(F.col("status"))), scope, "position")
    return ranked.select(
        *scope,
        "name",
        "priority",
        F.when(F.col("position") <= primary_count, "primary").otherwise("reserve").alias("elected"),
    )


def failover_promotion(router: DataFrame, scope: Sequence[str] = SCOPE) -> DataFrame:
    """For each failed node, the ready reserve with the lowest priority, if any."""
    scope = list(scope)
    ready = router.where((F.col("status") == "reserve") & F.col("readiness_ok"))
    chosen = ready.groupBy(*scope).agg(F.min_by("name", F.struct("priority", "name")).alias("promoted"))
    failed = router.where(F.col("status") == "failed")
    return failed.select(*scope, F.col("name").alias("failed_node")).join(chosen, scope, "left")


def eligible_nodes(router: DataFrame, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Nodes that take traffic: primaries, else reserves; those within SLA, else all."""
    scope = list(scope)
    sla = F.coalesce("sla_ok", F.lit(True)) if "sla_ok" in router.columns else F.lit(True)
    tiered = router.where(is_routable(F.col("status"))).select(
        *scope,
        "name",
        "priority",
        (F.when(F.col("status") == "primary", 0).otherwise(2) + F.when(sla, 0).otherwise(1)).alias("__tier"),
    )
    best = tiered.groupBy(*scope).agg(F.min("__tier").alias("__tier"))
    return tiered.join(best, [*scope, "__tier"]).drop("__tier")


def round_robin_assign(
    requests: DataFrame,
    router: DataFrame,
    *,
    scope: Sequence[str] = ("cluster_id",),
    chunk_s: float = 300,
) -> DataFrame:
    """Requests handed to the eligible nodes in turn, by arrival and priority.

    Needs ``ts`` and ``request_id`` on the requests. Requests of a scope without an
    eligible node keep a null node.
    """
    scope = list(scope)
    slots = _by_priority(eligible_nodes(router, scope), scope, "__slot").select(
        *scope, "__slot", F.col("name").alias("assigned")
    )
    sizes = slots.groupBy(*scope).agg(F.max("__slot").alias("__n"))
    numbered = row_index(
        requests,
        scope,
        [F.col("ts"), F.col("request_id")],
        by_time(F.col("ts"), chunk_s, split=True),
        "turn",
    )
    return (
        numbered.join(sizes, scope, "left")
        .withColumn("__slot", F.try_mod(F.col("turn") - 1, F.col("__n")) + 1)
        .join(slots, [*scope, "__slot"], "left")
        .drop("__slot", "__n")
    )


def snapshot_delta(
    before: DataFrame, after: DataFrame, keys: Sequence[str] = ("cluster_id", "replica_id")
) -> DataFrame:
    """Growth of each replica's count; a replica absent afterwards is flagged."""
    keys = list(keys)
    later = after.select(*keys, F.col("posts").alias("__after"))
    return before.join(later, keys, "left").select(
        *keys,
        (F.col("__after") - F.col("posts")).alias("delta"),
        F.col("__after").isNull().alias("missing"),
    )


def traffic_shares(deltas: DataFrame, by: Sequence[str] = ("cluster_id",)) -> DataFrame:
    """Each replica's share of its cluster's traffic, in percent."""
    by = list(by)
    totals = deltas.groupBy(*by).agg(F.sum("delta").alias("__total"))
    return (
        deltas.join(totals, by)
        .withColumn("share_pct", F.try_divide(F.col("delta") * 100.0, F.col("__total")))
        .drop("__total")
    )


def traffic_split(
    deltas: DataFrame,
    by: Sequence[str] = ("cluster_id",),
    *,
    target_pct: float = SPLIT_TARGET_PCT,
    tolerance_pct: float = SPLIT_TOLERANCE_PCT,
) -> DataFrame:
    """Largest deviation of any replica's share from the target, and the verdict.

    The extreme shares come from the extreme deltas, so one aggregation is enough. A
    replica without growth, or missing afterwards, fails the split.
    """
    total = F.col("__total")
    high = F.try_divide(F.col("__max") * 100.0, total)
    low = F.try_divide(F.col("__min") * 100.0, total)
    return (
        deltas.groupBy(*by)
        .agg(
            F.sum("delta").alias("__total"),
            F.max("delta").alias("__max"),
            F.min("delta").alias("__min"),
            F.some(F.col("missing") | (F.col("delta") <= 0)).alias("no_traffic"),
        )
        .withColumn("max_error_pct", F.greatest(F.abs(high - target_pct), F.abs(low - target_pct)))
        .withColumn(
            "passed",
            ~F.col("no_traffic") & F.coalesce(F.col("max_error_pct") <= tolerance_pct, F.lit(False)),
        )
        .drop("__total", "__max", "__min")
    )


def node_counters(
    dispatch: DataFrame, by: Sequence[str] = ("cluster_id", "node"), job: str = "job_id"
) -> DataFrame:
    """Dispatch, failure and in-flight counts per node, with its last latency and error.

    A job is in flight on the node of its last event when that event is a route. The
    last error is cleared by any later route or success on the node.
    """
    by = list(by)
    kind = F.col("kind")
    success = F.when(kind == "success", F.col("seq"))
    per_node = dispatch.groupBy(*by).agg(
        F.count_if(kind == "route").alias("jobs_total"),
        F.count_if(kind == "failure").alias("jobs_failed"),
        F.coalesce(F.max_by("latency_ms", success), F.lit(0.0)).alias("last_latency_ms"),
        F.max_by(F.struct(F.when(kind == "failure", F.col("error")).alias("e")), "seq")["e"].alias("last_error"),
    )
    cluster = [c for c in by if c != "node"]
    last = dispatch.groupBy(*cluster, job).agg(F.max_by(F.struct("kind", "node"), "seq").alias("__last"))
    flying = (
        last.where(F.col("__last.kind") == "route")
        .groupBy(*cluster, F.col("__last.node").alias("node"))
        .agg(F.count(F.lit(1)).alias("inflight"))
    )
    return per_node.join(flying, by, "left").fillna(0, ["inflight"])


