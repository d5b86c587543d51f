import pytest
from pyspark.sql import functions as F

from fleetlens.functions import scalars, status
from fleetlens.operators import fleet

SCOPE = ("cluster_id",)
NODE = (
    "cluster_id int, ordinal int, node_id string, node_ip string, node_name string, state string, "
    "is_head_node boolean, resources map<string,double>"
)
REPLICA = "cluster_id int, ordinal int, replica_id string, node_ip string, state string"
ROUTER = (
    "cluster_id int, name string, node_ip string, status string, readiness_ok boolean, last_error string, "
    "jobs_total bigint, priority int, sla_ok boolean"
)
GPU = {"GPU": 1.0}


def nodes(spark, *data):
    return spark.createDataFrame([(0, *row) for row in data], NODE)


def replicas(spark, *data):
    return spark.createDataFrame([(0, i, *row) for i, row in enumerate(data)], REPLICA)


def router(spark, *data):
    return spark.createDataFrame([(0, *row) for row in data], ROUTER)


@pytest.mark.parametrize(
    "states, joined, usable, expected",
    [
        (["RUNNING"], True, True, "LIVE"),
        (["STARTING"], True, True, "WARMING"),
        (["PENDING"], True, True, "WARMING"),
        (["RECOVERING"], True, True, "WARMING"),
        ([], True, True, "IDLE"),
        (["FAILED"], True, True, "FAILED"),
        ([], True, False, "FAILED"),
        ([], False, True, "OFFLINE"),
        ([], False, False, "OFFLINE"),
        (["FAILED", "RUNNING"], False, False, "LIVE"),
    ],
)
def test_lifecycle_truth_table(spark, states, joined, usable, expected):
    df = spark.createDataFrame([(states, joined, usable)], "s array<string>, j boolean, u boolean")
    got = df.select(status.resolve_lifecycle(F.col("s"), F.col("j"), F.col("u"))).first()[0]
    assert got == expected


def test_node_view_keeps_names_and_lifecycle(spark):
    alive = nodes(
        spark,
        (0, "r1", "10.0.0.1", "first", "ALIVE", False, GPU),
        (1, "r2", "10.0.0.2", "second", "ALIVE", False, GPU),
        (2, "r3", "10.0.0.3", "10.0.0.3", "ALIVE", None, {"accelerator_type:X": 1.0}),
        (3, "r4", "10.0.0.4", "head", "ALIVE", True, GPU),
        (4, "r5", "10.0.0.5", "dead", "DEAD", False, GPU),
        (5, "r6", "10.0.0.6", "cpu", "ALIVE", False, {"CPU": 1.0}),
        (6, "r7", "10.0.0.2", "relisted", "ALIVE", False, GPU),
    )
    reps = replicas(spark, ("a", "10.0.0.1", "FAILED"), ("b", " 10.0.0.1", "RUNNING"), ("c", "", "RUNNING"))
    routed = router(spark, ("n1", "10.0.0.1", "primary", True, None, 7, 0, True))
    aliases = spark.createDataFrame([("10.0.0.3", "third")], "node_ip string, alias string")
    got = {r["node_ip"]: r for r in fleet.nodes_view(alive, reps, routed, aliases, scope=SCOPE).collect()}
    assert set(got) == {"10.0.0.1", "10.0.0.2", "10.0.0.3"}
    one = got["10.0.0.1"]
    assert (one["status"], one["role"], one["serve_replica_id"], one["jobs_total"]) == ("LIVE", "active", "b", 7)
    two = got["10.0.0.2"]
    assert (two["name"], two["status"], two["role"], two["raw_status"]) == ("relisted", "IDLE", "unmanaged", "unmanaged")
    assert (two["jobs_total"], two["readiness_ok"]) == (0, True)
    assert got["10.0.0.3"]["name"] == "third"


def test_router_only_node_is_offline_and_keeps_its_error(spark):
    none, no_reps = nodes(spark).limit(0), replicas(spark).limit(0)
    routed = router(
        spark,
        ("a", "10.0.0.9", "reserve", False, "heartbeat timeout", 0, 0, True),
        ("b", "10.0.0.8", "reserve", None, "", 0, 1, True),
    )
    assert fleet.nodes_view(none, no_reps, routed, scope=SCOPE).count() == 0
    labels = spark.createDataFrame([("a", "Label A")], "name string, label string")
    got = {r["node_ip"]: r for r in fleet.nodes_view_offline(none, no_reps, routed, None, labels, scope=SCOPE).collect()}
    assert got["10.0.0.9"]["status"] == "OFFLINE"
    assert (got["10.0.0.9"]["last_error"], got["10.0.0.9"]["name"]) == ("heartbeat timeout", "Label A")
    assert (got["10.0.0.8"]["last_error"], got["10.0.0.8"]["name"]) == (fleet.MISSING_NODE_ERROR, "b")


def test_expected_head_and_resource_checks(spark):
    listed = nodes(
        spark,
        (0, "h", "10.0.0.1", "head", "ALIVE", True, {"CPU": 1.0}),
        (1, "d", "10.0.0.2", "dead", "DEAD", False, GPU),
        (2, "g", "10.0.0.3", "gpu", "ALIVE", False, {"RENTED": 1.0}),
    )
    expected = spark.createDataFrame(
        [(0, "a", "10.0.0.3"), (0, "b", "10.0.0.2"), (0, "c", "10.9.9.9"), (0, "d", ""), (0, "e", None)],
        "cluster_id int, name string, expected_ip string",
    )
    got = {r["name"]: (r["passed"], r["detail"]) for r in fleet.expected_node_checks(expected, listed, SCOPE).collect()}
    skipped = (True, "skipped (no expected identity configured)")
    assert got == {
        "a": (True, "ALIVE"),
        "b": (False, "joined but state=DEAD"),
        "c": (False, "not joined to Ray cluster"),
        "d": skipped,
        "e": skipped,
    }
    wrong = spark.createDataFrame([(0, "10.0.0.7")], "cluster_id int, expected_head_ip string")
    row = fleet.head_check(wrong, listed, SCOPE).first()
    assert (row["passed"], row["detail"]) == (False, "head ip mismatch (saw 10.0.0.1)")
    wanted = spark.createDataFrame(
        [(0, "r", "", "RENTED"), (0, "s", "", "GPU"), (0, "t", "", "TPU"), (0, "u", "10.0.0.3", "TPU")],
        "cluster_id int, name string, expected_ip string, resource_key string",
    )
    got = {r["name"]: (r["passed"], r["detail"]) for r in fleet.resource_key_check(wanted, listed, SCOPE).collect()}
    assert got == {
        "r": (True, "ALIVE"),
        "s": (False, "matched node not ALIVE"),
        "t": (False, "no node advertises expected resource key"),
        "u": (True, "ALIVE"),
    }


def test_standby_key_is_required_only_with_a_real_address(spark):
    schema = "cluster_id int, role string, ip string"
    loop = spark.createDataFrame([(0, "head", "10.0.0.1"), (0, "standby", "127.0.0.1")], schema)
    real = spark.createDataFrame([(0, "head", "10.0.0.1"), (0, "standby", "10.0.0.2")], schema)
    assert {r["key"] for r in fleet.required_node_keys(loop).collect()} == {"node:10.0.0.1", "node:InternalHead"}
    assert "node:10.0.0.2" in {r["key"] for r in fleet.required_node_keys(real).collect()}


def test_health_rollup_needs_both_apps(spark):
    data = [
        (1, "gateway", "RUNNING"), (1, "model", "HEALTHY"),
        (2, "gateway", "RUNNING"),
        (3, "gateway", "UPDATING"), (3, "model", "RUNNING"),
        (4, "gateway", "UPDATING"), (4, "model", "UNHEALTHY"),
    ]
    df = spark.createDataFrame(data, "cluster_id int, app string, status string")
    got = {r["cluster_id"]: r["health"] for r in fleet.health_rollup(df, ["gateway", "model"], SCOPE).collect()}
    assert got == {1: "HEALTHY", 2: "pending", 3: "UPDATING", 4: "UNHEALTHY"}


def test_election_and_promotion(spark):
    state = router(
        spark,
        ("a", "1", "failed", False, None, 0, 0, True),
        ("b", "2", "reserve", False, None, 0, 1, True),
        ("c", "3", "reserve", True, None, 0, 2, True),
        ("d", "4", "reserve", True, None, 0, 3, True),
    )
    assert fleet.failover_promotion(state, SCOPE).first()["promoted"] == "c"
    elected = {r["name"]: r["elected"] for r in fleet.elect_primaries(state, 1, SCOPE).collect()}
    assert elected == {"b": "primary", "c": "reserve", "d": "reserve"}


@pytest.mark.parametrize(
    "sla, expected", [((True, False), {"a"}), ((False, False), {"a", "b"}), ((True, True), {"a", "b"})]
)
def test_breaching_nodes_get_traffic_only_when_all_breach(spark, sla, expected):
    state = router(
        spark,
        ("a", "1", "primary", True, None, 0, 0, sla[0]),
        ("b", "2", "primary", True, None, 0, 1, sla[1]),
        ("c", "3", "reserve", True, None, 0, 2, True),
    )
    assert {r["name"] for r in fleet.eligible_nodes(state, SCOPE).collect()} == expected


def test_round_robin_without_eligible_nodes_keeps_requests(spark):
    state = router(spark, ("a", "1", "failed", True, None, 0, 0, True))
    calls = spark.range(5).select(F.lit(0).alias("cluster_id"), F.col("id").alias("request_id"), F.timestamp_seconds("id").alias("ts"))
    got = fleet.round_robin_assign(calls, state).collect()
    assert len(got) == 5 and all(r["assigned"] is None for r in got)


def test_traffic_split_verdicts(spark):
    schema = "cluster_id int, replica_id int, posts bigint"
    before = spark.createDataFrame([(0, 1, 10), (0, 2, 10), (1, 1, 5), (1, 2, 5), (2, 1, 0), (2, 2, 0)], schema)
    after = spark.createDataFrame([(0, 1, 62), (0, 2, 58), (1, 1, 9), (1, 2, 5), (2, 1, 3)], schema)
    deltas = fleet.snapshot_delta(before, after)
    got = {r["cluster_id"]: r for r in fleet.traffic_split(deltas).collect()}
    assert got[0]["passed"] and got[0]["max_error_pct"] == pytest.approx(2.0)
    assert got[1]["no_traffic"] and not got[1]["passed"]
    assert got[2]["no_traffic"] and not got[2]["passed"]


def test_node_counters_count_retries_and_flights(spark):
    trace = [
        (0, 1, 1, "route", "a", None, None), (0, 1, 2, "failure", "a", None, "boom"),
        (0, 1, 3, "route", "b", None, None), (0, 1, 4, "success", "b", 12.5, None),
        (0, 2, 5, "route", "b", None, None),
    ]
    df = spark.createDataFrame(
        trace, "cluster_id int, job_id int, seq int, kind string, node string, latency_ms double, error string"
    )
    got = {r["node"]: r for r in fleet.node_counters(df).collect()}
    a, b = got["a"], got["b"]
    assert (a["jobs_total"], a["jobs_failed"], a["inflight"], a["last_error"]) == (1, 1, 0, "boom")
    assert (b["jobs_total"], b["jobs_failed"], b["inflight"], b["last_latency_ms"], b["last_error"]) == (2, 0, 1, 12.5, None)


def test_stuck_check_texts(spark):
    def check(*data):
        row = fleet.stuck_check(router(spark, *data), SCOPE).first()
        return row["passed"], row["detail"]

    ok = ("a", "1", "primary", True, None, 0, 0, True)
    assert check(ok) == (True, "all nodes recovered and ready")
    assert check(ok, ("c", "2", "failed", True, None, 0, 1, True), ("b", "3", "respawning", True, None, 0, 2, True)) == (
        False, "nodes stuck in recovery: ['b', 'c']",
    )
    assert check(ok, ("c", "2", "reserve", None, None, 0, 1, True)) == (
        False, "routable nodes failing readiness: ['c']",
    )


def test_scalars(spark):
    df = spark.createDataFrame(
        [("http://User@Host.Example:80/x", "/tmp/logs/serve/a.log", 100.0), ("not a url", "//x/y.log", 0.5), (None, "z", None)],
        "url string, path string, t double",
    )
    got = df.select(
        scalars.url_host(F.col("url")), scalars.log_filename(F.col("path")), scalars.iso_time(F.col("t"))
    ).collect()
    assert [tuple(r) for r in got] == [
        ("host.example", "serve/a.log", "1970-01-01T00:01:40Z"),
        ("", "x/y.log", "1970-01-01T00:00:00.500000Z"),
        ("", "z", None),
    ]
    mem = spark.createDataFrame([(5.0, 10.0), (5.0, 0.0)], "u double, t double")
    assert [r[0] for r in mem.select(status.memory_pct(F.col("u"), F.col("t"))).collect()] == [50.0, 0.0]


def test_replica_listing_skips_blank_nodes_and_keeps_order(spark, as_rows):
    listed = replicas(spark, ("b", "x", "RUNNING"), ("a", "x", ""), ("c", " ", "RUNNING"), ("d", "x", "FAILED"))
    got = as_rows(fleet.replica_states_by_ip(listed, SCOPE), "position", "replica_id", "listed_state")
    assert got == [(1, "b", "RUNNING"), (2, "a", None), (3, "d", "FAILED")]
    flat = spark.createDataFrame([(1, "x", "RUNNING"), (1, "y", "RUNNING"), (2, "x", "RUNNING"), (2, "x", "RUNNING")],
                                 "cluster_id int, node_ip string, state string")
    assert as_rows(fleet.replica_spread(flat, SCOPE), "cluster_id", "spread") == [(1, True), (2, False)]


def test_configuration_without_a_cluster_is_refused(spark):
    expected = spark.createDataFrame([("a", "10.0.0.1")], "name string, expected_ip string")
    with pytest.raises(ValueError):
        fleet.expected_node_checks(expected, nodes(spark), SCOPE)


def test_snapshot_history_is_checked_snapshot_by_snapshot(spark, as_rows):
    seen = nodes(spark, (0, "r1", "10.0.0.1", "one", "ALIVE", False, GPU)).withColumn("snapshot_ts", F.lit(1))
    gone = nodes(spark, (0, "r1", "10.0.0.1", "one", "DEAD", False, GPU)).withColumn("snapshot_ts", F.lit(2))
    other = nodes(spark, (0, "r2", "10.0.0.2", "two", "ALIVE", False, GPU)).withColumn("snapshot_ts", F.lit(3))
    expected = spark.createDataFrame([(0, "a", "10.0.0.1")], "cluster_id int, name string, expected_ip string")
    history = seen.unionByName(gone).unionByName(other)
    got = as_rows(fleet.expected_node_checks(expected, history), "snapshot_ts", "passed", "detail")
    assert got == [(1, True, "ALIVE"), (2, False, "joined but state=DEAD"), (3, False, "not joined to Ray cluster")]
    view = fleet.nodes_view(
        history,
        replicas(spark, ("x", "10.0.0.1", "RUNNING")).withColumn("snapshot_ts", F.lit(1)),
        router(spark, ("n", "10.0.0.2", "reserve", False, None, 0, 0, True)).withColumn("snapshot_ts", F.lit(3)),
    )
    assert as_rows(view, "snapshot_ts", "status", "role") == [(1, "LIVE", "unmanaged"), (3, "FAILED", "standby")]


def test_scopes_that_report_nothing_fail(spark):
    scopes = spark.createDataFrame([(1, 0), (2, 0)], "cluster_id long, snapshot_ts int")
    nodes = spark.createDataFrame(
        [(1, 0, 0, "10.0.0.1", "ALIVE", True, {"CPU": 1.0})],
        "cluster_id long, snapshot_ts int, ordinal int, node_ip string, state string, is_head_node boolean, resources map<string,double>",
    )
    config = spark.createDataFrame([(1, "10.0.0.1"), (2, "10.0.0.1")], "cluster_id long, expected_head_ip string")
    heads = {r.cluster_id: r for r in fleet.head_check(config, nodes, scopes=scopes).collect()}
    assert heads[1].passed and not heads[2].passed and heads[2].detail == fleet.NO_HEAD
    expected = spark.createDataFrame([(1, "a", "10.0.0.1"), (2, "a", "10.0.0.1")], "cluster_id long, name string, expected_ip string")
    checks = {r.cluster_id: r.passed for r in fleet.expected_node_checks(expected, nodes, scopes=scopes).collect()}
    assert checks == {1: True, 2: False}
    replicas = spark.createDataFrame(
        [(1, 0, 0, "r", "10.0.0.1", "RUNNING")],
        "cluster_id long, snapshot_ts int, ordinal int, replica_id string, node_ip string, state string",
    )
    wanted = expected.select("cluster_id", F.col("expected_ip").alias("node_ip"))
    covered = {r.cluster_id: (r.missing, r.covered) for r in fleet.expected_covered(wanted, replicas, scopes=scopes).collect()}
    assert covered == {1: (0, True), 2: (1, False)}
    spread = {r.cluster_id: (r.running, r.spread) for r in fleet.replica_spread(replicas, scopes=scopes).collect()}
    assert spread == {1: (1, False), 2: (0, False)}
    statuses = spark.createDataFrame([(1, 0, "gateway", "RUNNING")], "cluster_id long, snapshot_ts int, app string, status string")
    health = {r.cluster_id: r.health for r in fleet.health_rollup(statuses, ["gateway"], scopes=scopes).collect()}
    assert health == {1: "HEALTHY", 2: "pending"}
    required = spark.createDataFrame([(1, "k"), (2, "k")], "cluster_id long, key string")
    usage = spark.createDataFrame([(1, 0, "k")], "cluster_id long, snapshot_ts int, key string")
    assert [r.cluster_id for r in fleet.missing_nodes(required, usage, scopes=scopes).collect()] == [2]


def test_scopes_without_nodes_are_there(spark):
    """A cluster that reports nothing keeps its configured names, offline."""
    registry = spark.createDataFrame([(0, "a", "10.0.0.1", ""), (1, "b", "10.0.0.2", "")], "cluster_id int, name string, expected_ip string, infer_url string")
    nodes = spark.createDataFrame(
        [(0, "n", "10.0.0.1", "n", "ALIVE", False, {"GPU": 1.0}, 0)],
        "cluster_id int, node_id string, node_ip string, node_name string, state string, is_head_node boolean, resources map<string,double>, ordinal long",
    )
    replicas = spark.createDataFrame([], "cluster_id int, replica_id string, node_ip string, state string, ordinal long")
    router = spark.createDataFrame([(0, "a", True)], "cluster_id int, name string, readiness_ok boolean")
    every = {(r.cluster_id, r.name, r.joined, r.lifecycle) for r in fleet.lifecycle_by_name(registry, nodes, replicas, router, scope=("cluster_id",)).collect()}
    assert every == {(0, "a", True, "IDLE"), (1, "b", False, "OFFLINE")}
    history = nodes.withColumn("snapshot_ts", F.lit(7))
    late = router.withColumn("snapshot_ts", F.lit(7))
    scopes = spark.createDataFrame([(0, 7), (1, 7), (1, 8)], "cluster_id int, snapshot_ts int")
    named = fleet.lifecycle_by_name(registry, history, replicas.withColumn("snapshot_ts", F.lit(7)), late, scope=("cluster_id", "snapshot_ts"), scopes=scopes)
    assert {(r.cluster_id, r.snapshot_ts, r.name, r.joined) for r in named.collect()} == {(0, 7, "a", True), (1, 7, "b", False), (1, 8, "b", False)}


CUSTOMER = "c_custkey long, c_name string, c_nationkey int, c_mktsegment string, c_acctbal double"


@pytest.fixture
def sixth_cluster(spark, tmp_path):
    """One customer, the node at 10.0.1.1 of cluster 5."""
    spark.createDataFrame([(126, "c", 0, "BUILDING", 1.0)], CUSTOMER).write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(12, 126, "O")], "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(str(tmp_path / "orders.parquet"))
    return str(tmp_path)


def test_nodes_of_every_cluster_are_checked(spark, sixth_cluster):
    import __spark_entry__ as entry

    checks = entry.queries()["expected_node_checks"](spark, sixth_cluster).collect()
    assert [(r.cluster_id, r.expected, r.passed, r.detail) for r in checks] == [(5, "10.0.1.1", True, "ALIVE")]


def test_replicas_of_every_cluster_cover(spark, sixth_cluster):
    import __spark_entry__ as entry

    covered = entry.queries()["expected_covered"](spark, sixth_cluster).collect()
    assert [(r.cluster_id, r.missing, r.covered) for r in covered] == [(5, 0, True)]
