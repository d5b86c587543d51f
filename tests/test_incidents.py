import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import incidents as inc

PROBES = "cluster_id int, node string, seq int, ts timestamp, healthy boolean"


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def probes(spark, pattern, step=5, node="a"):
    return spark.createDataFrame([(0, node, i, at(i * step), c == "T") for i, c in enumerate(pattern)], PROBES)


def outages_of(pattern, threshold):
    run, out = 0, []
    for i, c in enumerate(pattern):
        run = 0 if c == "T" else run + 1
        if run == threshold:
            out.append(i)
    return out


def downtimes_of(pattern, threshold):
    run, since, out = 0, None, []
    for i, c in enumerate(pattern):
        if c == "T":
            if since is not None:
                out.append((since, i))
            run, since = 0, None
        else:
            run += 1
            since = i if run == threshold else since
    return out


def test_three_failures_then_recovery(spark):
    df = probes(spark, "FFFT")
    assert [r["seq"] for r in inc.probe_outages(df).collect()] == [2]
    row = inc.downtime(df).first()
    assert (row["outage_ts"], row["recovered_ts"], row["downtime_s"]) == (at(10), at(15), 5.0)
    assert inc.respawn_counts(inc.downtime(df)).first()["respawns"] == 1


def test_six_failures_are_one_outage(spark):
    assert inc.probe_outages(probes(spark, "FFFFFF")).count() == 1


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("chunk_s", [5, 20, 100000])
def test_runs_across_chunks_match_a_plain_loop(spark, seed, chunk_s):
    rng = random.Random(seed)
    patterns = {n: "".join(rng.choice("FFFT") for _ in range(120)) for n in "ab"}
    patterns["hot"] = "F" * 50 + "T" + "F" * 200 + "TT" + "F" * 2 + "T" * 60
    patterns["down"] = "F" * 90
    df = None
    for node, pattern in patterns.items():
        part = probes(spark, pattern, node=node)
        df = part if df is None else df.unionByName(part)
    for threshold in (1, 2, 3, 7):
        got = sorted((r["node"], r["seq"]) for r in inc.probe_outages(df, threshold=threshold, chunk_s=chunk_s).collect())
        assert got == sorted((n, i) for n, p in patterns.items() for i in outages_of(p, threshold))
        got = sorted((r["node"], r["outage_ts"], r["recovered_ts"]) for r in inc.downtime(df, threshold=threshold, chunk_s=chunk_s).collect())
        want = sorted((n, at(5 * a), at(5 * b)) for n, p in patterns.items() for a, b in downtimes_of(p, threshold))
        assert got == want


@pytest.mark.parametrize("chunk_s", [7, 60, 100000])
def test_alert_hold_matches_a_plain_loop(spark, chunk_s):
    """A run fires at its start plus the hold unless another status comes before; the last run of a node does."""
    rng = random.Random(chunk_s)
    data, want = [], []
    for node in "abc":
        since = None
        for i in range(150):
            value = rng.choice([0.0, 0.0, 0.0, 0.0, 1.0])
            data.append((0, node, i, at(i * 7), value))
            if value and since is not None and (i - since) * 7 >= 30:
                want.append((node, at(since * 7), at(since * 7 + 30)))
            since = None if value else i if since is None else since
        if since is not None:
            want.append((node, at(since * 7), at(since * 7 + 30)))
    data.append((0, "a", 999, at(20), None))
    df = spark.createDataFrame(data, "cluster_id int, node string, seq int, ts timestamp, value double")
    got = sorted((r["node"], r["zero_since"], r["firing_ts"]) for r in inc.alert_hold(df, chunk_s=chunk_s).collect())
    assert got == sorted(want)
    seen = [r["firing_ts"] for r in inc.alert_hold(df, chunk_s=chunk_s, until=at(500)).collect()]
    assert sorted(seen) == sorted(w[2] for w in want if w[2] <= at(500))


def test_rto_uses_the_latest_failover_once(spark):
    data = [
        (0, 1, at(0), "RETRY", "x"), (0, 2, at(10), "FAILOVER", "a"), (0, 3, at(20), "FAILOVER", "b"),
        (0, 4, at(26), "RETRY", "c"), (0, 5, at(40), "RETRY", "c"), (1, 6, at(41), "FAILOVER", "z"),
        (0, 7, at(1000), "FAILOVER", "d"), (0, 8, at(2000.5), "RETRY", "e"),
    ]
    df = spark.createDataFrame(data, "cluster_id int, seq int, ts timestamp, event string, node string")
    got = sorted((r["failed_node"], r["node"], r["elapsed_seconds"]) for r in inc.failover_rto(df).collect())
    assert got == [("b", "c", 6.0), ("d", "e", 1000.5)]


def test_failovers_without_routing_impact_do_not_count(spark):
    data = [(0, 1, at(0), "FAILOVER", "a", False), (0, 2, at(5), "RETRY", "b", None)]
    df = spark.createDataFrame(data, "cluster_id int, seq int, ts timestamp, event string, node string, routing_impact boolean")
    assert inc.failover_rto(df).count() == 0


def recovery(spark, states, polls=None, **kw):
    schema = "cluster_id int, node string, ts timestamp, state string"
    samples = spark.createDataFrame([(0, "a", at(s), x) for s, x in states], schema)
    targets = spark.createDataFrame([(0, "a", at(0))], "cluster_id int, node string, t0 timestamp")
    ticks = None
    if polls:
        ticks = spark.createDataFrame([(0, at(s)) for s in polls], "cluster_id int, ts timestamp")
    got = inc.recovery_phases(samples, targets, polls=ticks, **kw).collect()
    return {r["phase"]: (r["passed"], r["at"]) for r in got}


def test_recovery_alive_missing_alive_passes(spark):
    got = recovery(spark, [(0, "ALIVE"), (10, "ALIVE")], polls=[0, 5, 10])
    assert got == {"outage-detected": (True, at(5)), "rejoin-confirmed": (True, at(10))}


def test_recovery_never_missing_times_out(spark):
    got = recovery(spark, [(s, "ALIVE") for s in range(0, 1500, 100)])
    assert got["outage-detected"] == (False, None)
    assert got["rejoin-confirmed"] == (True, at(700))


def test_recovery_never_back_fails_rejoin(spark):
    base = spark.createDataFrame([(0, True)], "cluster_id int, passed boolean")
    got = recovery(spark, [(0, "DEAD"), (2000, "ALIVE")], baseline=base)
    assert got["baseline-visibility"][0] and got["outage-detected"] == (True, at(0))
    assert got["rejoin-confirmed"] == (False, None)


def test_phase_rollup_of_nothing_passes(spark):
    phases = spark.createDataFrame([(1, True), (1, False), (2, True)], "k int, passed boolean")
    scopes = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    got = {r["k"]: r["passed"] for r in inc.phase_rollup(phases, ["k"], scopes).collect()}
    assert got == {1: False, 2: True, 3: True}


@pytest.mark.parametrize("chunk_s", [20, 100000])
def test_failovers_by_probes_and_requests_match_a_plain_loop(spark, chunk_s):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        kind = rng.choices(["ok", "bad", "request"], [5, 5, 1])[0]
        rows.append((rng.randrange(2), rng.randrange(5), at(i * 3 // 2), i, kind))
    priority = {0: 2, 1: 0, 2: 1, 3: 4, 4: 1}
    failures, down, want = {}, {}, {}
    for c, n, ts, seq, kind in rows:
        if kind == "ok":
            failures[c, n] = 0
            if (c, n) in down:
                want[down.pop((c, n))][1] = ts
            continue
        failures[c, n] = failures.get((c, n), 0) + (kind == "bad")
        if (c, n) in down or (kind == "bad" and failures[c, n] < 3):
            continue
        up = sorted((priority[m], m) for m in priority if (c, m) not in down)
        want[c, n, ts, seq] = ["request" if kind == "request" else "probe", None, (priority[n], n) in up[:2]]
        down[c, n] = (c, n, ts, seq)
    df = spark.createDataFrame(rows, "cluster_id int, node int, ts timestamp, seq bigint, kind string").repartition(3)
    nodes = spark.createDataFrame([(c, n, p) for c in range(2) for n, p in priority.items()], "cluster_id int, node int, priority int")
    probes = df.where("kind <> 'request'").withColumn("healthy", F.col("kind") == "ok")
    got = inc.node_failovers(probes, df.where("kind = 'request'"), nodes, primary_count=2, chunk_s=chunk_s).collect()
    assert {(r.cluster_id, r.node, r.failover_ts, r.seq): [r.cause, r.recovered_ts, r.routing_impact] for r in got} == want
    assert {v[0] for v in want.values()} == {"probe", "request"} and {v[2] for v in want.values()} == {True, False}
    events = inc.node_failovers(probes, df.where("kind = 'request'"), nodes.limit(0)).limit(1).collect()
    assert events[0].routing_impact is None


def test_failovers_among_many_nodes_change_few_blocks(spark):
    """Rows grow with the logarithm of the nodes, and the primaries are right wherever a node ranks."""
    rng = random.Random(6)
    n = 70
    nodes = spark.createDataFrame([(0, i, i // 2) for i in range(n)], "cluster_id int, node int, priority int")
    rows, down, want = [], set(), {}
    for i in range(700):
        node, ok = rng.randrange(n), rng.random() < 0.5
        rows.append((0, node, at(i), i, ok))
        if ok:
            down.discard(node)
        elif node not in down:
            want[i] = sum(m not in down for m in range(node)) < 20
            down.add(node)
    df = spark.createDataFrame(rows, "cluster_id int, node int, ts timestamp, seq bigint, healthy boolean")
    got = inc.node_failovers(df.where("healthy"), df.where("not healthy").drop("healthy"), nodes, primary_count=20, chunk_s=50)
    assert {r.seq: r.routing_impact for r in got.collect()} == want and len(set(want.values())) == 2
    moment = F.struct("ts", "seq", F.lit("request").alias("cause"))
    found = df.where("seq < 50").withColumn("__up", F.col("seq")).withColumn("down", moment).withColumn("back", moment)
    made = inc._by_blocks(found.drop("ts", "seq", "healthy").join(inc._ranks(nodes, ["cluster_id"]), ["cluster_id", "node"]), 20)
    assert made.count() <= 50 * 3 * 7
