import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.operators import slo
from fleetlens.operators.quantiles import exact_quantiles


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def test_availability_of_999_good_and_one_bad(spark):
    df = spark.createDataFrame([(200,)] * 999 + [(500,)], "status int")
    assert slo.sli_availability(df).first()[0] == pytest.approx(99.9)


def test_availability_of_nothing_is_zero(spark):
    assert slo.sli_availability(spark.createDataFrame([], "status int")).first()[0] == 0.0


def test_p95_of_one_to_hundred(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 101)], "latency_ms double")
    assert slo.sli_p95_latency(df).first()[0] == pytest.approx(95.05)


def test_p95_of_nothing_is_zero(spark):
    assert slo.sli_p95_latency(spark.createDataFrame([], "latency_ms double")).first()[0] == 0.0


@pytest.mark.parametrize("other", ["FAILED", "CANCELLED", "failed"])
def test_batch_reliability(spark, other):
    df = spark.createDataFrame([("completed",)] * 199 + [(other,)], "status string")
    assert slo.sli_batch_reliability(df).first()[0] == pytest.approx(99.5)


def test_nodes_without_samples_get_zero_quantiles(spark):
    samples = spark.createDataFrame([(0, "a", 5.0)], "cluster_id int, node string, latency_ms double")
    nodes = spark.createDataFrame([(0, "a"), (0, "b")], "cluster_id int, node string")
    got = {r["node"]: r["latency_p95_ms"] for r in slo.latency_quantiles(samples, nodes=nodes).collect()}
    assert got == {"a": 5.0, "b": 0.0}


def test_sla_flag_edges(spark):
    df = spark.createDataFrame([(10.0,), (20.0,), (None,)], "latency_p95_ms double")
    flags = [r["sla_ok"] for r in slo.with_sla_flag(df, 10.0).collect()]
    assert flags == [True, False, True]
    assert all(r["sla_ok"] for r in slo.with_sla_flag(df, 0).collect())


@pytest.mark.parametrize("seed", range(4))
def test_exact_quantiles_match_numpy_on_awkward_values(spark, seed):
    rng = np.random.default_rng(seed)
    groups = {
        "wide": rng.lognormal(0, 8, 700),
        "signed": rng.normal(0, 1, 701),
        "narrow": 1e9 + rng.random(702) * 1e-3,
        "ties": rng.integers(0, 3, 703).astype(float),
        "tiny": rng.random(704) * 1e-12,
        "single": np.array([42.0]),
        "hot": rng.random(4000) * 100,
        None: np.array([1.0, 2.0]),
        "infinite": np.array([-np.inf, 0.0, 1.0, np.inf]),
    }
    data = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("ties", None), ("void", None)]
    probs = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    df = spark.createDataFrame(data, "g string, v double")
    got = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", probs, count="n").collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert got[k]["n"] == len(vs)
        for name, p in probs.items():
            if k == "infinite" and 0 < p < 1:
                continue
            if k == "infinite":
                assert got[k][name] == pytest.approx(np.quantile(vs, p)) or np.isnan(got[k][name])
            else:
                assert got[k][name] == pytest.approx(np.quantile(vs, p), rel=1e-12, abs=1e-300)


def test_alarm_rules_and_sides(spark):
    data = [
        (0, at(0), "availability", 1.0), (0, at(10), "availability", 0.0),
        (0, at(400), "availability", 1.0),
        (0, at(0), "latency_ms", 4500.0), (0, at(301), "latency_ms", 4501.0),
        (0, at(0), "failover_rto_seconds", 31.0), (0, at(5), "unknown", 1.0),
    ]
    df = spark.createDataFrame(data, "cluster_id int, ts timestamp, metric string, value double")
    got = {(r["alarm"], r["window_start"]): r["breach"] for r in slo.alarm_eval(df).collect()}
    assert got == {
        ("GatewayAvailabilityLow", at(0)): True,
        ("GatewayAvailabilityLow", at(300)): False,
        ("GatewayLatencyHigh", at(0)): False,
        ("GatewayLatencyHigh", at(300)): True,
        ("FailoverRTOHigh", at(0)): True,
    }


def test_daily_quota_default_limit(spark):
    df = spark.range(10003).select(F.lit(1).alias("api_key_id"), F.lit(at(5)).alias("ts"))
    row = slo.daily_quota(df).first()
    assert (row["requests"], row["over_quota"]) == (10003, 3)


def test_status_histogram_expectation(spark):
    df = spark.createDataFrame([(200,), (200,), (429,)], "status int")
    got = {r["status"]: (r["requests"], r["as_expected"]) for r in slo.status_histogram(df, expected_ok=2).collect()}
    assert got == {200: (2, True), 429: (1, None)}


def test_rate_pressure_keeps_the_entry_exactly_a_window_old(spark):
    data = [(0, i, at(s)) for i, s in enumerate([0, 10, 10.000001, 39, 41, 49])]
    df = spark.createDataFrame(data, "cluster_id int, request_id int, ts timestamp")
    got = {r["request_id"]: r["in_window"] for r in slo.rate_limit_pressure(df).collect()}
    assert got == {0: 1, 1: 2, 2: 2, 3: 1, 4: 2, 5: 3}


def test_quantiles_of_all_requests_and_of_the_served_ones(spark, as_rows):
    rows = [("a", 10.0, 200), ("a", 30.0, 500), ("b", 7.0, 429), ("c", None, 200), (None, 1.0, 201), (None, 3.0, None)]
    requests = spark.createDataFrame(rows, "node string, latency_ms double, status int")
    got = as_rows(slo.request_quantiles(requests, ["node"]), "node", "latency_p50_ms", "served_latency_p50_ms")
    assert got == sorted([("a", 20.0, 10.0), ("b", 7.0, 0.0), ("c", None, 0.0), (None, 2.0, 1.0)], key=repr)


def test_latency_queries_judge_failed_requests_too(spark, tmp_path):
    import __spark_entry__ as entry

    event = [(1, at(0), 5, "view", 100.0, '{"k": 1}'), (2, at(1), 5, "error", 900.0, '{"k": 1}'), (3, at(2), 6, "error", 500.0, '{"k": 2}')]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(event, schema).write.parquet(str(tmp_path / "events.parquet"))
    quantiles = entry.queries()["latency_quantiles"](spark, str(tmp_path)).collect()
    assert {r["node"]: (r["latency_p50_ms"], r["served_latency_p50_ms"]) for r in quantiles} == {1: (500.0, 100.0), 2: (500.0, 0.0)}
    flags = {r["api_key_id"]: (r["sla_ok"], r["served_sla_ok"]) for r in entry.queries()["sla_flag"](spark, str(tmp_path)).collect()}
    assert flags == {5: (False, True), 6: (False, True)}
