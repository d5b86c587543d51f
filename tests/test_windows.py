import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.operators import rolling
from fleetlens.operators.admission import rate_limit_labels
from fleetlens.operators.batch import attempt_number
from fleetlens.operators.logs import log_tail, needle_count
from fleetlens.operators.scan import by_number, int_chunk, row_index, time_chunk

SAMPLES = "cluster_id int, node string, seq int, ts timestamp, latency_ms double"


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


@pytest.mark.parametrize("size, block", [(1, 4), (5, 8), (64, 16), (1024, 16384)])
def test_rolling_quantiles_match_numpy(spark, size, block):
    rng = np.random.default_rng(size)
    values = {"a": rng.integers(0, 9, 230).astype(float), "b": rng.random(41), "one": np.array([3.0])}
    data = [(0, n, i, at(i // 3), float(v)) for n, vs in values.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(data, SAMPLES)
    got = {(r["node"], r["seq"]): r for r in rolling.rolling_quantiles(df, size=size, block=block, chunk_s=10).collect()}
    assert len(got) == len(data)
    for node, vs in values.items():
        for i in range(len(vs)):
            frame = vs[max(0, i - size + 1) : i + 1]
            row = got[node, i]
            want = np.quantile(frame, [0.5, 0.95, 0.99])
            assert [row["p50"], row["p95"], row["p99"]] == pytest.approx(list(want))


@pytest.mark.parametrize("chunk_s", [3, 50, 100000])
def test_counter_rate_with_resets_and_gaps(spark, chunk_s):
    rng = random.Random(chunk_s)
    data, t, value = [], 0, 0
    for i in range(200):
        t += rng.choice([1, 5, 20, 70])
        value = rng.randrange(3) if rng.random() < 0.1 else value + rng.randrange(5)
        data.append((0, "a", i, at(t), float(value)))
    df = spark.createDataFrame(data, "cluster_id int, node string, seq int, ts timestamp, value double")
    got = {r["seq"]: r["per_second"] for r in rolling.counter_rate(df, chunk_s=chunk_s).collect()}
    for i, (_, _, _, ts, _) in enumerate(data):
        inside = [j for j in range(i + 1) if (ts - data[j][3]).total_seconds() <= 60]
        if len(inside) < 2:
            assert got[i] is None
            continue
        grown = 0.0
        for j in inside[1:]:
            step = data[j][4] - data[j - 1][4]
            grown += data[j][4] if step < 0 else step
        assert got[i] == pytest.approx(grown / 60)


@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_row_index_is_the_position_even_for_null_keys(spark, chunk):
    data = [(k, i) for k, n in (("a", 50), ("b", 1), (None, 20)) for i in range(-n // 2, n - n // 2)]
    random.Random(1).shuffle(data)
    df = spark.createDataFrame(data, "k string, i int")
    got = {(r["k"], r["i"]): r["n"] for r in row_index(df, ["k"], [F.col("i")], by_number(F.col("i"), chunk), "n").collect()}
    assert len(got) == len(data)
    for k in ("a", "b", None):
        mine = sorted(i for kk, i in data if kk == k)
        assert [got[k, i] for i in mine] == list(range(1, len(mine) + 1))


def test_chunks_are_exact_for_large_and_negative_numbers(spark):
    df = spark.createDataFrame([(2**62 + 1,), (-1,), (-256,), (0,), (255,), (256,)], "v long")
    got = [r[0] for r in df.select(int_chunk(F.col("v"), 256)).collect()]
    assert got == [(2**62 + 1) // 256, -1, -1, 0, 0, 1]
    times = spark.createDataFrame([(at(-1),), (at(0),), (at(299.999999),), (at(300),)], "t timestamp")
    slices = [r[0] for r in times.select(time_chunk(F.col("t"), 300)).collect()]
    assert [s - slices[1] for s in slices] == [-1, 0, 0, 1]


def test_attempts_count_dispatches_only(spark, as_rows):
    data = [(1, 1, "route"), (1, 2, "failure"), (1, 3, "route"), (2, 4, "route"), (1, 70000, "route")]
    df = spark.createDataFrame(data, "job_id int, seq int, kind string")
    assert as_rows(attempt_number(df), "job_id", "seq", "attempt") == [(1, 1, 1), (1, 3, 2), (1, 70000, 3), (2, 4, 1)]


def plain_admission(times, limit, window):
    kept, out = [], []
    for t in times:
        kept = [k for k in kept if k >= t - window]
        out.append(len(kept) < limit)
        if out[-1]:
            kept.append(t)
    return out


@pytest.mark.parametrize("limit, window", [(15, 10), (2, 10), (1, 1)])
def test_admission_matches_a_plain_loop(spark, limit, window):
    rng = random.Random(limit)
    want, data, n = {}, [], 0
    for key in range(4):
        t, times = 0, []
        for _ in range(150):
            t += rng.choice([0, 1, 1, 2, 11, 40]) if key else rng.choice([0, 1])
            times.append(t)
        for t, ok in zip(times, plain_admission(times, limit, window)):
            data.append((key, n, at(t)))
            want[n] = ok
            n += 1
    df = spark.createDataFrame(data, "api_key_id bigint, request_id bigint, ts timestamp")
    got = {r["request_id"]: r["accepted"] for r in rate_limit_labels(df, limit=limit, window_s=window, chunk_s=9).collect()}
    assert got == want


@pytest.mark.parametrize("lines, chunk", [(1, 2), (5, 2), (9, 1), (1000, 4096)])
def test_log_tail_over_pieces(spark, lines, chunk):
    texts = ["a\nb\nc\n", "d", "", "e\n\nf"]
    data = [(0, r, i, t) for r in ("x", "y") for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, "cluster_id int, replica_id string, seq int, raw string")
    got = log_tail(df, lines=lines, chunk=chunk).where("replica_id = 'x'").collect()
    ordered = [r["line"] for r in sorted(got, key=lambda r: -r["from_end"])]
    assert ordered == ["a", "b", "c", "d", "", "e", "", "f"][-lines:]


def test_needles_do_not_overlap(spark):
    data = [(0, "r", "aaaa aa.a"), (0, "r", None), (0, "s", "")]
    df = spark.createDataFrame(data, "cluster_id int, replica_id string, raw string")
    assert {r["replica_id"]: r["hits"] for r in needle_count(df, "aa").collect()} == {"r": 3, "s": 0}
    assert {r["replica_id"]: r["hits"] for r in needle_count(df, "a.a").collect()} == {"r": 1, "s": 0}


def test_bursts_are_cut_and_results_stay_the_same(spark, monkeypatch):
    """Many rows of one key in one slice: chunks are cut into parts, in order."""
    from fleetlens.operators import incidents as inc
    from fleetlens.operators import scan, slo

    rng = random.Random(17)
    data = [(0, "hot", i, at(100 + i * 0.01), rng.random() < 0.3) for i in range(3000)]
    data += [(0, "cold", 3000 + i, at(i * 50), rng.random() < 0.3) for i in range(200)]
    df = spark.createDataFrame(data, "cluster_id int, node string, seq int, ts timestamp, healthy boolean")
    event = F.when(F.col("healthy"), "RETRY").otherwise("FAILOVER")
    ops = df.select("cluster_id", "node", "seq", "ts", event.alias("event"))
    calls = df.select("cluster_id", F.col("seq").alias("request_id"), "ts")

    def results():
        slices = scan.by_time(F.col("ts"), split=True)
        numbered = row_index(df, ["node"], [F.col("ts"), F.col("seq")], slices, "n")
        return [
            sorted(tuple(r) for r in frame.collect())
            for frame in (inc.failover_rto(ops), numbered, slo.rate_limit_pressure(calls))
        ]

    whole = results()
    monkeypatch.setattr(scan, "SPLIT_ROWS", 50)
    parts = scan.cut(scan.pack(df, ["node"]), scan.by_time(F.col("ts"), split=True)).groupBy(scan.CHUNK, scan.PART, scan.KEY).count()
    assert parts.agg(F.max("count")).first()[0] < 700
    assert parts.where(f"{scan.KEY}.node = 'hot'").count() > 5
    assert results() == whole


@pytest.mark.parametrize("size", [1, 2, 7, 1024])
def test_window_quantiles_sort_every_window(size):
    rng = np.random.default_rng(size)
    for n in (0, 1, 2, 3, 40, 300):
        values = rng.choice([rng.random(n) * 100, rng.integers(0, 4, n).astype(float), -np.arange(n, dtype=float)])
        got = rolling.window_quantiles(values, size)
        want = [[np.quantile(values[max(0, i + 1 - size) : i + 1], p) for p in rolling.PROBS] for i in range(n)]
        assert np.allclose(got, np.array(want).reshape(-1, 3))


def test_rolling_quantiles_skip_values_that_are_none(spark):
    data = [(0, 1, at(i), i, v) for i, v in enumerate([5.0, float("nan"), None, 7.0, float("inf")])]
    df = spark.createDataFrame(data, "cluster_id int, node int, ts timestamp, seq int, latency_ms double")
    got = {r.seq: r.p50 for r in rolling.rolling_quantiles(df, size=2).collect()}
    assert got == {0: 5.0, 3: 6.0, 4: float("inf")}


def test_counter_rate_is_one_shuffle_without_drift(spark):
    """A long history of increases that doubles cannot hold exactly: the last rates are as exact as the first."""
    df = spark.range(200_000).select(
        F.lit(0).alias("cluster_id"), F.lit(1).alias("node"), F.col("id").alias("seq"), F.timestamp_millis(F.col("id") * 500).alias("ts"),
        (F.col("id") * 0.1 + 1e9).alias("value"),
    )
    rated = rolling.counter_rate(df, range_s=10.0)
    assert rated._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    worst = rated.where("seq >= 20").agg(F.max(F.abs(F.col("per_second") - 0.2))).first()[0]
    assert worst < 1e-6


def test_counter_rate_without_time_or_value(spark):
    data = [(0, 1, 0, at(0), 1.0), (0, 1, 1, None, 5.0), (0, 1, 2, at(10), None), (0, 1, 3, at(20), 7.0), (None, None, 4, at(20), 7.0)]
    df = spark.createDataFrame(data, "cluster_id int, node int, seq int, ts timestamp, value double")
    assert {r.seq: r.per_second for r in rolling.counter_rate(df).collect()} == {0: None, 3: pytest.approx(0.1), 4: None}
    assert rolling.counter_rate(df.limit(0)).collect() == []
