"""Streams run over several micro-batches, in and out of order, compared with the batch operators."""

import datetime as dt
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import incidents as inc
from fleetlens.operators import slo
from fleetlens.operators.admission import rate_limit_labels
from fleetlens.operators.batch import latest_job_state
from fleetlens.operators.transcripts import sse_transcripts
from fleetlens.streaming import queries as sq
from fleetlens.streaming.run import _append, parquet_stream, run_available, run_to_end


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


LATE_S = 590  # within the streams' lateness of ten minutes


def files(spark, path, data, schema, parts=4, ts=None, seed=0):
    """Rows written as consecutive files, each a micro-batch of its own; with ``ts`` (their time's place) out of order."""
    if ts is not None:
        rng = random.Random(seed)
        data = sorted(data, key=lambda d: d[ts] + dt.timedelta(seconds=rng.random() * LATE_S))
    size = -(-len(data) // parts)
    for p in range(parts):
        rows = data[p * size : (p + 1) * size]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    return parquet_stream(spark, path, files_per_trigger=1), spark.read.parquet(path)


def state_rows(spark, checkpoint):
    names = ("waiting", "machine", "clock")
    read = spark.read.format("statestore").option("path", checkpoint)
    timers = spark.read.format("statestore").option("path", checkpoint).option("readRegisteredTimers", True)
    return [read.option("stateVarName", n).load().count() for n in names] + [timers.load().count()]


PROBES = "cluster_id int, node int, ts timestamp, seq bigint, healthy boolean"


@pytest.fixture(params=["in order", "shuffled"])
def shuffled(request):
    return request.param == "shuffled"


def test_outages_and_recoveries(spark, tmp_path, shuffled, as_rows):
    rng = random.Random(3)
    data = [(i % 2, rng.randrange(3), at(i * 8), i, rng.random() < 0.4) for i in range(360)]
    stream, table = files(spark, str(tmp_path / "p"), data, PROBES, ts=2 if shuffled else None)
    checkpoint = str(tmp_path / "checkpoint")
    got = run_to_end(stream, sq.stream_outages, "t", checkpoint)
    want = inc.probe_outages(table).select("cluster_id", "node", F.lit("FAILOVER").alias("event"), F.col("outage_ts").alias("ts"), F.lit(None).cast("double").alias("d"))
    back = inc.downtime(table).select("cluster_id", "node", F.lit("RESPAWN"), "recovered_ts", "downtime_s")
    assert got.where("late").isEmpty()
    assert as_rows(got.where("event <> 'SILENT'"), "cluster_id", "node", "event", "ts", "downtime_s") == as_rows(want.union(back))
    assert got.count() > 10
    # Nothing is left of any key, and outages still open at the end have a last event.
    assert state_rows(spark, checkpoint) == [0, 0, 0, 0]
    assert got.where("event = 'SILENT'").count() == want.count() - back.count()


def test_rows_behind_the_watermark_are_flagged(spark, tmp_path, as_rows):
    """The third file brings two rows from before the lateness: they change nothing and come out flagged."""
    healthy = lambda i: i % 50 != 0
    data = [(0, 1, at(i * 30), i, i % 9 < 5) for i in range(90)]
    late = [(0, 1, at(61), 900, False), (0, 2, at(62), 901, healthy(50))]
    data = data[:60] + late + data[60:]
    stream, _ = files(spark, str(tmp_path / "p"), data, PROBES, 4)
    got = run_to_end(stream, sq.stream_outages, "t")
    assert sorted((r.node, r.ts, r.seq, r.event) for r in got.where("late").collect()) == [(1, at(61), 900, None), (2, at(62), 901, None)]
    table = spark.createDataFrame([d for d in data if d[3] < 900], PROBES)
    assert as_rows(got.where("event = 'FAILOVER'"), "ts", "seq") == as_rows(inc.probe_outages(table), "outage_ts", "seq")


def test_silent_keys_are_closed(spark, tmp_path):
    """Node 1 goes silent in an outage, node 2 keeps the clock going; node 1 starts anew when it is back."""
    down = [(0, 1, at(i), i, False) for i in range(4)]
    clock = [(0, 2, at(i * 200), 100 + i, True) for i in range(60)]
    back = [(0, 1, at(9000), 300, True), (0, 1, at(9001), 301, False)]
    data = sorted(down + clock + back, key=lambda d: d[2])
    stream, _ = files(spark, str(tmp_path / "p"), data, PROBES, 6)
    got = run_to_end(stream, lambda s: sq.stream_outages(s, silent_s=1000.0), "t").orderBy("ts").collect()
    assert [(r.event, r.node, r.ts, r.downtime_s) for r in got] == [("FAILOVER", 1, at(2), None), ("SILENT", 1, at(1003), 1001.0)]


def test_rows_without_a_time_are_late(spark, tmp_path):
    data = [(0, 1, at(0), 1, True), (0, 1, None, 2, False), (None, None, at(1), 3, True)]
    stream, _ = files(spark, str(tmp_path / "p"), data, PROBES, 1)
    got = run_to_end(stream, sq.stream_outages, "t").collect()
    assert [(r.seq, r.ts, r.late) for r in got] == [(2, None, True)]


def test_traffic_per_minute_to_the_last_minute(spark, tmp_path, shuffled, as_rows):
    rng = random.Random(5)
    data = [(at(i * 20), rng.choice([200, 404, 503])) for i in range(200)]
    stream, table = files(spark, str(tmp_path / "r"), data, "ts timestamp, status int", ts=0 if shuffled else None)
    cols = ("window_start", "requests", "errors_4xx", "errors_5xx")
    assert as_rows(run_to_end(stream, sq.stream_traffic, "t"), *cols) == as_rows(slo.traffic_by_minute(table), *cols)
    # Without the closing mark the minutes within the lateness stay open.
    closed = at(199 * 20) - dt.timedelta(minutes=10)
    want = slo.traffic_by_minute(table).where(F.col("window_start") + F.expr("INTERVAL 1 MINUTE") <= F.lit(closed))
    assert as_rows(run_available(sq.stream_traffic(stream), "t"), *cols) == as_rows(want, *cols)


def test_sli_flags_match_batch_alarms(spark, tmp_path, shuffled, as_rows):
    data = [(0, at(i * 30), "availability", 0.0 if i % 37 == 0 else 1.0) for i in range(200)]
    data += [(0, at(i * 50), "latency_ms", 9999.0) for i in range(100)] + [(0, at(7), None, 0.0)]
    data.sort(key=lambda d: d[1])
    stream, table = files(spark, str(tmp_path / "a"), data, "cluster_id int, ts timestamp, metric string, value double", ts=1 if shuffled else None)
    want = slo.alarm_eval(table, slo.ALARM_RULES[:1])
    cols = ("cluster_id", "alarm", "metric", "window_start", "breach", "mean")
    assert as_rows(run_to_end(stream, lambda s: sq.stream_sli(s, slo.ALARM_RULES[0]), "t"), *cols) == as_rows(want, *cols)


@pytest.mark.parametrize("parts", [1, 5])
def test_alert_hold_has_one_rule(spark, tmp_path, shuffled, as_rows, parts):
    rng = random.Random(7)
    data = [(0, rng.randrange(4), at(i * 6), i, float(rng.random() < 0.3)) for i in range(200)]
    data += [(0, 9, at(300), 900, 0.0)]
    data.sort(key=lambda d: d[2])
    schema = "cluster_id int, node int, ts timestamp, seq bigint, value double"
    stream, table = files(spark, str(tmp_path / "s"), data, schema, parts, ts=2 if shuffled else None)
    cols = ("cluster_id", "node", "zero_since", "firing_ts")
    got = as_rows(run_to_end(stream, sq.stream_alert_hold, "t"), *cols)
    assert got == as_rows(inc.alert_hold(table), *cols)
    assert (0, 9, at(300), at(330)) in got and len(got) > 5


def test_rate_limit_labels_match_the_batch_form(spark, tmp_path, shuffled, as_rows):
    rng = random.Random(9)
    data, t = [], 0.0
    for i in range(400):
        t += rng.choice([0.0, 0.2, 0.5, 3.0])
        data.append((rng.choice([1, 1, 1, 2]), i, at(t)))
    stream, table = files(spark, str(tmp_path / "q"), data, "api_key_id bigint, request_id bigint, ts timestamp", ts=2 if shuffled else None)
    checkpoint = str(tmp_path / "checkpoint")
    got = as_rows(run_to_end(stream, sq.stream_rate_limit, "t", checkpoint), "request_id", "accepted")
    assert got == as_rows(rate_limit_labels(table), "request_id", "accepted")
    assert not all(ok for _, ok in got)
    assert state_rows(spark, checkpoint) == [0, 0, 0, 0]


def test_rto_across_batches(spark, tmp_path, shuffled, as_rows):
    rng = random.Random(11)
    data = [(i % 3, at(i * 9), i, rng.choice(["FAILOVER", "RETRY", "RETRY", "RESPAWN"]), rng.randrange(4), rng.random() < 0.8) for i in range(200)]
    schema = "cluster_id int, ts timestamp, seq bigint, event string, node int, routing_impact boolean"
    stream, table = files(spark, str(tmp_path / "o"), data, schema, 5, ts=1 if shuffled else None)
    checkpoint = str(tmp_path / "checkpoint")
    cols = ("cluster_id", "ts", "node", "failed_node", "elapsed_seconds")
    got = run_to_end(stream, sq.stream_rto, "t", checkpoint)
    assert as_rows(got.where("node is not null"), *cols) == as_rows(inc.failover_rto(table), *cols)
    assert state_rows(spark, checkpoint) == [0, 0, 0, 0]


def test_sla_state_keeps_the_last_successes(spark, tmp_path, shuffled):
    data = [(0, 1, at(i * 20), i, float(i), i % 10 != 0) for i in range(100)] + [(0, 2, at(5), 900, None, True), (0, 3, at(6), 901, 7.0, False)]
    data.sort(key=lambda d: d[2])
    schema = "cluster_id int, node int, ts timestamp, seq bigint, latency_ms double, success boolean"
    stream, _ = files(spark, str(tmp_path / "l"), data, schema, ts=2 if shuffled else None)
    got = run_to_end(stream, lambda s: sq.stream_sla_state(s, target_ms=95.0, size=10), "t").orderBy("node", "seq").collect()
    last = [r for r in got if r.node == 1][-1]
    kept = [x for x in range(100) if x % 10][-10:]
    assert (last.seq, last.samples, last.sla_ok) == (99, 10, False)
    assert last.latency_p95_ms == pytest.approx(kept[8] + 0.55 * (kept[9] - kept[8]))
    assert [(r.node, r.samples, r.latency_p95_ms, r.sla_ok) for r in got if r.node != 1] == [(2, 0, 0.0, True)]


def test_job_state_versions_end_at_the_newest(spark, tmp_path, shuffled, as_rows):
    rng = random.Random(13)
    data = [(rng.randrange(6), at(i * 15), i, rng.choice(["PENDING", "RUNNING", "SUCCEEDED"])) for i in range(90)]
    stream, table = files(spark, str(tmp_path / "j"), data, "job_id bigint, ts timestamp, seq bigint, ray_status string", ts=1 if shuffled else None)
    versions = run_to_end(stream, sq.stream_job_state, "t")
    last = versions.groupBy("job_id").agg(F.max_by("status", "seq").alias("status"))
    assert as_rows(last, "job_id", "status") == as_rows(latest_job_state(table), "job_id", "status")


def test_transcripts_close_on_done_or_silence(spark, tmp_path, as_rows):
    def body(tokens, done):
        lines = ["data: " + json.dumps({"choices": [{"delta": {"content": t}}]}) + "\n\n" for t in tokens]
        return "".join(lines) + ("data: [DONE]\n\n" if done else "")

    texts = {"a": body(["x ", "y", " z"] * 9, True), "b": body(["left", " open"], False), "late": body(["pad"] * 3, True)}
    data = []
    for key, start in (("a", 0), ("b", 1), ("late", 5000)):
        text = texts[key]
        data += [(key, i, at(start + i * 0.01), text[p : p + 17]) for i, p in enumerate(range(0, len(text), 17))]
    data.sort(key=lambda d: d[2])
    stream, table = files(spark, str(tmp_path / "c"), data, "request_id string, seq bigint, ts timestamp, chunk string", 5)
    got = run_available(sq.stream_transcripts(stream), "t")
    cols = ("request_id", "text", "output_tokens", "ttft_ms", "latency_ms")
    assert as_rows(got, *cols) == as_rows(sse_transcripts(table), *cols)


def test_repeated_rows_are_dropped_within_the_watermark(spark, tmp_path):
    data = [(i // 2, at(i)) for i in range(40)]
    stream, _ = files(spark, str(tmp_path / "d"), data, "request_id bigint, ts timestamp", 2)
    assert run_available(sq.deduplicated(stream, ["request_id"]), "t").count() == 20


def test_access_log_lines_as_a_stream(spark, tmp_path, as_rows):
    from fleetlens.sources.readers import stream_access_log

    folder = tmp_path / "log"
    folder.mkdir()
    for part in range(2):
        lines = [
            json.dumps({"requestId": f"{part}-{i}", "requestTime": f"01/Jan/2024:00:{part}0:{i:02d} +0000", "status": "404", "latency": "x"})
            for i in range(5)
        ]
        (folder / f"{part}.log").write_text("\n".join(lines))
    got = run_available(stream_access_log(spark, str(folder)), "t")
    assert got.count() == 10 and got.where("status = 404 AND latency_ms IS NULL").count() == 10
    minutes = run_available(sq.stream_traffic(stream_access_log(spark, str(folder)), lateness="0 seconds"), "t")
    assert as_rows(minutes, "window_start", "requests", "errors_4xx") == [(at(0), 5, 5)]


def test_many_keys_share_the_state_of_few_shards(spark, tmp_path):
    """Calls and accesses to state grow with the shards; every row keeps its own key, a missing one too."""
    data = [(i % 3000 or None, i, at(i * 0.01)) for i in range(6000)]
    stream, _ = files(spark, str(tmp_path / "q"), data, "api_key_id bigint, request_id bigint, ts timestamp", 1)
    got = run_to_end(stream, lambda s: sq.stream_rate_limit(s, 1, 1e9), "t").collect()
    assert {(r.request_id, r.api_key_id, r.accepted) for r in got} == {(i, i % 3000 or None, i < 3000) for i in range(6000)}
    open_ = str(tmp_path / "open")
    _append(sq.stream_rate_limit(stream, 1, 1e9), str(tmp_path / "out"), open_)
    assert 0 < max(state_rows(spark, open_)) <= 1024


def test_many_responses_share_the_state_of_few_shards(spark, tmp_path):
    """Calls, timers and accesses to state grow with the shards; open responses go on in the next batch, closed ones stay closed."""
    def lines(*tokens):
        return "".join("data: " + json.dumps({"choices": [{"delta": {"content": t}}]}) + "\n\n" for t in tokens)

    n, end = 3000, "data: [DONE]\n\n"
    names = [None, *[str(i) for i in range(1, n)]]
    # Even ones end in the first batch and go on all the same; the others are cut within a line.
    first = [(names[i], 0, at(i * 0.01), lines(f"{i} a", " b") + (end if i % 2 == 0 else "data: {")) for i in range(n)]
    second = [(names[i], 1, at(60 + i * 0.01), lines(" c") + end if i % 2 == 0 else (lines(" c") + end)[len("data: {") :]) for i in range(n)]
    stream, _ = files(spark, str(tmp_path / "r"), first + second, "request_id string, seq bigint, ts timestamp, chunk string", 2)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    _append(sq.stream_transcripts(stream), out, checkpoint)
    got = [(r.request_id, r.text, r.output_tokens, r.ttft_ms, r.latency_ms) for r in spark.read.parquet(out).collect()]
    want = [(names[i], f"{i} a b", 2, 0.0, 0.0) if i % 2 == 0 else (names[i], f"{i} a b c", 3, 0.0, 60000.0) for i in range(n)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    state = spark.read.format("statestore").option("path", checkpoint)
    assert 0 < state.option("readRegisteredTimers", True).load().count() <= 1024
    state = spark.read.format("statestore").option("path", checkpoint)
    assert 0 < state.option("stateVarName", "responses").load().count() <= 1024
    assert state.option("stateVarName", "pieces").load().count() == 0
