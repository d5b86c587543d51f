import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from fleetlens.sources import readers, sinks
from fleetlens.sources.arrays import array_elements


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


ITEMS = [{"custom_id": f"q{i}", "request": {"model": "m", "messages": [{"role": "user", "content": f"p{i}"}]}} for i in range(3)]


def test_batch_input_as_one_array_over_lines(spark, tmp_path):
    (tmp_path / "in.json").write_text(json.dumps(ITEMS, indent=2))
    got = readers.read_batch_input(spark, str(tmp_path / "in.json"), multi_line=True).orderBy("position").collect()
    assert [(r["custom_id"], r["request"]["messages"][0]["content"]) for r in got] == [("q0", "p0"), ("q1", "p1"), ("q2", "p2")]


def test_batch_input_as_arrays_per_line(spark, tmp_path):
    (tmp_path / "in.json").write_text(json.dumps(ITEMS[:2]) + "\n" + json.dumps(ITEMS[2:]) + "\n")
    got = readers.read_batch_input(spark, str(tmp_path / "in.json")).collect()
    assert [r["custom_id"] for r in got] == ["q0", "q1", "q2"]


def test_batch_output(spark, tmp_path):
    data = [{"response": {"id": "c", "usage": {"total_tokens": 4}}, "error": None}, {"response": None, "error": "boom"}]
    (tmp_path / "out.json").write_text(json.dumps(data))
    got = readers.read_batch_output(spark, str(tmp_path / "out.json"), multi_line=True).orderBy("position").collect()
    assert (got[0]["response"]["usage"]["total_tokens"], got[1]["response"], got[1]["error"]) == (4, None, "boom")


def test_batch_files_keep_everything(spark, tmp_path):
    request = {"model": "m", "messages": [{"role": "user", "content": "p"}], "seed": 7, "guided_json": {"a": [1]}}
    (tmp_path / "batch_input_j1.json").write_text(json.dumps([{"custom_id": "q", "request": request}]))
    got = readers.read_batch_input(spark, str(tmp_path / "batch_input_j1.json"), multi_line=True).collect()[0]
    assert (got["job"], got["position"], json.loads(got["body"])) == ("j1", 0, request)
    answer = {"id": "c", "created": 5, "choices": [{"index": 0, "message": {"role": "assistant", "content": "hi"}}], "_served_by": "n1"}
    (tmp_path / "batch_output_j1.json").write_text(json.dumps([{"response": None, "error": "e"}, {"response": answer, "error": None}], indent=1))
    rows = readers.read_batch_output(spark, str(tmp_path / "batch_output_j1.json"), multi_line=True).orderBy("position").collect()
    assert [(r["job"], r["position"], r["error"]) for r in rows] == [("j1", 0, "e"), ("j1", 1, None)]
    response = rows[1]["response"]
    assert (response["created"], response["choices"][0]["message"]["content"], response["served_by"]) == (5, "hi", "n1")
    assert json.loads(rows[1]["body"]) == answer and rows[0]["response"] is None


def test_batch_lines_are_bounded(spark, tmp_path):
    df = spark.range(1000).select(F.lit(1).alias("job_id"), F.col("id").alias("ordinal"), F.lit("e").alias("error"))
    sinks.write_batch_lines(df, str(tmp_path / "o"), ["job_id"], "ordinal", size=100)
    lines = spark.read.text(str(tmp_path / "o")).collect()
    assert sorted(len(json.loads(r["value"])) for r in lines) == [100] * 10
    assert readers.read_batch_output(spark, str(tmp_path / "o")).count() == 1000


def test_token_csv_takes_the_first_rows(spark, tmp_path):
    text = "input_tokens,output_tokens\n" + "".join(f"{i},{i * 2}\n" for i in range(60))
    (tmp_path / "t.csv").write_text(text)
    got = readers.read_token_csv(spark, str(tmp_path / "t.csv"), limit=49).collect()
    assert sorted(r["input_tokens"] for r in got) == list(range(49))
    assert readers.read_token_csv(spark, str(tmp_path / "t.csv")).count() == 60


def docs(spark, *bodies):
    return spark.createDataFrame([(0, i, b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)],
                                 "cluster_id int, snapshot_ts int, body string")


def test_node_snapshots_tolerate_gaps(spark):
    good = {"data": {"result": {"result": [{"node_ip": " 1 ", "node_name": None, "resources_total": {"GPU": 1}}, {"node_ip": "2", "is_head_node": True}]}}}
    got = readers.nodes_from_snapshots(docs(spark, good, {}, {"data": {"result": {"result": "x"}}}, "broken")).collect()
    assert [(r["snapshot_ts"], r["ordinal"], r["node_ip"], r["node_name"], r["is_head_node"], r["resources"]) for r in got] == [
        (0, 0, "1", "", False, {"GPU": 1.0}), (0, 1, "2", "", True, {}),
    ]


def test_serve_snapshots(spark):
    body = {"applications": {"app": {"status": "RUNNING", "deployments": {"d": {"status": "HEALTHY", "replicas": [{"replica_id": "r", "state": "RUNNING"}]}}}, "bare": {"status": "X"}}}
    frame = docs(spark, body, {"applications": {}}, {})
    got = readers.replicas_from_snapshots(frame, "app", "d").collect()
    assert [(r["snapshot_ts"], r["replica_id"], r["state"]) for r in got] == [(0, "r", "RUNNING")]
    assert readers.replicas_from_snapshots(frame, "app", "none").count() == 0
    assert sorted((r["app"], r["status"]) for r in readers.statuses_from_snapshots(frame).collect()) == [("app", "HEALTHY"), ("app", "RUNNING"), ("bare", "X")]


def test_usage_by_node(spark):
    report = {"usageByNode": {"n1": {"CPU": [0, 1], "node:10.0.0.1": [0, 1]}, "n2": {"CPU": [0, 1]}}, "usage": {"CPU": [0, 2]}}
    frame = docs(spark, {"data": {"clusterStatus": {"loadMetricsReport": report}}}, {})
    got = {r["node_id"]: (r["node_ip"], r["resource_keys"]) for r in readers.usage_by_node(frame).collect()}
    assert got == {"n1": ("10.0.0.1", ["CPU", "node:10.0.0.1"]), "n2": ("unknown", ["CPU"])}
    assert [r["key"] for r in readers.usage_keys(frame).collect()] == ["CPU"]


def test_access_log_values_are_text(spark, tmp_path):
    lines = [
        json.dumps({"requestId": "a", "apiKeyId": "k", "requestTime": "09/Apr/2024:12:34:56 +0000", "status": "200", "latency": "12", "responseLength": "-"}),
        "not json",
    ]
    (tmp_path / "log").write_text("\n".join(lines))
    got = readers.read_access_log(spark, str(tmp_path / "log")).where("request_id IS NOT NULL").collect()
    assert len(got) == 1
    row = got[0]
    assert (row["status"], row["latency_ms"], row["response_length"]) == (200, 12.0, None)
    assert row["ts"] == dt.datetime(2024, 4, 9, 12, 34, 56)


RECORD = (
    "request_id string, timestamp bigint, model_name string, input_messages array<struct<role: string, content: string>>, "
    "output_response string, latency_ms double, prompt_tokens bigint, completion_tokens bigint, total_tokens bigint, metadata map<string,string>"
)


def test_records_by_channel_and_job(spark, tmp_path):
    data = [("a", 1, "m", [("user", "q")], "{}", 1.5, 1, 2, 3, {"ray_job_id": f"raysubmit_{i % 3}"}) for i in range(9)]
    data.append(("z", 1, "m", [], "{}", 1.0, 0, 0, 0, {}))
    sinks.write_records(spark.createDataFrame(data, RECORD), str(tmp_path / "r"))
    back = readers_rows = sinks.read_records(spark, str(tmp_path / "r"))
    assert back.count() == 10
    mine = sinks.read_records(spark, str(tmp_path / "r"), "ray_job_1").collect()
    assert len(mine) == 3 and {r["key"] for r in mine} == {"outputs/offline/ray_job_1/a.json"}
    online = [r for r in readers_rows.collect() if r["channel"] == "online"]
    assert [(r["request_id"], r["job"], r["metadata"]) for r in online] == [("z", None, {})]


def test_records_take_a_fraction_of_their_text(spark, tmp_path):
    names = ("request_id", "timestamp", "model_name", "input_messages", "output_response", "latency_ms", "prompt_tokens", "completion_tokens", "total_tokens", "metadata")
    values = ("uuid()", "id", "'m'", "array(named_struct('role', 'user', 'content', 'p'))", "'{}'", "0D", "1L", "1L", "2L", "map('ray_job_id', 'raysubmit_1')")
    sinks.write_records(spark.range(5000).selectExpr(*[f"{v} AS {n}" for n, v in zip(names, values)]), str(tmp_path))
    back = sinks.read_records(spark, str(tmp_path), "ray_job_1")
    assert back.agg(F.sum("timestamp")).first()[0] == sum(range(5000))
    text = back.select(F.sum(F.length(F.to_json(F.struct(*names))))).first()[0]
    assert 0 < sum(f.stat().st_size for f in tmp_path.glob("*/*/part-*")) < text / 3


def test_logs_and_events_round_trip(spark, tmp_path, as_rows):
    rows = [("a.log", 2, "z"), ("b.log", 1, ""), ("a.log", 1, "x\ny\r")]
    sinks.write_logs(spark.createDataFrame(rows, "filename string, seq int, text string").repartition(3), str(tmp_path))
    assert as_rows(sinks.read_logs(spark, str(tmp_path)), "filename", "line", "value") == [("a.log", 1, "x"), ("a.log", 2, "y\r"), ("a.log", 3, "z"), ("b.log", 1, "")]
    sinks.write_logs(spark.createDataFrame([("b.log", 1, "new")], "filename string, seq int, text string"), str(tmp_path))
    assert as_rows(sinks.read_logs(spark, str(tmp_path)), "filename", "line", "value")[2:] == [("a.log", 3, "z"), ("b.log", 1, "new")]


def test_a_large_log_keeps_its_order_over_parts_and_ranges(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        logs = spark.range(2000).select(F.lit("big.log").alias("filename"), F.col("id").alias("seq"), F.concat(F.lit("line "), "id").alias("text"))
        sinks.write_logs(logs.orderBy(F.rand(3)), str(tmp_path))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        rows = sinks.read_logs(spark, str(tmp_path)).orderBy("line").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "logs" / "filename=big.log").glob("part-*"))) > 1
    assert [(r.line, r.value) for r in rows] == [(i + 1, f"line {i}") for i in range(2000)]


def test_datums(spark, as_rows):
    calls = spark.createDataFrame([(at(0), 1, 500, 7.5)], "ts timestamp, node int, status int, latency_ms double")
    assert as_rows(sinks.gateway_datums(calls), "metric", "value", "unit") == [
        ("availability", 0.0, "None"), ("latency_ms", 7.5, "Milliseconds"), ("request_count", 1.0, "None"),
    ]
    jobs = spark.createDataFrame([(at(0), "completed")], "created_at timestamp, status string")
    assert as_rows(sinks.batch_datums(jobs), "metric", "value") == [("batch_job_count", 1.0), ("batch_reliability", 1.0)]


def test_records_are_written_by_as_many_tasks_as_the_data_needs(spark, tmp_path):
    import glob

    record = (
        "uuid() AS request_id", "id AS timestamp", "'m' AS model_name",
        "array(named_struct('role', 'user', 'content', 'p')) AS input_messages", "'o' AS output_response", "1.0D AS latency_ms",
        "1L AS prompt_tokens", "1L AS completion_tokens", "2L AS total_tokens",
    )
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "16k")
    try:
        for name, metadata in (("job", "map('ray_job_id', 'raysubmit_1')"), ("online", "cast(null AS map<string,string>)")):
            rows = spark.range(0, 30000, 1, 120).selectExpr(*record, f"{metadata} AS metadata")
            sinks.write_records(rows, str(tmp_path / name), buckets=4)
            assert len(glob.glob(str(tmp_path / name / "*" / "*" / "part-*"))) > 64
            assert sinks.read_records(spark, str(tmp_path / name)).count() == 30000
        assert sinks.read_records(spark, str(tmp_path / "job"), "ray_job_1", buckets=4).count() == 30000
    finally:
        spark.conf.set(size, before)


def test_metric_text_keeps_every_digit(spark):
    values = [0.0, 1.5, 0.0001, 1e-7, 123456789.125, 1e20, 1e32, -2e7, 1e-300]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", sinks._plain(F.col("v")).alias("t")).collect()
    assert all(float(r["t"]) == r["v"] for r in rows)
    assert [r["t"] for r in rows][2:5] == ["0.0001", "0.0000001", "123456789.125"]


def test_exposition_lines(spark):
    row = (0, "n", "primary", 3, 1, 0, 2, True, False, 12.0, 1700000000.25, 1.0, 2.5, 0.0001)
    schema = (
        "cluster_id int, name string, status string, jobs_total bigint, jobs_failed bigint, respawns bigint, inflight bigint, readiness_ok boolean, "
        "sla_ok boolean, last_latency_ms double, last_check double, latency_p50_ms double, latency_p95_ms double, latency_p99_ms double"
    )
    got = {r["metric"]: r["line"] for r in sinks.metrics_exposition(spark.createDataFrame([row], schema)).collect()}
    assert len(got) == 13
    assert got["router_jobs_total"] == 'router_jobs_total{node="n"} 3'
    assert got["router_status"] == 'router_status{node="n"} 1.0'
    assert got["router_sla_ok"] == 'router_sla_ok{node="n"} 0.0'
    assert got["router_last_check_seconds"] == 'router_last_check_seconds{node="n"} 1700000000.25'
    assert got["router_latency_p99_ms"] == 'router_latency_p99_ms{node="n"} 0.0001'
    assert got["router_sla_p95_target_ms"] == "router_sla_p95_target_ms 30000.0"


NESTED = ['a}b', '{"', "\\", '\\"}', "x\\\\}", "[]{}", "é漢", "\n", " ,", "", "}{", '"']


def nested(rng, depth=0):
    kind = rng.randrange(6 if depth < 3 else 3)
    if kind < 3:
        return [rng.choice(NESTED), rng.random(), None][kind]
    if kind == 3:
        return rng.choice(NESTED) + str(rng.random())
    if kind == 4:
        return [nested(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["a", "b}", '"c', "\\d"]) + str(i): nested(rng, depth + 1) for i in range(rng.randrange(4))}


def test_array_elements_by_small_byte_ranges(spark, tmp_path):
    """Whole arrays whose strings hold braces, quotes and escapes, cut into ranges of 200 bytes."""
    rng, want = random.Random(4), {}
    for f, size in enumerate([0, 1, 5, 400, 2, 0, 300, 1]):
        items = [{"k": nested(rng)} for _ in range(size)]
        body = json.dumps(items, indent=rng.choice([None, 1, 4]), ensure_ascii=rng.random() < 0.5) + rng.choice(["", "\n"])
        (tmp_path / f"{f}.json").write_text(body)
        want[f"{f}.json"] = items
    settings = {"spark.sql.files.maxPartitionBytes": "200", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 20
        rows = array_elements(spark, str(tmp_path)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    found = {f: [] for f in want}
    for r in sorted(rows, key=lambda r: r.position):
        found[r.file.rsplit("/", 1)[1]].append((r.position, json.loads(r.element)))
    assert found == {f: list(enumerate(items)) for f, items in want.items()}


@pytest.mark.parametrize("text, good, bad", [
    ('[{"response": null, "error": "e"}, {"response": nu', 1, 1),
    ('[{"response": null, "error": "e"}', 1, 0),
    ('[{"response": null, "error": "e"}, {"response": {"id": "x"', 1, 1),
    ("not json", 0, 1), ("[]", 0, 0), ("", 0, 0), (" [\n ] \n", 0, 0), ('[null, {"error": "e"}]', 0, 1),
])
def test_broken_batch_files_keep_their_good_items(spark, tmp_path, text, good, bad):
    (tmp_path / "batch_output_j.json").write_text(text)
    rows = readers.read_batch_output(spark, str(tmp_path / "batch_output_j.json"), multi_line=True).collect()
    assert [sum(r.problem is None for r in rows), sum(r.problem is not None for r in rows)] == [good, bad]
    assert all(r.error == "e" for r in rows if r.problem is None) and all(r.job == "j" for r in rows)


def test_broken_lines_are_rows(spark, tmp_path):
    (tmp_path / "o").write_text('[{"error": "a"}, {"error": "b"}]\n[{"error": "c"\n{"error": "d"}\n[]\n\n')
    rows = readers.read_batch_output(spark, str(tmp_path / "o")).collect()
    assert sorted(r.error for r in rows if r.problem is None) == ["a", "b", "d"]
    assert sum(r.problem is not None for r in rows) == 1
