import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import text, wire
from fleetlens.operators import batch, inference, transcripts
from fleetlens.streaming.processors import event_delta


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def fold(spark, events, failed=0):
    df = spark.createDataFrame([(1, at(i), i, s) for i, s in enumerate(events)], "job_id int, ts timestamp, seq int, ray_status string")
    counts = spark.createDataFrame([(1, failed)], "job_id int, failed bigint")
    row = batch.job_state_fold(df, counts).first()
    return row["status"], row["started_at"]


@pytest.mark.parametrize(
    "events, failed, expected",
    [
        (["PENDING"], 0, ("PENDING", None)),
        (["PENDING", "RUNNING", "RUNNING"], 0, ("RUNNING", at(1))),
        (["RUNNING", "SUCCEEDED"], 0, ("COMPLETED", at(0))),
        (["RUNNING", "SUCCEEDED"], 2, ("FAILED", at(0))),
        (["SUCCEEDED", "RUNNING"], 0, ("COMPLETED", None)),
        (["RUNNING", "FAILED"], 0, ("FAILED", at(0))),
        (["RUNNING", "STOPPED", "RUNNING"], 0, ("CANCELLED", at(0))),
        (["FAILED", "SUCCEEDED"], 0, ("COMPLETED", None)),
    ],
)
def test_job_state_fold(spark, events, failed, expected):
    assert fold(spark, events, failed) == expected


def test_counts_and_final_status(spark):
    data = [(1, "r", None), (1, None, "e"), (1, None, None), (2, "r", None), (3, "r", "e")]
    df = spark.createDataFrame(data, "job_id int, response string, error string")
    counts = batch.batch_counts(df)
    got = {r["job_id"]: tuple(r)[1:] for r in batch.batch_final_status(counts).collect()}
    assert got == {1: (3, 1, 1, 1, "FAILED"), 2: (1, 1, 0, 0, "COMPLETED"), 3: (1, 0, 1, 0, "FAILED")}


def test_short_results_leave_items_pending(spark, as_rows):
    items = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "job_id int, ordinal int, custom_id string")
    results = spark.createDataFrame([(1, 1, "r", None)], "job_id int, ordinal int, response string, error string")
    assert as_rows(batch.items_with_results(items, results), "custom_id", "response", "error") == [("a", "r", None), ("b", None, None)]


def test_synthetic_token_profile(spark):
    i = F.col("id")
    jobs = spark.range(49).select((50 + (i * 3) % 50).alias("input_tokens"), (100 + (i * 7) % 200).alias("output_tokens"))
    row = batch.token_cost(jobs).first()
    assert (row["job_count"], row["total_prefill_tokens"], row["total_decode_tokens"]) == (49, 3628, 9132)
    assert row["total_cost_s"] == pytest.approx(169.818)


def test_newest_job_comes_first(spark):
    data = [(1, at(0), 0, "PENDING"), (2, at(5), 1, "PENDING"), (1, at(9), 2, "SUCCEEDED")]
    df = spark.createDataFrame(data, "job_id int, ts timestamp, seq int, ray_status string")
    latest = batch.latest_job_state(df)
    assert [(r["job_id"], r["status"]) for r in latest.collect()] == [(2, "PENDING"), (1, "SUCCEEDED")]
    row = batch.session_buckets(latest).first()
    assert tuple(row) == (2, 1, 1, 0)


REQUEST = "model string, messages array<struct<role: string, content: string>>, stop array<string>, extra string, max_tokens int"


def test_request_body_defaults_stop_and_extra(spark):
    msgs = [("user", 'say "hi"\n')]
    data = [
        ("m", msgs, None, None, None),
        ("m", msgs, [], "{}", 7),
        ("m", msgs, ["x"], '{"max_tokens": 9, "guided": {"a": [1, null]}, "model": "other"}', 7),
        ("m", msgs, None, "not json", None),
    ]
    df = spark.createDataFrame(data, REQUEST)
    body = wire.request_to_wire(
        F.col("model"), F.col("messages"), stop=F.col("stop"), extra=F.col("extra"), max_tokens=F.col("max_tokens")
    )
    got = [json.loads(r[0]) for r in df.select(body).collect()]
    base = {
        "model": "m", "messages": [{"role": "user", "content": 'say "hi"\n'}], "max_tokens": 512,
        "temperature": 0.7, "top_p": 1.0, "n": 1, "stream": False,
    }
    assert got[0] == base and got[3] == base
    assert got[1] == {**base, "max_tokens": 7}
    assert got[2] == {**base, "stop": ["x"], "max_tokens": 9, "guided": {"a": [1, None]}, "model": "other"}


def test_response_defaults(spark):
    full = {
        "id": "c1", "object": "o", "created": 5, "model": "m",
        "choices": [{"index": 0, "message": {"role": "assistant", "content": "x"}}],
        "usage": {"prompt_tokens": 1, "completion_tokens": 2, "total_tokens": 3}, "_served_by": {"node": "n"},
    }
    df = spark.createDataFrame([(json.dumps(full),), ("{}",)], "body string").select(wire.response_from_wire(F.col("body")).alias("r"))
    one, two = [r["r"] for r in df.collect()]
    assert (one["id"], one["choices"][0]["finish_reason"], one["usage"]["total_tokens"]) == ("c1", "stop", 3)
    assert json.loads(one["served_by"]) == {"node": "n"}
    assert (two["id"], two["object"], two["created"], two["model"], two["choices"]) == ("", "chat.completion", 0, "", [])
    assert tuple(two["usage"]) == (0, 0, 0) and two["served_by"] is None


def test_preprocess_text(spark):
    df = spark.createDataFrame([(1, "  Hello\tWORLD x y "), (2, ""), (3, None), (4, "\x1c\x1d"), (5, "ÉTÉ\u00a0Σ")], "i int, text string")
    got = {r["i"]: (r["processed_text"], r["tokens"], r["token_count"]) for r in text.preprocess_text(df).collect()}
    assert got == {
        1: ("  hello\tworld x y ", ["hello", "world", "x", "y"], 4),
        2: ("", [], 0),
        3: ("none", ["none"], 1),
        4: ("\x1c\x1d", [], 0),
        5: ("été\u00a0σ", ["été", "σ"], 2),
    }
    other = spark.createDataFrame([(1,)], "n int")
    assert text.preprocess_text(other).columns == ["n"]


def test_prompts_are_numbered_after_blank_lines_go(spark):
    df = spark.createDataFrame([("one\n  \n two \n \nthree",)], "t string")
    got = [(r["custom_id"], r["messages"][0]["content"]) for r in text.prompts_to_items(df, "t", "m").collect()]
    assert got == [("q1", "one"), ("q2", " two "), ("q3", "three")]


@pytest.mark.parametrize(
    "raw, expected",
    [
        (None, ""), ("  \n", ""), (" plain \n", "plain"), ("{broken", "{broken"),
        ('{"data": {"logs": "a", "contents": "b"}}', "a"), ('{"data": {"logs": 5}, "logs": "top"}', "top"),
        ('{"data": {"content": "c"}, "contents": "d"}', "d"), ('{"data": null, "content": "e"}', "e"),
        ('{"data": [1], "content": "f"}', "f"), ('{"data": {"logs": 1}}', ""), ('{"data": {"logs": ""}, "logs": "x"}', ""),
    ],
)
def test_log_payload(spark, raw, expected):
    df = spark.createDataFrame([(raw,)], "raw string")
    assert df.select(text.log_payload_text(F.col("raw"))).first()[0] == expected


def infer(spark, fn, nodes, **kw):
    items = spark.createDataFrame([(f"i{n}", json.dumps({"n": n})) for n in range(12)], "custom_id string, request string")
    return inference.batch_infer(items, fn, nodes, partitions=3, **kw).collect()


def test_failed_node_is_skipped(spark):
    def fn(url, request):
        if url == "u1":
            raise RuntimeError("down")
        return "{}"

    got = infer(spark, fn, [("a", "u1"), ("b", "u2")])
    assert len(got) == 12
    assert all((r["node"], r["url"], r["error"]) == ("b", "u2", None) for r in got)
    assert {r["attempt"] for r in got} == {1, 2}


def test_last_failure_keeps_the_row_and_its_error(spark):
    def fn(url, request):
        raise ValueError(f"no {url}")

    got = infer(spark, fn, [("a", "u")], max_attempts=3)
    assert len(got) == 12
    assert all((r["response"], r["error"], r["attempt"]) == (None, "no u", None) for r in got)


def test_no_nodes_and_no_attempts_are_error_rows(spark):
    assert {r["error"] for r in infer(spark, lambda u, q: q, [])} == {"no eligible nodes available"}
    assert {r["error"] for r in infer(spark, lambda u, q: q, [("a", "u")], max_attempts=0)} == {"router exhausted retries"}


def event(content):
    return "data: " + json.dumps({"choices": [{"delta": {"content": content}}]}) + "\n\n"


@pytest.mark.parametrize("cut", [1, 3, 7, 64, 10000])
def test_transcripts_survive_any_chunking(spark, cut):
    body = event("He") + "data: nonsense\n" + ": ping\n" + event("") + event("llo\n") + event(" wörld") + 'data: {"choices": []}\n' + "data: [DONE]\n"
    raw = {"r1": body, "r2": "data: [DONE]\n", "r3": event("only").strip()}
    data = [(k, i, at(i), t[p : p + cut]) for k, t in raw.items() for i, p in enumerate(range(0, len(t), cut))]
    df = spark.createDataFrame(data, "request_id string, seq int, ts timestamp, chunk string")
    started = spark.createDataFrame([(k, at(-2)) for k in raw], "request_id string, started_at timestamp")
    got = {r["request_id"]: r for r in transcripts.sse_transcripts(df, started, slice_size=4).collect()}
    assert {k: (r["text"], r["output_tokens"]) for k, r in got.items()} == {
        "r1": ("Hello\n wörld", 3), "r2": ("", 0), "r3": ("only", 1),
    }
    last = (len(body) - 1) // cut
    assert got["r1"]["latency_ms"] == (last + 2) * 1000.0
    assert got["r1"]["tokens_per_s"] == pytest.approx(3 / (last + 2))
    assert got["r2"]["ttft_ms"] is None


def test_event_delta_helper():
    assert event_delta(event("x").strip()) == "x"
    for line in ("data: [DONE]", "data: {", "x", event("").strip(), 'data: {"choices": []}', "data: 5"):
        assert event_delta(line) is None


def test_record_keys(spark):
    df = spark.createDataFrame([("c1", {"ray_job_id": "raysubmit_7"}), ("c2", {}), ("c3", {"other": "x"})], "id string, m map<string,string>")
    got = [r[0] for r in df.select(batch.record_key(F.col("id"), F.col("m"))).collect()]
    assert got == ["outputs/offline/ray_job_7/c1.json", "outputs/online/c2.json", "outputs/online/c3.json"]


def test_offline_error_record(spark):
    schema = (
        "job_id string, submission_id string, model string, messages array<struct<role: string, content: string>>, "
        "response struct<id: string, created: bigint, usage: struct<prompt_tokens: bigint, completion_tokens: bigint, total_tokens: bigint>>, "
        "error string, finished_at bigint"
    )
    df = spark.createDataFrame([("b1", "raysubmit_1", "m", [("user", "q")], None, "boom", 99)], schema)
    row = batch.record_offline(df).first()
    assert (row["request_id"], row["timestamp"], row["total_tokens"], row["latency_ms"]) == ("err-b1", 99, 0, 0.0)
    assert json.loads(row["output_response"]) == {"error": "boom"} and row["metadata"] == {"ray_job_id": "raysubmit_1"}
