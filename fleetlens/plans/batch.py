"""Batch job, record and text queries."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import text as tx
from fleetlens.functions import wire
from fleetlens.functions.status import item_succeeded
from fleetlens.operators import batch, inference, transcripts
from fleetlens.plans.fixtures import Tables, with_views
from fleetlens.plans.registry import Query

MODEL = "chat-7b"
NODES = [("alpha", "http://alpha/v1"), ("beta", "http://beta/v1"), ("gamma", "http://gamma/v1")]
CHUNK_CHARS = 509
STREAM_EPOCH = 1_700_000_000


def turns(t: Tables) -> DataFrame:
    """One request per conversation turn."""
    return t.chat_messages.select(
        F.concat_ws("-", "conv_id", "turn").alias("request_id"),
        "conv_id",
        "turn",
        F.lit(MODEL).alias("model"),
        F.array(F.struct("role", F.col("text").alias("content"))).alias("messages"),
        "text",
    )


def _wire(t: Tables) -> DataFrame:
    calls = turns(t)
    extra = F.when(F.col("conv_id") % 3 == 1, '{"max_tokens":64,"seed":7}').when(
        F.col("conv_id") % 3 == 2, '{"top_k":40,"note":{"a":[1,2]}}'
    )
    stop = F.when(F.col("turn") % 2 == 0, F.array(F.lit("END"))).otherwise(F.array().cast("array<string>"))
    max_tokens = F.when(F.col("turn") == 3, F.lit(100))
    body = wire.request_to_wire(F.col("model"), F.col("messages"), stop=stop, extra=extra, max_tokens=max_tokens)
    parsed = calls.withColumn("body", body)

    def at(path: str):
        return F.get_json_object("body", path)

    return parsed.select(
        "request_id",
        at("$.model").alias("model"),
        at("$.messages[0].content").alias("content"),
        at("$.max_tokens").cast("int").alias("max_tokens"),
        at("$.temperature").cast("double").alias("temperature"),
        at("$.top_p").cast("double").alias("top_p"),
        at("$.n").cast("int").alias("n"),
        at("$.stream").alias("stream"),
        at("$.stop").alias("stop"),
        at("$.seed").cast("int").alias("seed"),
        at("$.top_k").cast("int").alias("top_k"),
        at("$.note.a[1]").cast("int").alias("note"),
    )


def response_bodies(t: Tables) -> DataFrame:
    """Response bodies with fields missing on some rows."""
    odd, full = F.col("turn") % 2 == 1, F.col("turn") % 3 != 0
    size = F.length("text").cast("long")
    choice = F.struct(
        F.lit(0).alias("index"),
        F.struct(F.lit("assistant").alias("role"), F.col("text").alias("content")).alias("message"),
        F.when(odd, F.lit("length")).alias("finish_reason"),
    )
    usage = F.struct(size.alias("prompt_tokens"), F.col("turn").alias("completion_tokens"), (size + F.col("turn")).alias("total_tokens"))
    body = F.to_json(
        F.struct(
            F.when(full, F.col("request_id")).alias("id"),
            F.when(full, F.lit(MODEL)).alias("model"),
            F.when(full, F.lit(STREAM_EPOCH) + F.col("conv_id")).alias("created"),
            F.when(full, F.array(choice)).alias("choices"),
            F.when(odd, usage).alias("usage"),
            F.struct(F.lit("alpha").alias("node")).alias("_served_by"),
        )
    )
    return turns(t).select("*", body.alias("body"))


def _responses(t: Tables) -> DataFrame:
    typed = response_bodies(t).withColumn("r", wire.response_from_wire(F.col("body")))
    return typed.select(
        "request_id",
        F.col("r.id").alias("id"),
        F.col("r.object").alias("object"),
        F.col("r.created").alias("created"),
        F.col("r.model").alias("model"),
        F.size("r.choices").alias("n_choices"),
        F.get(F.col("r.choices.message.content"), F.lit(0)).alias("content"),
        F.get(F.col("r.choices.finish_reason"), F.lit(0)).alias("finish_reason"),
        F.col("r.usage.total_tokens").alias("total_tokens"),
        F.get_json_object("r.served_by", "$.node").alias("served_by"),
    )


TURNS_SQL = """turns AS (SELECT concat(conv_id, '-', turn) AS request_id, * FROM conversations)"""

RESPONSE_SQL = f"""responses AS (SELECT request_id, conv_id, turn, role, text, CASE WHEN turn % 3 <> 0 THEN request_id ELSE '' END AS id,
    CASE WHEN turn % 3 <> 0 THEN {STREAM_EPOCH} + conv_id ELSE 0 END AS created,
    CASE WHEN turn % 3 <> 0 THEN '{MODEL}' ELSE '' END AS model,
    CASE WHEN turn % 2 = 1 THEN length(text) ELSE 0 END AS prompt_tokens,
    CASE WHEN turn % 2 = 1 THEN turn ELSE 0 END AS completion_tokens,
    CASE WHEN turn % 2 = 1 THEN length(text) + turn ELSE 0 END AS total_tokens FROM turns)"""


def _flat_records(records: DataFrame, *extra: str) -> DataFrame:
    return records.select(
        *extra,
        "request_id",
        "timestamp",
        "model_name",
        F.get(F.col("input_messages.content"), F.lit(0)).alias("content"),
        "latency_ms",
        "prompt_tokens",
        "completion_tokens",
        "total_tokens",
    )


def _online(t: Tables) -> DataFrame:
    calls = response_bodies(t).select(
        "model",
        "messages",
        wire.response_from_wire(F.col("body")).alias("response"),
        (F.col("turn") * 1.5).alias("latency_ms"),
    )
    records = batch.record_online(calls)
    flat = _flat_records(records)
    return flat.withColumn("model_name", F.col("model_name"))


def stream_chunks(messages: DataFrame) -> DataFrame:
    """Turns as event streams, cut into chunks that split lines."""
    pieces = F.transform(
        F.split("text", " "),
        lambda word, i: F.concat(
            F.lit("data: "),
            F.to_json(
                F.struct(
                    F.array(
                        F.struct(
                            F.struct(F.when(i == 0, word).otherwise(F.concat(F.lit(" "), word)).alias("content")).alias("delta")
                        )
                    ).alias("choices")
                )
            ),
        ),
    )
    whole = F.concat(F.array_join(pieces, "\n\n"), F.lit("\n\ndata: [DONE]\n\n"))
    cut = F.regexp_extract_all("whole", F.lit("(?s).{1,%d}" % CHUNK_CHARS), F.lit(0))
    return messages.withColumn("whole", whole).select(
        F.concat_ws("-", "conv_id", "turn").alias("request_id"),
        "conv_id",
        "turn",
        F.posexplode(cut).alias("seq", "chunk"),
    ).withColumn("ts", F.timestamp_millis(F.lit(STREAM_EPOCH * 1000) + F.col("conv_id") * 1000 + F.col("seq") * 10))


def _started(t: Tables) -> DataFrame:
    return t.chat_messages.select(
        F.concat_ws("-", "conv_id", "turn").alias("request_id"),
        F.timestamp_millis(F.lit(STREAM_EPOCH * 1000 - 250) + F.col("conv_id") * 1000).alias("started_at"),
    )


def _stream_records(t: Tables) -> DataFrame:
    requests = turns(t).join(_started(t), "request_id").select(
        "request_id",
        F.unix_seconds("started_at").alias("timestamp"),
        "model",
        "messages",
        (F.col("turn") * 2.0).alias("latency_ms"),
    )
    records = batch.record_stream(requests, stream_chunks(t.chat_messages))
    events = F.size(F.split(F.get_json_object("output_response", "$.raw_stream"), "data: ")) - 1
    return _flat_records(records.withColumn("events", events), "events")


def _transcripts(t: Tables) -> DataFrame:
    done = transcripts.sse_transcripts(stream_chunks(t.chat_messages), _started(t))
    return done.select("request_id", "text", "output_tokens", "ttft_ms", "latency_ms", "tokens_per_s")


def _items(t: Tables) -> DataFrame:
    return t.batch_items.select(
        "job_id", "ordinal", F.concat_ws("-", F.lit("c"), "job_id", "ordinal").alias("custom_id")
    )


def _results(t: Tables) -> DataFrame:
    """Results file: pending items have no row."""
    done = t.batch_items.where(F.col("response_id").isNotNull() | F.col("error").isNotNull())
    return done.select("job_id", "ordinal", F.col("response_id").alias("response"), "error")


def offline_records(t: Tables) -> DataFrame:
    prompt, completion = F.col("prompt_tokens").cast("long"), F.col("completion_tokens").cast("long")
    response = F.struct(
        F.col("response_id").alias("id"),
        (F.lit(STREAM_EPOCH) + F.col("job_id")).alias("created"),
        F.struct(
            prompt.alias("prompt_tokens"), completion.alias("completion_tokens"), (prompt + completion).alias("total_tokens")
        ).alias("usage"),
    )
    items = t.batch_items.select(
        "job_id",
        F.concat(F.lit("raysubmit_"), "job_id").alias("submission_id"),
        F.lit(MODEL).alias("model"),
        F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit("item "), "ordinal").alias("content"))).alias("messages"),
        F.when(F.col("response_id").isNotNull(), response).alias("response"),
        "error",
        F.lit(STREAM_EPOCH).alias("finished_at"),
    )
    return batch.record_offline(items)


OFFLINE_SQL = f"""records AS (SELECT job_id, CASE WHEN response_id IS NOT NULL THEN response_id ELSE concat('err-', job_id) END AS request_id,
    CASE WHEN response_id IS NOT NULL THEN {STREAM_EPOCH} + job_id ELSE {STREAM_EPOCH} END AS timestamp, '{MODEL}' AS model_name,
    concat('item ', ordinal) AS content, 0.0::DOUBLE AS latency_ms, error,
    CASE WHEN response_id IS NOT NULL THEN prompt_tokens ELSE 0 END::BIGINT AS prompt_tokens,
    CASE WHEN response_id IS NOT NULL THEN completion_tokens ELSE 0 END::BIGINT AS completion_tokens,
    CASE WHEN response_id IS NOT NULL THEN prompt_tokens + completion_tokens ELSE 0 END::BIGINT AS total_tokens FROM batch_items)"""


def _echo(url: str, request: str) -> str:
    """A deterministic stand-in for a model server: fails on some node and prompt pairs."""
    prompt = json.loads(request)["messages"][0]["content"]
    index = [u for _, u in NODES].index(url)
    if (len(prompt) + index) % 3 == 0 or len(prompt) % 7 == 0:
        raise RuntimeError(f"{url} refused {len(prompt)}")
    return json.dumps({"id": f"chatcmpl-{len(prompt)}", "model": MODEL})


def answer(url: str, request: str) -> str:
    """As ``_echo``, with a whole response: the answer repeats how the prompt begins."""
    _echo(url, request)
    prompt = json.loads(request)["messages"][0]["content"]
    message = {"role": "assistant", "content": f"Re: {prompt[:20]}"}
    usage = {"prompt_tokens": len(prompt), "completion_tokens": 1, "total_tokens": len(prompt) + 1}
    return json.dumps({"id": f"chatcmpl-{len(prompt)}", "created": len(prompt), "model": MODEL, "choices": [{"index": 0, "message": message}], "usage": usage})


# Which node answered which turn at which attempt, or the last error, by the rule of the stand-in server.
INFERRED_SQL = f"""{TURNS_SQL}, a AS (SELECT request_id, CAST(length(text) AS INTEGER) AS size, k,
          CAST((CAST(concat('0x', left(md5(request_id), 8)) AS BIGINT) + k - 1) % 3 AS INTEGER) AS i FROM turns, range(1, 3) r(k)),
        b AS (SELECT *, (size + i) % 3 = 0 OR size % 7 = 0 AS bad FROM a),
        c AS (SELECT request_id, any_value(size) AS size, min(k) FILTER (NOT bad) AS won, arg_max(i, k) AS last FROM b GROUP BY 1)"""


def _inferred(t: Tables) -> DataFrame:
    items = turns(t).select(
        F.col("request_id").alias("custom_id"),
        wire.request_to_wire(F.col("model"), F.col("messages")).alias("request"),
        F.length("text").alias("size"),
    )
    done = inference.batch_infer(items, _echo, NODES, max_attempts=2)
    return done.select("custom_id", "size", "node", "attempt", "error", F.get_json_object("response", "$.model").alias("model"))


_WORDS = r"list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')"

# Lengths of the lines of each stream, and from them the chunks that end the first token and the stream; chunks are 10 ms apart.
TRANSCRIPT_SQL = f"""WITH {TURNS_SQL},
    w AS (SELECT request_id, text, list_transform(string_split(text, ' '), lambda x, i: CASE WHEN i = 1 THEN x ELSE concat(' ', x) END) AS words FROM turns),
    l AS (SELECT *, list_transform(words, lambda x: length(concat('data: {{"choices":[{{"delta":{{"content":', to_json(x)::VARCHAR, '}}}}]}}'))) AS sizes FROM w),
    c AS (SELECT request_id, text, len(words) - CASE WHEN words[1] = '' THEN 1 ELSE 0 END AS tokens,
      (list_sum(sizes) + 2 * (len(sizes) - 1) + 16 - 1) // {CHUNK_CHARS} AS last,
      CASE WHEN words[1] <> '' THEN sizes[1] WHEN len(words) > 1 THEN sizes[1] + 2 + sizes[2] END // {CHUNK_CHARS} AS first FROM l)
    SELECT request_id, text, tokens::BIGINT AS output_tokens, (250 + 10 * first)::DOUBLE AS ttft_ms, (250 + 10 * last)::DOUBLE AS latency_ms,
      round(tokens / ((250 + 10 * last) / 1000.0), 6)::DOUBLE AS tokens_per_s FROM c"""

QUERIES = {
    "preprocess_text": Query(
        lambda t: tx.preprocess_text(t.documents).select(
            "doc_id", "processed_text", "token_count", F.array_join("tokens", " ").alias("tokens")
        ),
        f"""SELECT doc_id, lower(text) AS processed_text, CAST(len({_WORDS}) AS INTEGER) AS token_count,
        array_to_string({_WORDS}, ' ') AS tokens FROM documents""",
    ),
    "prompts_to_items": Query(
        lambda t: tx.prompts_to_items(t.documents.select("doc_id", "text"), "text", MODEL).select(
            "doc_id", "custom_id", F.col("messages")[0]["content"].alias("content"), "max_tokens"
        ),
        r"""WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S')) AS lines FROM documents),
        n AS (SELECT doc_id, unnest(lines) AS content, unnest(range(1, len(lines) + 1)) AS pos FROM l)
        SELECT doc_id, concat('q', pos) AS custom_id, content, 256 AS max_tokens FROM n""",
    ),
    "item_succeeded": Query(
        lambda t: t.item_flags.select(
            "job_id", "response_id", "error", item_succeeded(F.col("response_id"), F.col("error")).alias("succeeded")
        ),
        with_views(
            "batch_items",
            sql="""SELECT job_id, response_id, error, response_id IS NOT NULL AND error IS NULL AS succeeded FROM batch_items""",
        ),
    ),
    "items_with_results": Query(
        lambda t: batch.items_with_results(_items(t), _results(t)),
        with_views(
            "batch_items",
            sql="""SELECT job_id, ordinal, concat('c-', job_id, '-', ordinal) AS custom_id, response_id AS response, error FROM batch_items""",
        ),
    ),
    "batch_counts": Query(
        lambda t: batch.batch_counts(t.item_flags, "response_id"),
        with_views(
            "batch_items",
            sql="""SELECT job_id, count(*) AS total, count(*) FILTER (response_id IS NOT NULL AND error IS NULL) AS completed,
            count(error) AS failed, count(*) FILTER (response_id IS NULL AND error IS NULL) AS pending FROM batch_items GROUP BY 1""",
        ),
    ),
    "batch_final_status": Query(
        lambda t: batch.batch_final_status(batch.batch_counts(t.item_flags, "response_id")).select("job_id", "failed", "status"),
        with_views(
            "batch_items",
            sql="""SELECT job_id, count(error) AS failed, CASE WHEN count(error) = 0 THEN 'COMPLETED' ELSE 'FAILED' END AS status
            FROM batch_items GROUP BY 1""",
        ),
    ),
    "job_state_fold": Query(
        lambda t: batch.job_state_fold(t.job_events, batch.batch_counts(t.item_flags, "response_id")),
        with_views(
            "job_events",
            "batch_items",
            sql="""WITH f AS (SELECT job_id, count(error) AS failed FROM batch_items GROUP BY 1),
            c AS (SELECT job_id, arg_max(ray_status, seq) FILTER (ray_status IN ('SUCCEEDED','FAILED','STOPPED')) AS fin,
              min(seq) FILTER (ray_status IN ('SUCCEEDED','FAILED','STOPPED')) AS closed,
              min(seq) FILTER (ray_status = 'RUNNING') AS ran, min(ts) FILTER (ray_status = 'RUNNING') AS ran_ts
              FROM job_events GROUP BY 1)
            SELECT c.job_id, CASE WHEN fin = 'SUCCEEDED' THEN CASE WHEN coalesce(failed, 0) = 0 THEN 'COMPLETED' ELSE 'FAILED' END
              WHEN fin = 'FAILED' THEN 'FAILED' WHEN fin = 'STOPPED' THEN 'CANCELLED'
              WHEN ran IS NOT NULL THEN 'RUNNING' ELSE 'PENDING' END AS status,
              CASE WHEN closed IS NULL OR ran < closed THEN ran_ts END AS started_at
            FROM c LEFT JOIN f ON f.job_id = c.job_id""",
        ),
    ),
    "latest_job_state": Query(
        lambda t: batch.latest_job_state(t.job_events),
        with_views(
            "job_events",
            sql="""SELECT job_id, arg_max(ray_status, seq) AS status, min(ts) AS submitted_at, max(ts) AS updated_at
            FROM job_events GROUP BY 1 ORDER BY submitted_at DESC""",
        ),
    ),
    "session_buckets": Query(
        lambda t: batch.session_buckets(batch.latest_job_state(t.job_events)),
        with_views(
            "job_events",
            sql="""SELECT count(*) AS total, count(*) FILTER (s IN ('RUNNING','PENDING')) AS active,
            count(*) FILTER (s IN ('SUCCEEDED','COMPLETED')) AS succeeded,
            count(*) FILTER (s IN ('FAILED','STOPPED','CANCELLED')) AS failed
            FROM (SELECT arg_max(ray_status, seq) AS s FROM job_events GROUP BY job_id)""",
        ),
    ),
    "attempt_number": Query(
        lambda t: batch.attempt_number(t.dispatch_events).select("job_id", "seq", "attempt"),
        with_views(
            "dispatch_events",
            sql="""SELECT job_id, seq, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS attempt
            FROM dispatch_events WHERE kind = 'route'""",
        ),
    ),
    "token_cost": Query(
        lambda t: batch.token_cost(t.token_jobs),
        with_views(
            "token_jobs",
            sql="""SELECT count(*) AS job_count, CAST(sum(input_tokens) AS BIGINT) AS total_prefill_tokens,
            CAST(sum(output_tokens) AS BIGINT) AS total_decode_tokens,
            round(sum((input_tokens * 1.5::DOUBLE + output_tokens * 18.0::DOUBLE) / 1000.0::DOUBLE), 6) AS total_cost_s FROM token_jobs""",
        ),
    ),
    "request_to_wire": Query(
        _wire,
        f"""WITH {TURNS_SQL} SELECT request_id, '{MODEL}' AS model, text AS content,
        CASE WHEN conv_id % 3 = 1 THEN 64 WHEN turn = 3 THEN 100 ELSE 512 END AS max_tokens,
        0.7::DOUBLE AS temperature, 1.0::DOUBLE AS top_p, 1 AS n, 'false' AS stream,
        CASE WHEN turn % 2 = 0 THEN '["END"]' END AS stop, CASE WHEN conv_id % 3 = 1 THEN 7 END AS seed,
        CASE WHEN conv_id % 3 = 2 THEN 40 END AS top_k, CASE WHEN conv_id % 3 = 2 THEN 2 END AS note FROM turns""",
    ),
    "response_from_wire": Query(
        _responses,
        f"""WITH {TURNS_SQL}, {RESPONSE_SQL} SELECT request_id, id, 'chat.completion' AS object, created, model,
        CASE WHEN turn % 3 <> 0 THEN 1 ELSE 0 END AS n_choices, CASE WHEN turn % 3 <> 0 THEN text END AS content,
        CASE WHEN turn % 3 <> 0 THEN CASE WHEN turn % 2 = 1 THEN 'length' ELSE 'stop' END END AS finish_reason,
        total_tokens, 'alpha' AS served_by FROM responses""",
    ),
    "record_online": Query(
        _online,
        f"""WITH {TURNS_SQL}, {RESPONSE_SQL} SELECT id AS request_id, created AS timestamp, '{MODEL}' AS model_name,
        text AS content, round(turn * 1.5::DOUBLE, 6) AS latency_ms, prompt_tokens, completion_tokens, total_tokens FROM responses""",
    ),
    "record_stream": Query(
        _stream_records,
        f"""WITH {TURNS_SQL} SELECT request_id, {STREAM_EPOCH} - 1 + conv_id AS timestamp, '{MODEL}' AS model_name, text AS content,
        turn * 2.0::DOUBLE AS latency_ms, 0::BIGINT AS prompt_tokens, 0::BIGINT AS completion_tokens, 0::BIGINT AS total_tokens,
        CAST(len(string_split(text, ' ')) + 1 AS INTEGER) AS events FROM turns""",
    ),
    "record_offline": Query(
        lambda t: _flat_records(offline_records(t).withColumn("error", F.get_json_object("output_response", "$.error")), "job_id", "error"),
        with_views("batch_items", sql=f"WITH {OFFLINE_SQL} SELECT * FROM records"),
    ),
    "record_key": Query(
        lambda t: offline_records(t).select(batch.record_key(F.col("request_id"), F.col("metadata")).alias("key"))
        .unionByName(batch.record_online(response_bodies(t).select(
            "model", "messages", wire.response_from_wire(F.col("body")).alias("response"), F.lit(0.0).alias("latency_ms"),
        )).select(batch.record_key(F.col("request_id"), F.col("metadata")).alias("key"))),
        with_views(
            "batch_items",
            sql=f"""WITH {OFFLINE_SQL}, {TURNS_SQL}, {RESPONSE_SQL}
            SELECT concat('outputs/offline/ray_job_', job_id, '/', request_id, '.json') AS key FROM records
            UNION ALL SELECT concat('outputs/online/', id, '.json') FROM responses""",
        ),
    ),
    "sse_transcripts": Query(_transcripts, TRANSCRIPT_SQL),
    "batch_infer": Query(
        _inferred,
        f"""WITH {INFERRED_SQL}
        SELECT c.request_id AS custom_id, c.size, CASE WHEN won IS NOT NULL THEN ['alpha','beta','gamma'][b.i + 1] END AS node,
          CAST(won AS INTEGER) AS attempt, CASE WHEN won IS NULL THEN concat('http://', ['alpha','beta','gamma'][last + 1], '/v1 refused ', c.size) END AS error,
          CASE WHEN won IS NOT NULL THEN '{MODEL}' END AS model
        FROM c LEFT JOIN b ON b.request_id = c.request_id AND b.k = c.won""",
    ),
}
