"""Batch jobs: items, results, counts, status folding and completion records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.status import item_succeeded
from fleetlens.operators.scan import by_number, row_index
from fleetlens.operators.transcripts import ordered_concat

# Job states and the cost model in milliseconds per token.
ACTIVE = ("RUNNING", "PENDING")
SUCCEEDED = ("SUCCEEDED", "COMPLETED")
FAILED = ("FAILED", "STOPPED", "CANCELLED")
TERMINAL = ("SUCCEEDED", "FAILED", "STOPPED")
PREFILL_MS = 1.5
DECODE_MS = 18.0


def items_with_results(items: DataFrame, results: DataFrame) -> DataFrame:
    """Items with their results by (job, ordinal); items without a result stay pending."""
    found = results.select("job_id", "ordinal", "response", "error")
    return items.join(found, ["job_id", "ordinal"], "left")


def batch_counts(items: DataFrame, response: str = "response", by: Sequence[str] = ("job_id",)) -> DataFrame:
    """Total, completed, failed and pending items per job."""
    got, err = F.col(response), F.col("error")
    return items.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(item_succeeded(got, err)).alias("completed"),
        F.count_if(err.isNotNull()).alias("failed"),
        F.count_if(got.isNull() & err.isNull()).alias("pending"),
    )


def batch_final_status(counts: DataFrame) -> DataFrame:
    """Status of finished jobs: completed only without failed items."""
    return counts.withColumn(
        "status", F.when(F.col("failed") == 0, "COMPLETED").otherwise("FAILED")
    )


def job_state_fold(job_events: DataFrame, counts: DataFrame) -> DataFrame:
    """Final status and start time per job from its scheduler events.

    The last of the terminal events decides; success is judged by the job's items.
    Running counts only before any terminal event, and its first occurrence starts the job.
    """
    status = F.col("ray_status")
    order = F.struct("ts", "seq")
    terminal = status.isin(*TERMINAL)
    folded = job_events.groupBy("job_id").agg(
        F.max_by("ray_status", F.when(terminal, order)).alias("__end"),
        F.min(F.when(terminal, order)).alias("__closed"),
        F.min(F.when(status == "RUNNING", order)).alias("__ran"),
    )
    started = F.when(
        F.col("__closed").isNull() | (F.col("__ran") < F.col("__closed")), F.col("__ran.ts")
    )
    failed_items = F.coalesce(F.col("failed"), F.lit(0))
    return folded.join(counts.select("job_id", "failed"), "job_id", "left").select(
        "job_id",
        F.when(F.col("__end") == "SUCCEEDED", F.when(failed_items == 0, "COMPLETED").otherwise("FAILED"))
        .when(F.col("__end") == "FAILED", "FAILED")
        .when(F.col("__end") == "STOPPED", "CANCELLED")
        .when(F.col("__ran").isNotNull(), "RUNNING")
        .otherwise("PENDING")
        .alias("status"),
        started.alias("started_at"),
    )


def latest_job_state(job_events: DataFrame, key: str = "job_id") -> DataFrame:
    """Newest status per job, newest job first by its first event."""
    order = F.struct("ts", "seq")
    return (
        job_events.groupBy(key)
        .agg(
            F.max_by("ray_status", order).alias("status"),
            F.min("ts").alias("submitted_at"),
            F.max("ts").alias("updated_at"),
        )
        .orderBy(F.col("submitted_at").desc(), F.col(key).desc())
    )


def session_buckets(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Total, active, succeeded and failed jobs."""
    status = F.upper("status")
    return states.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(status.isin(*ACTIVE)).alias("active"),
        F.count_if(status.isin(*SUCCEEDED)).alias("succeeded"),
        F.count_if(status.isin(*FAILED)).alias("failed"),
    )


def attempt_number(dispatch: DataFrame, job: str = "job_id", chunk: int = 65536) -> DataFrame:
    """Number of each dispatch within its job, retries included."""
    routes = dispatch.where(F.col("kind") == "route")
    return row_index(routes, [job], [F.col("seq")], by_number(F.col("seq"), chunk), "attempt")


def token_cost(
    jobs: DataFrame, by: Sequence[str] = (), *, prefill_ms: float = PREFILL_MS, decode_ms: float = DECODE_MS
) -> DataFrame:
    """Job count, token totals and modelled seconds."""
    cost = (F.col("input_tokens") * prefill_ms + F.col("output_tokens") * decode_ms) / 1000.0
    return jobs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("job_count"),
        F.sum("input_tokens").alias("total_prefill_tokens"),
        F.sum("output_tokens").alias("total_decode_tokens"),
        F.sum(cost).alias("total_cost_s"),
    )


def _record(
    request_id: Column, timestamp: Column, output: Column, latency: Column, tokens: Sequence[Column], metadata: Column
) -> list[Column]:
    prompt, completion, total = tokens
    return [
        request_id.alias("request_id"),
        timestamp.cast("long").alias("timestamp"),
        F.col("model").alias("model_name"),
        F.col("messages").alias("input_messages"),
        output.alias("output_response"),
        latency.cast("double").alias("latency_ms"),
        prompt.cast("long").alias("prompt_tokens"),
        completion.cast("long").alias("completion_tokens"),
        total.cast("long").alias("total_tokens"),
        metadata.alias("metadata"),
    ]


def _no_metadata() -> Column:
    return F.create_map().cast("map<string,string>")


def _usage(response: Column) -> list[Column]:
    usage = response["usage"]
    return [usage["prompt_tokens"], usage["completion_tokens"], usage["total_tokens"]]


def record_online(calls: DataFrame) -> DataFrame:
    """Completion records of answered requests.

    ``calls`` has model, messages, response (typed struct) and latency_ms.
    """
    response = F.col("response")
    return calls.select(
        *_record(
            response["id"], response["created"], F.to_json(response), F.col("latency_ms"), _usage(response), _no_metadata()
        )
    )


def record_stream(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """Records of streamed requests: the raw stream as text, no token counts.

    ``requests`` has request_id, timestamp, model, messages and latency_ms.
    """
    raw = ordered_concat(chunks, ["request_id"], "seq", "chunk", "raw_stream")
    none = F.lit(0)
    return requests.join(raw, "request_id", "left").select(
        *_record(
            F.col("request_id"),
            F.col("timestamp"),
            F.to_json(F.struct(F.coalesce("raw_stream", F.lit("")).alias("raw_stream"))),
            F.col("latency_ms"),
            [none, none, none],
            _no_metadata(),
        )
    )


def record_offline(items: DataFrame) -> DataFrame:
    """Records of batch items, errors included.

    ``items`` has job_id, submission_id, model, messages, response, error and
    finished_at (epoch seconds), used when there is no response.
    """
    response = F.col("response")
    answered = response.isNotNull()

    def tokens(column: Column) -> Column:
        return F.when(answered, column).otherwise(0)

    return items.select(
        "job_id",
        *_record(
            F.when(answered, response["id"]).otherwise(F.concat(F.lit("err-"), F.col("job_id"))),
            F.when(answered, response["created"]).otherwise(F.col("finished_at")),
            F.when(answered, F.to_json(response)).otherwise(F.to_json(F.struct(F.col("error").alias("error")))),
            F.lit(0.0),
            [tokens(c) for c in _usage(response)],
            F.create_map(F.lit("ray_job_id"), F.col("submission_id")),
        ),
    )


def record_key(request_id: Column, metadata: Column) -> Column:
    """Storage key of a record: by job when it came from one, else online."""
    job = F.replace(metadata["ray_job_id"], F.lit("raysubmit_"), F.lit("ray_job_"))
    return F.when(
        F.map_contains_key(metadata, "ray_job_id"),
        F.concat(F.lit("outputs/offline/"), job, F.lit("/"), request_id, F.lit(".json")),
    ).otherwise(F.concat(F.lit("outputs/online/"), request_id, F.lit(".json")))
