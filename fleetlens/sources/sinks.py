"""Writers: batch files, records, logs, metrics and events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.functions.status import is_routable, success_flag
from fleetlens.operators.batch import record_key
from fleetlens.operators.scan import int_chunk
from fleetlens.schemas import COMPLETION_RECORDS

BUCKETS = 64
ITEMS_PER_LINE = 256


def write_batch_lines(df: DataFrame, path: str, keys: list[str], order: str, size: int = ITEMS_PER_LINE) -> None:
    """JSON arrays of at most ``size`` consecutive rows per line.

    The size bounds a line whatever the job's share of the rows, so files stay splittable.
    """
    fields = [c for c in df.columns if c not in ("__slice",)]
    arrays = (
        df.withColumn("__slice", int_chunk(F.col(order), size))
        .groupBy(*keys, "__slice")
        .agg(F.to_json(F.collect_list(F.struct(*fields))).alias("value"))
    )
    arrays.select("value").write.text(path)


def _job(metadata: Column) -> Column:
    return F.replace(metadata["ray_job_id"], F.lit("raysubmit_"), F.lit("ray_job_"))


def _bucket(name: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(name, F.lit(""))), F.lit(buckets)).cast("int")


def write_records(records: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Completion records as JSON, foldered by channel and bucket.

    Each record keeps the key it would have as a single object. Buckets rather than one folder per job
    keep the number of folders bounded: offline records go by job, online ones, which have none, by request.
    Adaptive execution splits large buckets among tasks, so the number of tasks follows the data, whatever
    a job's share is. A table is read with the number of buckets it was written with. Records repeat their
    fields' names and much else, so the files are compressed; readers see that by their names.
    """
    job = _job(F.col("metadata"))
    laid_out = records.select(
        "*",
        record_key(F.col("request_id"), F.col("metadata")).alias("key"),
        job.alias("job"),
        F.when(job.isNull(), "online").otherwise("offline").alias("channel"),
        _bucket(F.coalesce(job, F.col("request_id")), buckets).alias("bucket"),
    )
    dealt = laid_out.hint("rebalance", "channel", "bucket")
    dealt.write.mode("append").partitionBy("channel", "bucket").option("compression", "gzip").json(path)


def read_records(spark: SparkSession, path: str, job: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Records back from the folders; a job's records come from its bucket alone."""
    schema = f"{COMPLETION_RECORDS}, key string, job string, channel string, bucket int"
    rows = spark.read.schema(schema).json(path)
    if job is None:
        return rows
    own = _bucket(F.lit(job), buckets)
    return rows.where((F.col("channel") == "offline") & (F.col("bucket") == own) & (F.col("job") == job))


def write_logs(logs: DataFrame, path: str, order: Sequence[str] = ("seq",)) -> None:
    """Log text under ``logs/filename=...``; ``logs`` has filename, text and the columns of ``order``.

    Texts of a file are written in that order, a file that has been written before is replaced. Ranges of (file, order) are dealt to
    tasks: a large file is in several parts whose names sort as their lines do, and there are no more parts than files and tasks.
    """
    along = ["filename", *order]
    sorted_ = logs.select("filename", *order, F.col("text").alias("value")).repartitionByRange(*along).sortWithinPartitions(*along)
    writer = sorted_.select("filename", "value").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("filename").option("lineSep", "\n").text(f"{path}/logs")


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """``(filename, line, value)``: every line with its number in its file, from 1.

    Lines are counted per byte range of a part; the counts, one for each range, are summed along the file.
    """
    rows = spark.read.option("lineSep", "\n").text(f"{path}/logs").select(
        "filename", F.col("_metadata.file_name").alias("part"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), "value",
    )
    place = ["filename", "part", "block"]
    along = Window.partitionBy("filename").orderBy("part", "block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy(*place).agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(along), F.lit(0)))
    here = F.row_number().over(Window.partitionBy(*place).orderBy("row"))
    numbered = rows.withColumn("here", here).join(ranges.drop("n"), place)
    return numbered.select("filename", (F.col("before") + F.col("here")).alias("line"), "value")


def _datum(metric: str, value: Column, unit: str = "None") -> Column:
    return F.struct(F.lit(metric).alias("metric"), value.cast("double").alias("value"), F.lit(unit).alias("unit"))


def gateway_datums(requests: DataFrame) -> DataFrame:
    """Three metric samples per request: count, availability and latency."""
    return requests.select(
        "ts",
        "node",
        F.inline(
            F.array(
                _datum("request_count", F.lit(1.0)),
                _datum("availability", success_flag(F.col("status"))),
                _datum("latency_ms", F.col("latency_ms"), "Milliseconds"),
            )
        ),
    )


def batch_datums(jobs: DataFrame, ts: str = "created_at") -> DataFrame:
    """Two metric samples per finished job: count and reliability."""
    done = (F.upper("status") == "COMPLETED").cast("double")
    return jobs.select(
        F.col(ts).alias("ts"),
        F.lit(None).cast("int").alias("node"),
        F.inline(F.array(_datum("batch_job_count", F.lit(1.0)), _datum("batch_reliability", done))),
    )


def rto_datums(retries: DataFrame) -> DataFrame:
    """One metric sample per measured time to retry."""
    return retries.select(
        "ts", "node", F.inline(F.array(_datum("failover_rto_seconds", F.col("elapsed_seconds"), "Seconds")))
    )


def write_metrics(samples: DataFrame, path: str) -> None:
    """Append metric samples as Parquet, foldered by metric for pruning."""
    samples.write.mode("append").partitionBy("metric").parquet(path)


def event_lines(events: DataFrame) -> DataFrame:
    """Structured events as JSON text with the time in epoch milliseconds."""
    fields = [F.col(c) for c in events.columns if c != "ts"]
    message = F.to_json(F.struct(*fields))
    return events.select(
        F.to_json(F.struct(F.unix_millis("ts").alias("timestamp"), message.alias("message"))).alias("value")
    )


def write_events(events: DataFrame, path: str) -> None:
    event_lines(events).write.mode("append").text(path)


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    line = F.from_json("value", "timestamp bigint, message string")
    return spark.read.text(path).select(line.alias("l")).select(
        F.timestamp_millis("l.timestamp").alias("ts"), F.from_json("l.message", schema).alias("e")
    ).select("ts", "e.*")


def _plain(value: Column) -> Column:
    """Text of a double with all its digits; from 1e16 and under 1e-12 in exponent form."""
    fixed = F.regexp_replace(value.cast("decimal(38,20)").cast("string"), r"(\.\d+?)0+$", "$1")
    size = F.abs(value)
    plain = ((size >= 1e7) & (size < 1e16)) | ((size >= 1e-12) & (size < 1e-3))
    return F.when(plain, fixed).otherwise(F.replace(value.cast("string"), F.lit("E"), F.lit("e")))


def metrics_exposition(
    router: DataFrame, sla_p95_target_ms: float = 30000.0, scope: tuple[str, ...] = ("cluster_id",)
) -> DataFrame:
    """Node metrics as a long table with the text line of each, plus the target per scope."""
    counters = ("jobs_total", "jobs_failed", "respawns", "inflight")
    gauges = {
        "router_latency_ms": F.col("last_latency_ms"),
        "router_status": is_routable(F.col("status")).cast("double"),
        "router_readiness": F.col("readiness_ok").cast("double"),
        "router_sla_ok": F.col("sla_ok").cast("double"),
        "router_latency_p50_ms": F.col("latency_p50_ms"),
        "router_latency_p95_ms": F.col("latency_p95_ms"),
        "router_latency_p99_ms": F.col("latency_p99_ms"),
        "router_last_check_seconds": F.col("last_check"),
    }

    def row(metric: str, value: Column, text: Column) -> Column:
        return F.struct(F.lit(metric).alias("metric"), value.cast("double").alias("value"), text.alias("text"))

    rows = [row(f"router_{c}", F.col(c), F.col(c).cast("string")) for c in counters]
    rows += [row(name, value, _plain(value.cast("double"))) for name, value in gauges.items()]
    line = F.concat(F.col("metric"), F.lit('{node="'), F.col("node"), F.lit('"} '), F.col("text"))
    per_node = router.select(*scope, F.col("name").alias("node"), F.inline(F.array(*rows))).select(
        *scope, "node", "metric", "value", line.alias("line")
    )
    target = F.lit(float(sla_p95_target_ms))
    shared = router.select(*scope).distinct().select(
        *scope,
        F.lit(None).cast("string").alias("node"),
        F.lit("router_sla_p95_target_ms").alias("metric"),
        target.alias("value"),
        F.concat(F.lit("router_sla_p95_target_ms "), _plain(target)).alias("line"),
    )
    return per_node.unionByName(shared)
