"""File queries: tables written in a format and read back through its reader."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.operators.incidents import failover_rto
from fleetlens.operators import inference
from fleetlens.operators.batch import items_with_results, record_offline, record_online
from fleetlens.operators.scan import int_chunk
from fleetlens.plans.batch import (
    INFERRED_SQL, MODEL, NODES, OFFLINE_SQL, RESPONSE_SQL, TURNS_SQL, answer, offline_records, response_bodies, turns,
)
from fleetlens.schemas import WIRE_RESPONSE
from fleetlens.plans.fixtures import Tables, with_views
from fleetlens.plans.registry import Query
from fleetlens.plans.requests import RTO_SQL
from fleetlens.functions import wire
from fleetlens.sources import readers, sinks
from fleetlens.sources.workdir import fresh_dir


def _batch_input(t: Tables) -> DataFrame:
    path = fresh_dir(t.spark, "batch-input")
    request = F.struct("model", "messages", F.lit(256).alias("max_tokens"), F.lit(0.5).alias("temperature"))
    items = turns(t).select("conv_id", "turn", F.col("request_id").alias("custom_id"), request.alias("request"))
    sinks.write_batch_lines(items, path, ["conv_id"], "turn")
    return readers.read_batch_input(t.spark, path).select(
        "custom_id",
        F.col("request.model").alias("model"),
        F.col("request.messages")[0]["content"].alias("content"),
        F.col("request.max_tokens").alias("max_tokens"),
        F.col("request.temperature").alias("temperature"),
        F.col("request.stop").isNull().alias("no_stop"),
    )


def _batch_output(t: Tables) -> DataFrame:
    path = fresh_dir(t.spark, "batch-output")
    usage = F.struct(F.col("prompt_tokens").cast("long").alias("prompt_tokens"))
    response = F.struct(F.col("response_id").alias("id"), usage.alias("usage"))
    rows = t.batch_items.select(
        "job_id", "ordinal", F.when(F.col("response_id").isNotNull(), response).alias("response"), "error"
    )
    sinks.write_batch_lines(rows, path, ["job_id"], "ordinal")
    return readers.read_batch_output(t.spark, path).select(
        "job_id",
        "ordinal",
        F.col("response.id").alias("response_id"),
        F.col("response.usage.prompt_tokens").alias("prompt_tokens"),
        "error",
    )


def _batch_chain(t: Tables) -> DataFrame:
    """A batch from its input file through inference and its output file to the records of its jobs."""
    requests, results = fresh_dir(t.spark, "chain-input"), fresh_dir(t.spark, "chain-output")
    asked = turns(t).select("conv_id", "turn", F.col("request_id").alias("custom_id"), F.struct("model", "messages").alias("request"))
    sinks.write_batch_lines(asked, requests, ["conv_id"], "turn")
    part = F.split("custom_id", "-")
    items = readers.read_batch_input(t.spark, requests).select(
        part[0].cast("long").alias("job_id"), part[1].cast("long").alias("ordinal"), "custom_id", F.col("body").alias("request"),
        F.col("request.messages").alias("messages"), F.col("request.model").alias("model"),
    )
    done = inference.batch_infer(items.select("job_id", "ordinal", "custom_id", "request"), answer, NODES, max_attempts=2)
    served = F.struct("node", "url", "attempt").alias("_served_by")
    response = F.struct(F.from_json("response", WIRE_RESPONSE).alias("r"))["r"]
    whole = F.struct(*[response[f].alias(f) for f in ("id", "created", "model", "choices", "usage")], served)
    written = done.select("job_id", "ordinal", F.when(F.col("response").isNotNull(), whole).alias("response"), "error")
    sinks.write_batch_lines(written, results, ["job_id"], "ordinal")
    merged = items_with_results(items, readers.read_batch_output(t.spark, results))
    records = record_offline(
        merged.select(
            "job_id", F.concat(F.lit("raysubmit_"), "job_id").alias("submission_id"), "model", "messages", "response", "error",
            F.lit(5).cast("long").alias("finished_at"),
        )
    )
    output = F.col("output_response")
    by = F.get_json_object(output, "$.served_by")
    return records.select(
        "job_id", "request_id", F.col("input_messages")[0]["content"].alias("prompt"), "timestamp", "total_tokens",
        F.get_json_object(output, "$.choices[0].message.content").alias("answer"), F.get_json_object(by, "$.node").alias("node"),
        F.get_json_object(by, "$.attempt").cast("int").alias("attempt"), F.get_json_object(output, "$.error").alias("error"),
    )


def _token_csv(t: Tables) -> DataFrame:
    path = fresh_dir(t.spark, "tokens")
    t.token_jobs.write.option("header", True).csv(path)
    return readers.read_token_csv(t.spark, path)


def _node_documents(t: Tables) -> DataFrame:
    entry = F.struct(
        "ordinal", "node_id", "node_ip", "node_name", "state", "is_head_node", F.col("resources").alias("resources_total")
    )
    listed = F.collect_list(entry)
    return (
        t.nodes.groupBy("cluster_id")
        .agg(listed.alias("__l"))
        .select(
            "cluster_id",
            F.lit(0).alias("snapshot_ts"),
            F.to_json(F.struct(F.struct(F.struct(F.col("__l").alias("result")).alias("result")).alias("data"))).alias("body"),
        )
    )


def _snapshot_nodes(t: Tables) -> DataFrame:
    path = fresh_dir(t.spark, "nodes")
    _node_documents(t).write.json(path)
    nodes = readers.nodes_from_snapshots(readers.read_snapshots(t.spark, path))
    return nodes.select(
        "cluster_id", "node_id", "node_ip", "node_name", "state", "is_head_node", F.map_keys("resources")[0].alias("resource_key")
    )


def _serve_documents(t: Tables) -> DataFrame:
    """Serve documents, a snapshot for each range of replica ids."""
    entry = F.struct("replica_id", "node_id", "node_ip", "state", "log_file_path")
    deployment = F.create_map(
        F.lit("workers"), F.struct(F.lit("UPDATING").alias("status"), F.col("__l").alias("replicas"))
    )
    apps = F.create_map(F.lit("model"), F.struct(F.lit("RUNNING").alias("status"), deployment.alias("deployments")))
    return (
        t.replicas.groupBy("cluster_id", int_chunk(F.col("replica_id"), 1024).alias("snapshot_ts"))
        .agg(F.collect_list(entry).alias("__l"))
        .select("cluster_id", "snapshot_ts", F.to_json(F.struct(apps.alias("applications"))).alias("body"))
    )


def _snapshot_replicas(t: Tables) -> DataFrame:
    path = fresh_dir(t.spark, "serve")
    _serve_documents(t).write.json(path)
    docs = readers.read_snapshots(t.spark, path)
    return readers.replicas_from_snapshots(docs, "model", "workers").drop("ordinal", "snapshot_ts")


def _snapshot_statuses(t: Tables) -> DataFrame:
    path = fresh_dir(t.spark, "serve")
    _serve_documents(t).write.json(path)
    return readers.statuses_from_snapshots(readers.read_snapshots(t.spark, path))


def _usage_documents(t: Tables) -> DataFrame:
    pair = F.array(F.lit(0.0), F.lit(1.0))
    resource = F.map_keys("resources")[0]
    named = F.create_map(resource, pair, F.concat(F.lit("node:"), "node_ip"), pair)
    usage = F.when(F.col("state") == "ALIVE", named).otherwise(F.create_map(resource, pair))
    by_node = F.map_from_entries(F.collect_list(F.struct("node_id", usage.alias("u"))))
    total = F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("node:"), "node_ip").alias("k"), pair.alias("v"))))
    report = F.struct(F.col("__t").alias("usage"), F.col("__b").alias("usageByNode"))
    body = F.struct(F.struct(F.struct(report.alias("loadMetricsReport")).alias("clusterStatus")).alias("data"))
    return (
        t.nodes.groupBy("cluster_id")
        .agg(by_node.alias("__b"), total.alias("__t"))
        .select("cluster_id", F.lit(0).alias("snapshot_ts"), F.to_json(body).alias("body"))
    )


def _usage(t: Tables) -> DataFrame:
    path = fresh_dir(t.spark, "usage")
    _usage_documents(t).write.json(path)
    found = readers.usage_by_node(readers.read_snapshots(t.spark, path))
    return found.select("cluster_id", "node_id", "node_ip", F.array_join("resource_keys", ",").alias("resource_keys"))


def _usage_keys(t: Tables) -> DataFrame:
    path = fresh_dir(t.spark, "usage")
    _usage_documents(t).write.json(path)
    return readers.usage_keys(readers.read_snapshots(t.spark, path)).drop("snapshot_ts")


def _access_log(t: Tables) -> DataFrame:
    path = fresh_dir(t.spark, "access")
    line = F.to_json(
        F.struct(
            F.col("request_id").cast("string").alias("requestId"),
            F.col("api_key_id").cast("string").alias("apiKeyId"),
            F.lit("10.0.0.1").alias("ip"),
            F.date_format("ts", readers.REQUEST_TIME).alias("requestTime"),
            F.lit("POST").alias("httpMethod"),
            F.lit("/v1/chat/completions").alias("resourcePath"),
            F.col("status").cast("string").alias("status"),
            F.when(F.col("status") == 200, F.lit("-")).otherwise(F.lit("17")).alias("responseLength"),
            F.col("latency_ms").cast("string").alias("latency"),
        )
    )
    t.requests.select(line.alias("value")).write.text(path)
    return readers.read_access_log(t.spark, path)


def _records(t: Tables) -> DataFrame:
    path = fresh_dir(t.spark, "records")
    online = record_online(
        response_bodies(t).select(
            "model", "messages", wire.response_from_wire(F.col("body")).alias("response"), F.col("turn").alias("latency_ms")
        )
    )
    sinks.write_records(offline_records(t).drop("job_id").unionByName(online), path)
    return sinks.read_records(t.spark, path).select(
        "channel", "key", "request_id", "timestamp", "total_tokens", "latency_ms"
    )


def _logs(t: Tables) -> DataFrame:
    path = fresh_dir(t.spark, "logs")
    sinks.write_logs(t.documents.select(F.concat("lang", F.lit(".log")).alias("filename"), "text", "doc_id"), path, ["doc_id"])
    return sinks.read_logs(t.spark, path)


def _metrics(t: Tables) -> DataFrame:
    path = fresh_dir(t.spark, "metrics")
    sinks.write_metrics(sinks.gateway_datums(t.requests), path)
    sinks.write_metrics(sinks.batch_datums(t.batch_jobs), path)
    sinks.write_metrics(sinks.rto_datums(failover_rto(t.ops_events)), path)
    return t.spark.read.parquet(path)


def _events(t: Tables) -> DataFrame:
    path = fresh_dir(t.spark, "events")
    sinks.write_events(t.ops_events.select("ts", "seq", "event", "node"), path)
    return sinks.read_events(t.spark, path, "seq bigint, event string, node int")


QUERIES = {
    "src_batch_input": Query(
        _batch_input,
        f"""WITH {TURNS_SQL} SELECT request_id AS custom_id, '{MODEL}' AS model, text AS content, 256 AS max_tokens,
        0.5::DOUBLE AS temperature, true AS no_stop FROM turns""",
    ),
    "src_batch_output": Query(
        _batch_output,
        with_views(
            "batch_items",
            sql="""SELECT job_id, ordinal, response_id, CASE WHEN response_id IS NOT NULL THEN prompt_tokens::BIGINT END AS prompt_tokens,
            error FROM batch_items""",
        ),
    ),
    "batch_chain": Query(
        _batch_chain,
        f"""WITH {INFERRED_SQL}
        SELECT t.conv_id AS job_id, CASE WHEN won IS NULL THEN concat('err-', t.conv_id) ELSE concat('chatcmpl-', size) END AS request_id,
          t.text AS prompt, CASE WHEN won IS NULL THEN 5 ELSE size END::BIGINT AS timestamp,
          CASE WHEN won IS NULL THEN 0 ELSE size + 1 END::BIGINT AS total_tokens, CASE WHEN won IS NOT NULL THEN concat('Re: ', left(t.text, 20)) END AS answer,
          CASE WHEN won IS NOT NULL THEN ['alpha','beta','gamma'][b.i + 1] END AS node, CAST(won AS INTEGER) AS attempt,
          CASE WHEN won IS NULL THEN concat('http://', ['alpha','beta','gamma'][last + 1], '/v1 refused ', size) END AS error
        FROM c JOIN turns t ON t.request_id = c.request_id LEFT JOIN (SELECT request_id, k, i FROM b) b ON b.request_id = c.request_id AND b.k = c.won""",
    ),
    "src_token_csv": Query(_token_csv, with_views("token_jobs", sql="SELECT * FROM token_jobs")),
    "src_cluster_snapshot": Query(
        _snapshot_nodes,
        with_views("nodes", sql="SELECT cluster_id, node_id, node_ip, node_name, state, is_head_node, resource_key FROM nodes"),
    ),
    "src_cluster_snapshot_replicas": Query(
        _snapshot_replicas,
        with_views(
            "replicas",
            sql="SELECT cluster_id, CAST(replica_id AS VARCHAR) AS replica_id, node_id, node_ip, state, log_file_path FROM replicas",
        ),
    ),
    "src_cluster_snapshot_statuses": Query(
        _snapshot_statuses,
        with_views(
            "replicas",
            sql="""SELECT cluster_id, snapshot_ts, 'model' AS app, unnest(['RUNNING', 'UPDATING']) AS status
            FROM (SELECT DISTINCT cluster_id, replica_id // 1024 AS snapshot_ts FROM replicas)""",
        ),
    ),
    "src_usage_by_node": Query(
        _usage,
        with_views(
            "nodes",
            sql="""SELECT cluster_id, node_id, CASE WHEN state = 'ALIVE' THEN node_ip ELSE 'unknown' END AS node_ip,
            CASE WHEN state = 'ALIVE' THEN concat(resource_key, ',node:', node_ip)
              ELSE resource_key END AS resource_keys FROM nodes""",
        ),
    ),
    "src_usage_keys": Query(
        _usage_keys, with_views("nodes", sql="SELECT cluster_id, concat('node:', node_ip) AS key FROM nodes")
    ),
    "src_access_log": Query(
        _access_log,
        with_views(
            "requests",
            sql="""SELECT CAST(request_id AS VARCHAR) AS request_id, date_trunc('second', ts) AS ts, CAST(api_key_id AS VARCHAR) AS api_key_id,
            '10.0.0.1' AS ip, 'POST' AS method, '/v1/chat/completions' AS path, status,
            CASE WHEN status <> 200 THEN 17::BIGINT END AS response_length, round(latency_ms, 6) AS latency_ms FROM requests""",
        ),
    ),
    "sink_records": Query(
        _records,
        with_views(
            "batch_items",
            sql=f"""WITH {OFFLINE_SQL}, {TURNS_SQL}, {RESPONSE_SQL}
            SELECT 'offline' AS channel, concat('outputs/offline/ray_job_', job_id, '/', request_id, '.json') AS key, request_id,
              timestamp, total_tokens, latency_ms FROM records
            UNION ALL SELECT 'online', concat('outputs/online/', id, '.json'), id, created, total_tokens, turn::DOUBLE FROM responses""",
        ),
    ),
    "sink_logs": Query(
        _logs,
        r"""WITH d AS (SELECT concat(lang, '.log') AS filename, doc_id, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS lines FROM documents),
        u AS (SELECT filename, doc_id, unnest(lines) AS value, unnest(range(1, len(lines) + 1)) AS pos FROM d)
        SELECT filename, row_number() OVER (PARTITION BY filename ORDER BY doc_id, pos) AS line, value FROM u""",
    ),
    "sink_metrics": Query(
        _metrics,
        with_views(
            "requests",
            "batch_jobs",
            "ops_events",
            sql=f"""SELECT ts, node, 'request_count' AS metric, 1.0::DOUBLE AS value, 'None' AS unit FROM requests
            UNION ALL SELECT ts, node, 'availability', CASE WHEN status IN (200,201,302) THEN 1.0 ELSE 0.0 END, 'None' FROM requests
            UNION ALL SELECT ts, node, 'latency_ms', round(latency_ms, 6), 'Milliseconds' FROM requests
            UNION ALL SELECT created_at, NULL, 'batch_job_count', 1.0, 'None' FROM batch_jobs
            UNION ALL SELECT created_at, NULL, 'batch_reliability', CASE WHEN status = 'completed' THEN 1.0 ELSE 0.0 END, 'None' FROM batch_jobs
            UNION ALL SELECT ts, node, 'failover_rto_seconds', round(elapsed_seconds, 6), 'Seconds' FROM ({RTO_SQL})""",
        ),
    ),
    "sink_events": Query(
        _events,
        with_views("ops_events", sql="SELECT make_timestamp((epoch_us(ts) // 1000) * 1000) AS ts, seq, event, node FROM ops_events"),
    ),
    "metrics_exposition": Query(
        lambda t: sinks.metrics_exposition(t.router_snapshot).select("cluster_id", "node", "metric", "value", "line"),
        with_views(
            "router_snapshot",
            sql="""WITH m AS (SELECT cluster_id, name AS node, unnest([
                {'m': 'router_jobs_total', 'v': jobs_total::DOUBLE, 't': jobs_total::VARCHAR},
                {'m': 'router_jobs_failed', 'v': jobs_failed::DOUBLE, 't': jobs_failed::VARCHAR},
                {'m': 'router_respawns', 'v': respawns::DOUBLE, 't': respawns::VARCHAR},
                {'m': 'router_inflight', 'v': inflight::DOUBLE, 't': inflight::VARCHAR},
                {'m': 'router_latency_ms', 'v': last_latency_ms, 't': last_latency_ms::VARCHAR},
                {'m': 'router_status', 'v': (status IN ('primary','reserve'))::INT::DOUBLE, 't': (status IN ('primary','reserve'))::INT::DOUBLE::VARCHAR},
                {'m': 'router_readiness', 'v': readiness_ok::INT::DOUBLE, 't': readiness_ok::INT::DOUBLE::VARCHAR},
                {'m': 'router_sla_ok', 'v': sla_ok::INT::DOUBLE, 't': sla_ok::INT::DOUBLE::VARCHAR},
                {'m': 'router_latency_p50_ms', 'v': latency_p50_ms, 't': latency_p50_ms::VARCHAR},
                {'m': 'router_latency_p95_ms', 'v': latency_p95_ms, 't': latency_p95_ms::VARCHAR},
                {'m': 'router_latency_p99_ms', 'v': latency_p99_ms, 't': latency_p99_ms::VARCHAR},
                {'m': 'router_last_check_seconds', 'v': last_check, 't': last_check::VARCHAR}]) AS x FROM router_snapshot)
            SELECT cluster_id, node, x.m AS metric, round(x.v, 6) AS value, concat(x.m, '{node="', node, '"} ', x.t) AS line FROM m
            UNION ALL SELECT DISTINCT cluster_id, NULL, 'router_sla_p95_target_ms', 30000.0, 'router_sla_p95_target_ms 30000.0' FROM router_snapshot""",
        ),
    ),
}
