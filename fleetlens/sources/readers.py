"""Readers: batch files, token tables, cluster snapshots and access logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens import schemas
from fleetlens.functions.scalars import usage_node_ip
from fleetlens.functions.wire import response_from_wire
from fleetlens.sources.arrays import BROKEN, array_elements

REQUEST_TIME = "dd/MMM/yyyy:HH:mm:ss Z"


def _elements(spark: SparkSession, path: str, schema: str, multi_line: bool) -> DataFrame:
    """Elements of JSON arrays with the file they are from and, for whole files, their position from 0.

    ``problem`` names what is wrong with an element that cannot be read; its fields are null.
    """
    file, bad = F.col("_metadata.file_path").alias("file"), "__bad"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}
    typed = f"struct<{schema}, {bad}: string>"
    if multi_line:
        found = array_elements(spark, path).withColumn("e", F.from_json("element", typed, options))
    else:
        lines = spark.read.text(path).select(file, F.trim("value").alias("element")).where(F.col("element") != "")
        # A line is an array, or one item. A broken array gives one row, as its items cannot be told apart.
        listed = F.from_json("element", f"array<{typed}>", options)
        found = lines.select("file", "element", F.explode_outer(listed).alias("e")).withColumn("position", F.lit(None).cast("long"))
        found = found.where(F.col("e").isNotNull() | ~F.col("element").rlike(r"^\[\s*\]$"))
    problem = F.when(F.col("e").isNull() | F.col(f"e.{bad}").isNotNull() | ~F.startswith("element", F.lit("{")) & F.lit(multi_line), BROKEN)
    fields = [F.when(problem.isNull(), F.col(f"e.{f.name}")).alias(f.name) for f in T.StructType.fromDDL(schema)]
    return found.select(*fields, "file", F.col("position").cast("long").alias("position"), problem.alias("problem"))


def _job_of_file(kind: str) -> Column:
    found = F.regexp_extract("file", rf"batch_{kind}_([^/]+)\.json$", 1)
    return F.when(found != "", found).alias("job")


def read_batch_input(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Batch items from JSON arrays of ``{custom_id, request}``.

    ``request`` has the known settings typed, ``body`` is the whole request as JSON, with whatever else it holds. One
    array (or item) per line can be split among tasks. ``multi_line`` reads files that hold one array
    over several lines, by byte ranges (:mod:`fleetlens.sources.arrays`); ``position`` counts a file's items from 0, and ``job`` is
    the name in ``batch_input_<job>.json``. What cannot be read as an item, such as the end of a file that breaks off, is
    a row of nulls with a ``problem``; the items before it are read.
    """
    rows = _elements(spark, path, schemas.BATCH_INPUT_RAW, multi_line)
    typed = F.from_json("request", schemas.REQUEST)
    return rows.select("custom_id", typed.alias("request"), F.col("request").alias("body"), "position", _job_of_file("input"), "problem")


def read_batch_output(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Batch results from JSON arrays of ``{response, error}``, with job and ordinal where the items carry them.

    ``response`` is the whole typed response (null where there is none), answer text and ``served_by`` included, and ``body``
    its JSON. Files with one array over several lines (``multi_line``) match their job's items by ``position``,
    from 0; ``job`` is the name in ``batch_output_<job>.json``. What cannot be read is a row with a ``problem``.
    """
    rows = _elements(spark, path, schemas.BATCH_OUTPUT_RAW, multi_line)
    body = F.col("response")
    return rows.select(
        "job_id", "ordinal", F.when(body.isNotNull(), response_from_wire(body)).alias("response"), "error", body.alias("body"),
        "position", _job_of_file("output"), "problem",
    )


def read_token_csv(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Token counts from CSV with a header: all rows, or the first ``limit`` in file order."""
    rows = spark.read.option("header", True).schema(schemas.TOKEN_JOBS).csv(path)
    if limit is None:
        return rows
    ordered = rows.select(
        "*",
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__row"),
    )
    return ordered.orderBy("__file", "__block", "__row").limit(limit).select(*rows.columns)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Saved cluster documents, one per line: cluster_id, snapshot_ts and body as text."""
    return spark.read.schema("cluster_id bigint, snapshot_ts bigint, body string").json(path)


def _scope(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c != "body"]


def nodes_from_snapshots(docs: DataFrame) -> DataFrame:
    """Node rows in listing order; a document without a node list gives none."""
    listed = F.from_json("body", schemas.NODE_SNAPSHOT)["data"]["result"]["result"]
    return docs.select(*_scope(docs), F.posexplode(listed).alias("ordinal", "__n")).select(
        *_scope(docs),
        F.col("ordinal").cast("long").alias("ordinal"),
        F.col("__n.node_id").alias("node_id"),
        F.trim(F.coalesce("__n.node_ip", F.lit(""))).alias("node_ip"),
        F.trim(F.coalesce("__n.node_name", F.lit(""))).alias("node_name"),
        F.col("__n.state").alias("state"),
        F.coalesce("__n.is_head_node", F.lit(False)).alias("is_head_node"),
        F.coalesce("__n.resources_total", F.create_map().cast("map<string,double>")).alias("resources"),
    )


def replicas_from_snapshots(docs: DataFrame, app: str, deployment: str) -> DataFrame:
    """Replica rows of one deployment; missing levels give none."""
    apps = F.from_json("body", schemas.SERVE_SNAPSHOT)["applications"]
    listed = F.try_element_at(F.try_element_at(apps, F.lit(app))["deployments"], F.lit(deployment))["replicas"]
    return docs.select(*_scope(docs), F.posexplode(listed).alias("ordinal", "__r")).select(
        *_scope(docs), F.col("ordinal").cast("long").alias("ordinal"), "__r.*"
    )


def statuses_from_snapshots(docs: DataFrame) -> DataFrame:
    """One row per app and per deployment with its status."""
    apps = F.from_json("body", schemas.SERVE_SNAPSHOT)["applications"]
    per_app = docs.select(*_scope(docs), F.explode(apps).alias("app", "__a"))
    parts = F.concat(
        F.array(F.col("__a.status")),
        F.coalesce(F.transform(F.map_values("__a.deployments"), lambda d: d["status"]), F.array().cast("array<string>")),
    )
    return per_app.select(*_scope(docs), "app", F.explode(parts).alias("status"))


def usage_keys(docs: DataFrame) -> DataFrame:
    """Resource keys the cluster reports in use."""
    usage = F.from_json("body", schemas.USAGE_SNAPSHOT)["data"]["clusterStatus"]["loadMetricsReport"]["usage"]
    return docs.select(*_scope(docs), F.explode(F.map_keys(usage)).alias("key"))


def usage_by_node(docs: DataFrame) -> DataFrame:
    """Per node: its id, the address in its resource keys, and the keys."""
    report = F.from_json("body", schemas.USAGE_SNAPSHOT)["data"]["clusterStatus"]["loadMetricsReport"]
    keys = F.map_keys("__usage")
    return docs.select(*_scope(docs), F.explode(report["usageByNode"]).alias("node_id", "__usage")).select(
        *_scope(docs), "node_id", usage_node_ip(keys).alias("node_ip"), keys.alias("resource_keys")
    )


def parse_access_log(lines: DataFrame) -> DataFrame:
    """Typed request rows from access-log lines (batch or stream), unparsable values null."""
    entry = lines.select(F.from_json("value", schemas.ACCESS_LOG).alias("e")).where(F.col("e").isNotNull())

    def number(name: str, kind: str) -> Column:
        return F.col(f"e.{name}").try_cast(kind)

    return entry.select(
        F.col("e.requestId").alias("request_id"),
        F.try_to_timestamp(F.col("e.requestTime"), F.lit(REQUEST_TIME)).alias("ts"),
        F.col("e.apiKeyId").alias("api_key_id"),
        F.col("e.ip").alias("ip"),
        F.col("e.httpMethod").alias("method"),
        F.col("e.resourcePath").alias("path"),
        number("status", "int").alias("status"),
        number("responseLength", "bigint").alias("response_length"),
        number("latency", "double").alias("latency_ms"),
    )


def read_access_log(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return parse_access_log(spark.read.text(path))


def stream_access_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_access_log(spark.readStream.text(path))
