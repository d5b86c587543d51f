"""Properties that keep the jobs whole and spread out on large, skewed data."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import fleetlens
from fleetlens.operators import incidents as inc
from fleetlens.operators.quantiles import exact_quantiles
from fleetlens.operators.rolling import rolling_quantiles, sample_blocks
from fleetlens.operators.scan import CHUNK, KEY, PART, by_time, cut, pack, row_index
from fleetlens.plans.fixtures import Tables
from fleetlens.plans.registry import all_queries

SF = "/root/testdata/sf0.001"
SOURCES = [p for p in Path(fleetlens.__file__).parent.rglob("*.py")]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def hot(spark):
    """A third of all rows on one node, in time order."""
    i = F.col("id")
    return spark.range(60000).select(
        F.lit(0).alias("cluster_id"),
        F.when(i % 3 == 0, 0).otherwise(i % 400 + 1).cast("int").alias("node"),
        F.timestamp_micros(i * 700_000).alias("ts"),
        i.alias("seq"),
        (F.xxhash64(i) % 7 != 0).alias("healthy"),
        (F.abs(F.xxhash64(i)) % 100000 / 7.0).alias("latency_ms"),
    )


def test_no_cross_joins_or_driver_results():
    banned = re.compile(r"crossJoin|\.toPandas\(|\.collect\(\)|localCheckpoint|\.rdd\b|toLocalIterator")
    for path in SOURCES:
        if "llm" not in path.parts:  # models and bitmaps of bounded size come to the driver there
            assert not banned.search(path.read_text()), path


@pytest.mark.parametrize("name", sorted(n for n in all_queries() if not n.startswith(("stream_", "src_", "sink_"))))
def test_plans_have_no_pairwise_joins(spark, name):
    plan = plan_of(all_queries()[name].build(Tables(spark, SF)))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan


def test_no_window_runs_over_a_whole_key(hot):
    """Row windows are partitioned by chunk as well as key; whole-key ones see summaries."""
    for df in (inc.probe_outages(hot), inc.downtime(hot), row_index(hot, ["node"], [F.col("seq")], by_time(F.col("ts")), "n")):
        windows = re.findall(r"Window \[.*?\], \[([^\]]*)\]", plan_of(df))
        assert windows
        for partition in windows:
            assert "__chunk" in partition or "__key" in partition
        text = plan_of(df)
        sorted_rows = [line for line in text.splitlines() if "Sort [" in line and "seq" in line]
        assert sorted_rows and all("__chunk" in line for line in sorted_rows)


def test_hot_node_results_are_whole(spark, hot, as_rows):
    table = hot.cache()
    plain = table.groupBy("node").agg(*[F.percentile("latency_ms", F.lit(p)).alias(n) for n, p in (("p50", 0.5), ("p99", 0.99))])
    ours = exact_quantiles(table, ["node"], "latency_ms", {"p50": 0.5, "p99": 0.99})
    rounded = [F.round(c, 6).alias(c) for c in ("p50", "p99")]
    assert as_rows(ours.select("node", *rounded)) == as_rows(plain.select("node", *rounded))
    assert rolling_quantiles(table, size=64, block=512).count() == 60000


def test_rolling_groups_are_bounded(hot):
    """Each group given to Python holds one block and the samples before it."""
    blocks = sample_blocks(hot, ["node"], "latency_ms", 64, 512, 300)
    sizes = blocks.groupBy("node", "__block").agg(F.count(F.lit(1)).alias("n"), F.count_if("__context").alias("c"))
    row = sizes.agg(F.max("n"), F.max("c"), F.sum(F.col("n") - F.col("c"))).first()
    assert row[0] <= 512 + 63 and row[1] <= 63 and row[2] == 60000


def test_hot_node_chunks_are_bounded(hot):
    """No chunk holds more than its slice of time, however much of the data a node has."""
    chunks = cut(pack(hot, ["node"]), by_time(F.col("ts"))).groupBy(CHUNK, PART, KEY).count()
    assert chunks.agg(F.max("count")).first()[0] <= 300 / 0.7 / 3 + 1


def test_quantile_join_sides_are_reduced(hot):
    plan = plan_of(exact_quantiles(hot, ["node"], "latency_ms", {"p95": 0.95}))
    assert "percentile" not in plan.lower().replace("latency_p95", "")


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(all_queries()["status_histogram"].build(Tables(spark, SF)))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"event_type", "props"}
    plan = plan_of(all_queries()["running_replicas"].build(Tables(spark, SF)))
    assert "o_totalprice" not in plan and "o_orderstatus" in plan  # whole table, needed columns
    plan = plan_of(all_queries()["snapshot_delta"].build(Tables(spark, SF)))
    assert "LessThan(l_shipdate" in plan
