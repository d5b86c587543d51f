"""Starting streams over Parquet tables and keeping their output as a table."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.sources.workdir import fresh_dir

STATEFUL = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    # Lets the keyed processors sort rows within partitions.
    "spark.sql.streaming.unsupportedOperationCheck": "false",
}


SHUFFLE = "spark.sql.shuffle.partitions"

# The event time of the closing mark; rows at or after it are not data.
CLOSING = "9999-01-01 00:00:00"
CLOSING_US = 253370764800 * 1_000_000


def state_partitions(spark: SparkSession) -> int:
    """State partitions: the session's shuffle width, or the cores of a local session.

    Each is a state store and a Python worker, and the number is fixed at the first start.
    """
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return spark.sparkContext.defaultParallelism
    return int(spark.conf.get(SHUFFLE))


@contextmanager
def stateful_settings(spark: SparkSession) -> Iterator[None]:
    """Settings a query with keyed processors must be started under; restored after."""
    settings = {**STATEFUL, SHUFFLE: str(state_partitions(spark))}
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def parquet_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream over a Parquet file or a folder of Parquet files."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # A pattern is accepted for single files too, where a plain path must be a folder.
    return reader.parquet(path[:-1] + f"[{path[-1]}]")


def _append(stream: DataFrame, out: str, marks: str) -> None:
    """Process what is available now and append it to the table ``out``."""
    with stateful_settings(stream.sparkSession):
        query = (
            stream.writeStream.format("parquet")
            .outputMode("append")
            .option("path", out)
            .option("checkpointLocation", marks)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()


def run_available(stream: DataFrame, label: str) -> DataFrame:
    """Process what is available now, append the output to a table and read it back.

    State stays in RocksDB and both the checkpoint and the table in the shared work
    folder, so a lost executor resumes from there.
    """
    spark = stream.sparkSession
    out = fresh_dir(spark, label)
    _append(stream, out, fresh_dir(spark, f"{label}-checkpoint"))
    return spark.read.schema(stream.schema).parquet(out)


def run_to_end(
    source: DataFrame, query: Callable[[DataFrame], DataFrame], label: str, checkpoint: str | None = None
) -> DataFrame:
    """Process all of a stream that has ended, open windows and waiting rows included, and read the output.

    A watermark stays behind the newest row, so the last windows, held-back rows and timers of a finished stream never
    come out by themselves. Here ``source`` is read together with a folder of closing marks. All data is processed first; then
    one mark, a row with nothing but an event time far ahead, moves the watermark beyond all data in
    a second run of the same query from its checkpoint. ``query`` must let rows of nulls reach its watermark.
    """
    spark = source.sparkSession
    out, folder = fresh_dir(spark, label), fresh_dir(spark, f"{label}-closing")
    checkpoint = checkpoint or fresh_dir(spark, f"{label}-checkpoint")
    mark = [F.lit(CLOSING).cast("timestamp").cast(f.dataType).alias(f.name) if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in source.schema]
    marks = spark.range(1).select(*mark)
    marks.limit(0).write.parquet(folder)
    stream = query(source.unionByName(spark.readStream.schema(source.schema).parquet(folder)))
    _append(stream, out, checkpoint)
    marks.coalesce(1).write.mode("append").parquet(folder)
    _append(stream, out, checkpoint)
    return spark.read.schema(stream.schema).parquet(out)
