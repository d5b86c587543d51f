"""Intermediate tables in the shared folder the session names."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.sources.workdir import fresh_dir


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows written to the shared folder and read back, so that a lost executor costs no recomputation."""
    spark: SparkSession = df.sparkSession
    path = fresh_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BUCKET = 32768  # bits in one value of Spark's bitmap functions


def bitmap(rows: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bitmap of ``bits`` bits with those set that occur in ``column``; the bounded result of any number of rows.

    Bits become bitmaps on the executors, and only these reach the driver.
    """
    bucket = F.call_function("div", F.col(column), F.lit(BUCKET)).alias("bucket")
    made = rows.groupBy(bucket).agg(F.bitmap_construct_agg(F.col(column) % BUCKET).alias("b"))
    out = np.zeros(-(-bits // BUCKET) * (BUCKET // 8), np.uint8)
    for row in made.toLocalIterator():
        out[row.bucket * (BUCKET // 8) : (row.bucket + 1) * (BUCKET // 8)] = np.frombuffer(row.b, np.uint8)
    return out[: -(-bits // 8)]


def has_bit(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
