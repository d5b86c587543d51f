"""Collects the registered queries and shapes their results for comparison."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.plans.fixtures import Tables

DECIMALS = 6


@dataclass(frozen=True)
class Query:
    build: Callable[[Tables], DataFrame]
    oracle: str | None = None


def comparable(df: DataFrame) -> DataFrame:
    """Wall-clock timestamps and rounded doubles, as the SQL oracles return them."""
    out = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.TimestampType):
            column = column.cast("timestamp_ntz")
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            column = F.round(column.cast("double"), DECIMALS)
        out.append(column.alias(field.name))
    return df.select(*out)


def all_queries() -> dict[str, Query]:
    from fleetlens.plans import batch, files, fleet, incidents, requests, streams, windows

    merged: dict[str, Query] = {}
    for module in (requests, batch, fleet, incidents, windows, files, streams):
        for name, query in module.QUERIES.items():
            if name in merged:
                raise ValueError(f"query {name} registered twice")
            merged[name] = query
    return merged


def runner(query: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return comparable(query.build(Tables(spark, sf_dir)))

    return run
