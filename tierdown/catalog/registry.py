"""Named queries over the given tables, each with the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# the instants the examples are run at
EVENTS_AS_OF = datetime(2024, 1, 31)
ORDERS_AS_OF = datetime(2000, 1, 11)
HOURS = 240.0
EVENTS_CUTOFF = "TIMESTAMP '2024-01-21 00:00:00'"
ORDERS_CUTOFF = "TIMESTAMP '2000-01-01 00:00:00'"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
