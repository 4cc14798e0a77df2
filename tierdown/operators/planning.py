"""What a run would do, as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierdown.functions.naming import DEFAULT_FORMAT, archive_bucket, archive_name, destination_path


def _fan_out(df: DataFrame, destinations: Sequence[str] | str) -> DataFrame:
    if isinstance(destinations, str):
        return df.withColumn("destination", F.explode(destinations))
    listed = F.array(*[F.lit(d) for d in destinations])
    return df.withColumn("destination", F.explode(listed))


def destination_plan(
    df: DataFrame,
    destinations: Sequence[str] | str,
    key: str,
    algorithm: str | Column | None = None,
) -> DataFrame:
    """Every row once per destination, with the path of that copy. No shuffle.

    ``destinations`` is a list, or the name of an array column.
    """
    planned = _fan_out(df, destinations)
    return planned.withColumn("target_path", destination_path("destination", key, algorithm))


def archive_plan(
    df: DataFrame,
    destinations: Sequence[str] | str,
    ts: str,
    group_by: str = "daily",
    format: str = DEFAULT_FORMAT,
) -> DataFrame:
    """Every row once per destination, with the container it would go into."""
    bucketed = df.withColumn("bucket", archive_bucket(ts, group_by))
    planned = _fan_out(bucketed, destinations)
    return planned.withColumn(
        "target_path", destination_path("destination", archive_name("bucket", format))
    )


def dry_run(plan: DataFrame, size: str, by: Sequence[str] = ("destination",)) -> DataFrame:
    """Planned items and bytes; ``by=('destination', 'target_path')`` lists containers."""
    return plan.groupBy(*by).agg(
        F.count(F.lit(1)).alias("planned_items"),
        F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("planned_bytes"),
    )
