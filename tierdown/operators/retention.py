"""Who is old enough to leave."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierdown.functions.age import instant_literal, is_expired, is_retained
from tierdown.operators.joins import lookup_join


def expired(df: DataFrame, ts: str, hours: float, as_of: datetime) -> DataFrame:
    return df.where(is_expired(df, ts, hours, as_of))


def retained(df: DataFrame, ts: str, hours: float, as_of: datetime) -> DataFrame:
    """Rows at the cutoff, younger, or of unknown age: never touched."""
    return df.where(is_retained(df, ts, hours, as_of))


def classify(df: DataFrame, ts: str, hours: float, as_of: datetime) -> DataFrame:
    """Adds ``expired``, true or false for every row."""
    return df.withColumn("expired", F.coalesce(is_expired(df, ts, hours, as_of), F.lit(False)))


def retention_split(
    df: DataFrame, ts: str, hours: float, as_of: datetime, size: str | None = None
) -> DataFrame:
    """Rows and bytes in each of the two classes, in one pass."""
    amount = F.lit(0) if size is None else F.col(size)
    return (
        classify(df, ts, hours, as_of)
        .groupBy("expired")
        .agg(
            F.count(F.lit(1)).alias("items"),
            F.coalesce(F.sum(amount), F.lit(0)).cast("bigint").alias("bytes"),
        )
    )


def _policy_cutoffs(
    df: DataFrame, policies: DataFrame, class_col: str, ts: str, as_of: datetime, hours_col: str
) -> DataFrame:
    if as_of.tzinfo is not None:
        as_of = as_of.astimezone(timezone.utc).replace(tzinfo=None)
    dtype = df.schema[ts].dataType
    base = instant_literal(as_of, T.TimestampNTZType() if isinstance(dtype, T.DateType) else dtype)
    # seconds with six decimals, so that fractions of an hour survive
    seconds = (F.col(hours_col).cast("double") * F.lit(3600.0)).cast("decimal(18,6)")
    back = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
    # one row per class: of several policies the strictest decides. Hours that are not
    # positive would expire what is not even old, so such a policy expires nothing
    return policies.where(F.col(hours_col) > 0).groupBy(class_col).agg(F.max(base - back).alias("policy_cutoff"))


def apply_policies(
    df: DataFrame,
    policies: DataFrame,
    class_col: str,
    ts: str,
    as_of: datetime,
    hours_col: str = "prune_after_hours",
) -> DataFrame:
    """Adds ``policy_cutoff`` and ``expired`` by the policy of each row's class.

    A class without a policy, or with hours that are not positive, is never expired. An
    ``as_of`` with a zone is taken as that instant. Each cutoff is computed once per
    policy, so rows only compare.
    """
    limits = _policy_cutoffs(df, policies, class_col, ts, as_of, hours_col)
    joined = lookup_join(df, limits, class_col, "left")
    return joined.withColumn(
        "expired", F.coalesce(F.col(ts) < F.col("policy_cutoff"), F.lit(False))
    )


def expired_by_policy(
    df: DataFrame,
    policies: DataFrame,
    class_col: str,
    ts: str,
    as_of: datetime,
    hours_col: str = "prune_after_hours",
) -> DataFrame:
    """Only the expired rows. The latest cutoff of all policies is pushed to the scan,
    so files that are young for every policy are not read."""
    limits = _policy_cutoffs(df, policies, class_col, ts, as_of, hours_col)
    latest = limits.agg(F.max("policy_cutoff").cast("string")).first()[0]
    if latest is None:
        return df.where(F.lit(False))
    dtype = limits.schema["policy_cutoff"].dataType
    candidates = df.where(F.col(ts) < F.lit(latest).cast(dtype))
    joined = lookup_join(candidates, limits, class_col, "inner")
    return joined.where(F.col(ts) < F.col("policy_cutoff")).drop("policy_cutoff")
