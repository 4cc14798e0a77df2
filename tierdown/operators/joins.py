"""Equi-join against a lookup side, safe when one key holds a large share of rows.

Keys that are frequent on the left are found in one pass over the key column. There
are at most ``1 / support`` of them, so their lookup rows always fit a broadcast;
every other key goes through an ordinary shuffle join, whose largest group is then
bounded by the support. When nothing is frequent the plan is just that join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_SUPPORT = 0.001
HOWS = ("inner", "left", "left_semi", "left_anti")
# the sketch is off by about 1 / 6000 of the rows, well below the support
_TRACKED_ITEMS = 8192
_MERGE_GROUPS = 256
# for these, adaptive execution alone deals with skew
_NOT_SKETCHED = (T.BinaryType, T.StructType, T.ArrayType, T.MapType)


def frequent_keys(df: DataFrame, key: str, support: float = DEFAULT_SUPPORT) -> list:
    """Keys holding at least ``support`` of the rows, among them None for NULL.

    Each task keeps one bounded sketch; sketches are merged in groups of tasks and
    then once more, so that no single task takes those of the whole cluster. The data
    is not shuffled, and at most ``1 / support`` values come to the driver. An error
    in the sketch could only move a key to the other join strategy, never change the
    result.
    """
    if isinstance(df.schema[key].dataType, _NOT_SKETCHED):
        return []
    per_group = df.groupBy((F.spark_partition_id() % _MERGE_GROUPS).alias("g")).agg(
        F.count(F.lit(1)).alias("items"),
        F.expr(f"approx_top_k_accumulate(`{key}`, {_TRACKED_ITEMS})").alias("sketch"),
    )
    merged = f"approx_top_k_combine(sketch, {_TRACKED_ITEMS})"
    # grouped, so that no rows give no row: the sketch of nothing cannot be read
    row = per_group.groupBy(F.lit("all")).agg(
        F.sum("items").alias("total"),
        F.expr(f"approx_top_k_estimate({merged}, {int(1 / support)})").alias("top"),
    ).first()
    if row is None:
        return []
    least = max((row.total or 0) * support, 2)
    return [entry["item"] for entry in row.top or [] if entry["count"] >= least]


def skew_safe_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str = "inner",
    support: float = DEFAULT_SUPPORT,
) -> DataFrame:
    """Join where ``right`` has at most one row per ``key``. NULL keys never match."""
    if how not in HOWS:
        raise ValueError(f"how must be one of {HOWS}, got {how}")
    found = frequent_keys(left, key, support)
    if not found:
        return left.join(right, key, how)
    hot = [value for value in found if value is not None]
    is_hot = F.col(key).isin(hot) if hot else F.lit(False)
    # NULL keys need no partner, so they stay out of the shuffle as well
    hot_left = left.where(F.col(key).isNull() | is_hot)
    hot_right = F.broadcast(right.where(is_hot))
    rest = left.where(F.col(key).isNotNull() & ~is_hot).join(right.where(~is_hot), key, how)
    return hot_left.join(hot_right, key, how).unionByName(rest)


def small_enough(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; stops reading once it is clear."""
    return len(df.select(F.lit(1)).take(max_rows + 1)) <= max_rows


def lookup_join(
    left: DataFrame,
    lookup: DataFrame,
    key: str,
    how: str = "inner",
    max_broadcast_rows: int = 10_000,
) -> DataFrame:
    """Broadcast ``lookup`` after checking its size, else join skew-safe."""
    if small_enough(lookup, max_broadcast_rows):
        return left.join(F.broadcast(lookup), key, how)
    return skew_safe_join(left, lookup, key, how)
