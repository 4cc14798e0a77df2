"""Joins that tie the phases of a run together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierdown.operators.joins import skew_safe_join


def _distinct_keys(df: DataFrame, key: str) -> DataFrame:
    # partial distinct first: copies of a hot key collapse before the shuffle
    return df.select(key).where(F.col(key).isNotNull()).distinct()


def prune_safe(expired_rows: DataFrame, backed_up: DataFrame, key: str) -> DataFrame:
    """Expired rows that exist in a copy: the only ones that may be removed."""
    return skew_safe_join(expired_rows, _distinct_keys(backed_up, key), key, "left_semi")


def unbacked(expired_rows: DataFrame, backed_up: DataFrame, key: str) -> DataFrame:
    """Expired rows found in no copy: kept and reported."""
    return skew_safe_join(expired_rows, _distinct_keys(backed_up, key), key, "left_anti")


def proven_counts(old: DataFrame, held: DataFrame, digest: str, destination: str, size: str | Column | None = None) -> DataFrame:
    """``<digest>, items, amount`` of expired rows that some destination holds as often as
    they are needed; ``amount`` is the sum of ``size`` over them.

    Of rows that are alike a copy must hold as many; where it holds fewer, all of them
    stay. Both sides combine map-side, so a row that repeats very often is one count.
    """
    weight = F.lit(0) if size is None else size
    needed = old.groupBy(digest).agg(
        F.count(F.lit(1)).alias("items"), F.coalesce(F.sum(weight), F.lit(0)).cast("bigint").alias("amount")
    )
    copies = held.groupBy(destination, digest).agg(F.count(F.lit(1)).alias("n"))
    most = copies.groupBy(digest).agg(F.max("n").alias("held"))
    return needed.join(most, digest).where("held >= items").select(digest, "items", "amount")


def proven_digests(old: DataFrame, held: DataFrame, digest: str, destination: str) -> DataFrame:
    """The digests of ``proven_counts`` alone."""
    return proven_counts(old, held, digest, destination).select(digest)


def unread_items(inventory: DataFrame, read: DataFrame, key: str) -> DataFrame:
    """``access`` errors: items that were listed but could not be read."""
    missing = skew_safe_join(inventory.select(key), _distinct_keys(read, key), key, "left_anti")
    return missing.select(
        F.col(key).alias("key"),
        F.lit("access").alias("operation"),
        F.lit("listed but not readable").alias("err"),
    )


def overlap_guard(
    sources: DataFrame, destinations: DataFrame, source: str = "source", destination: str = "destination"
) -> DataFrame:
    """Destinations that lie in, or are equal to, a source they would copy from.

    A path lies in a folder when the folder is one of its ancestors, so each
    destination lists its own ancestors and the test becomes an equi-join: no
    pairwise comparison, and ``/data/ab`` is not taken to lie in ``/data/a``.
    """
    trimmed = F.rtrim(F.col(destination), F.lit("/"))
    parts = F.split(trimmed, "/")
    depths = F.sequence(F.lit(1), F.size(parts))
    ancestors = F.transform(depths, lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    lineage = destinations.select(destination).distinct().withColumn("folder", F.explode(ancestors))
    folders = sources.select(F.rtrim(F.col(source), F.lit("/")).alias("folder")).distinct()
    found = skew_safe_join(lineage, folders, "folder", "inner")
    return found.select(F.col("folder").alias(source), destination)
