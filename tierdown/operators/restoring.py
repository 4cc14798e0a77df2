"""Choosing what to bring back from an archive that holds many runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierdown.operators.joins import skew_safe_join


def latest_copies(archive: DataFrame, key: str, run: str = "run_id") -> DataFrame:
    """The copies of each key from the newest run that has it.

    With a single run there is nothing to choose, which file metadata can tell. Else
    the newest run per key combines map-side before its shuffle and rows are matched
    with it. All rows of that run come back, also when a key repeats; a row without
    a key is never superseded.
    """
    span = archive.agg(F.min(run).alias("first"), F.max(run).alias("last")).first()
    if span["first"] == span["last"]:
        return archive
    keyed = F.col(key).isNotNull()
    newest = archive.where(keyed).groupBy(key).agg(F.max(run).alias("_newest_run"))
    matched = skew_safe_join(archive.where(keyed), newest, key, "inner")
    # not an equality, which would become a join key and shuffle the maxima again
    latest = matched.where(F.col(run) >= F.col("_newest_run")).select(*archive.columns)
    return latest.unionByName(archive.where(~keyed))


def restore_over(current: DataFrame, restored: DataFrame, key: str) -> DataFrame:
    """``current`` with the restored rows put back: a restored key replaces what is there."""
    columns = current.columns
    held = restored.select(key).where(F.col(key).isNotNull()).distinct()
    untouched = skew_safe_join(current, held, key, "left_anti")
    return untouched.select(*columns).unionByName(restored.select(*columns))


def split_unsafe_keys(archive: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(safe rows, error rows): absolute keys and keys that climb out are refused."""
    text = F.col(key).cast("string")
    unsafe = F.coalesce(
        text.rlike(r"^[/\\]") | text.rlike(r"(^|[/\\])\.\.([/\\]|$)"), F.lit(True)
    )
    errors = archive.where(unsafe).select(
        text.alias("key"),
        F.lit("restore").alias("operation"),
        F.lit("key leaves the restore folder").alias("err"),
    )
    return archive.where(~unsafe), errors
