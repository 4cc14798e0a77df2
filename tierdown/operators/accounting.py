"""Run results as aggregates over outcome rows.

An outcome row says what happened to one item: ``run_id, phase, key, destination,
ok, operation, err, bytes``. Counters are global or per-run aggregates that combine
map-side; lists of errors stay tables, because they can be as long as the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierdown.functions.rates import breaches, compression_ratio, failure_rate, space_saved
from tierdown.operators.scans import running, sliced

# Fixed value: the sentence about one failure.
ERROR_SENTENCE = "%s failed for %s: %s"

COUNTERS = (
    "succeeded",
    "failed",
    "skipped",
    "backed_up",
    "pruned",
    "kept",
    "copies",
    "total_bytes",
    "original_bytes",
    "compressed_bytes",
    "archive_size",
)


def _grouped(df: DataFrame, by: Sequence[str]):
    return df.groupBy(*by) if by else df.groupBy()


def _total(value: Column, where: Column) -> Column:
    return F.coalesce(F.sum(F.when(where, value)), F.lit(0)).cast("bigint")


def run_summary(outcomes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counters of a run, in one aggregate.

    ``phase`` is ``backup``, ``prune`` or ``skip``; ``ok`` tells whether it worked.
    ``failed`` counts both phases; ``failed_items`` counts an item once.
    """
    ok = F.coalesce(F.col("ok"), F.lit(False))
    backup, prune = F.col("phase") == "backup", F.col("phase") == "prune"
    tried = backup | prune
    return _grouped(outcomes, by).agg(
        F.count_if(backup & ok).alias("succeeded"),
        F.count_if(tried & ~ok).alias("failed"),
        F.count_if(F.col("phase") == "skip").alias("skipped"),
        F.count_if(backup & ok).alias("backed_up"),
        F.count_if(prune & ok).alias("pruned"),
        _total(F.col("bytes"), backup & ok).alias("total_bytes"),
        F.count_distinct(F.when(tried & ~ok, F.col("key"))).alias("failed_items"),
        failure_rate(F.count_if(backup & ok), F.count_if(tried & ~ok)).alias("failure_rate"),
    )


def phase_rates(outcomes: DataFrame, by: Sequence[str] = ("phase",)) -> DataFrame:
    """Failure rate of each phase by itself."""
    ok = F.coalesce(F.col("ok"), F.lit(False))
    return _grouped(outcomes, by).agg(
        F.count_if(ok).alias("succeeded"),
        F.count_if(~ok).alias("failed"),
        failure_rate(F.count_if(ok), F.count_if(~ok)).alias("failure_rate"),
    )


def compression_stats(
    df: DataFrame, original: str | Column, compressed: str | Column, by: Sequence[str] = ()
) -> DataFrame:
    original = F.col(original) if isinstance(original, str) else original
    compressed = F.col(compressed) if isinstance(compressed, str) else compressed
    sums = _grouped(df, by).agg(
        F.coalesce(F.sum(original), F.lit(0)).cast("bigint").alias("original_bytes"),
        F.coalesce(F.sum(compressed), F.lit(0)).cast("bigint").alias("compressed_bytes"),
    )
    return sums.select(
        "*",
        compression_ratio("original_bytes", "compressed_bytes").alias("compression_ratio"),
        space_saved("original_bytes", "compressed_bytes").alias("space_saved"),
    )


def archive_stats(df: DataFrame, bucket: str = "bucket", size: str | None = None) -> DataFrame:
    """Items and bytes per container."""
    amount = F.lit(0) if size is None else F.col(size)
    return df.groupBy(bucket).agg(
        F.count(F.lit(1)).alias("items"),
        F.coalesce(F.sum(amount), F.lit(0)).cast("bigint").alias("total_bytes"),
    )


def threshold_gate(outcomes: DataFrame, percent: float, by: Sequence[str] = ()) -> DataFrame:
    """Whether the share of failures forbids going on to the prune."""
    ok = F.coalesce(F.col("ok"), F.lit(False))
    counts = _grouped(outcomes, by).agg(
        F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed")
    )
    return counts.select(
        "*",
        failure_rate("succeeded", "failed").alias("failure_rate"),
        breaches("succeeded", "failed", percent).alias("stop"),
    )


def any_destination_ok(
    outcomes: DataFrame, key: str = "key", order: str = "dest_order"
) -> DataFrame:
    """One row per item: good if any copy worked, else the first destination's error."""
    ok = F.coalesce(F.col("ok"), F.lit(False))
    return outcomes.groupBy(key).agg(
        F.bool_or(ok).alias("backed_up"),
        F.count_if(ok).alias("copies"),
        F.min_by("err", F.when(~ok, F.col(order))).alias("_first_err"),
    ).select(
        key, "backed_up", "copies", F.when(~F.col("backed_up"), F.col("_first_err")).alias("err")
    )


def union_outcomes(*phases: tuple[str, DataFrame]) -> DataFrame:
    """Outcome rows of several phases in one table, told apart by ``phase``."""
    tagged = [df.withColumn("phase", F.lit(name)) for name, df in phases]
    merged = tagged[0]
    for df in tagged[1:]:
        merged = merged.unionByName(df, allowMissingColumns=True)
    return merged


def merge_results(
    results: DataFrame, by: Sequence[str] = (), order: str = "run_id", path: str = "archive_path"
) -> DataFrame:
    """Adds up the counters of many runs and keeps the first archive path that is set."""
    sums = [
        F.coalesce(F.sum(name), F.lit(0)).cast("bigint").alias(name) for name in COUNTERS if name in results.columns
    ]
    if path in results.columns:
        has_path = F.coalesce(F.col(path), F.lit("")) != ""
        sums.append(F.min_by(F.when(has_path, F.col(path)), F.when(has_path, F.col(order))).alias(path))
    return _grouped(results, by).agg(*sums)


def error_report(outcomes: DataFrame, *others: Column | str) -> DataFrame:
    """Every failure, one row each, with its sentence, and ``others`` if asked for."""
    failures = outcomes.where(~F.coalesce(F.col("ok"), F.lit(False)))
    path = F.col("key").cast("string")
    known = [F.coalesce(part, F.lit("")) for part in (F.col("operation"), path, F.col("err"))]
    return failures.select(
        path.alias("path"),
        "operation",
        "err",
        F.format_string(ERROR_SENTENCE, *known).alias("message"),
        *others,
    )


def merge_errors(outcomes: DataFrame, order: Sequence[str] = ("run_id",), within: Sequence[str] = ("key",)) -> DataFrame:
    """The errors of many runs as one list: those of the first run, then those of the next,
    each with its ``position`` from 0 on. Within a run they are ordered by ``within``;
    errors that are equal there come in any order.

    The list stays a table. It is numbered by a sliced running count, so no task sees
    more than its slice of it.
    """
    failures = outcomes.where(~F.coalesce(F.col("ok"), F.lit(False)))
    keys = [*order, *(name for name in within if name not in order)]
    rows = sliced(failures, [], keys, kept=[*order, *(c for c in failures.columns if c not in order)])
    numbered = running(rows, {"position": ("sum", F.lit(1).cast("bigint"))})
    return error_report(numbered, *order, (F.col("position") - 1).alias("position"))


def error_counts(outcomes: DataFrame) -> DataFrame:
    return error_report(outcomes).groupBy("operation").agg(F.count(F.lit(1)).alias("errors"))
