"""Percentages and the sentences that report them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The report sentences.
RUN_CLEAN = "completed: %d files processed, %d backed up, %d pruned"
RUN_WITH_ERRORS = "completed with errors: %d succeeded, %d failed (%s%% failure rate)"
PRUNE_CLEAN = "pruned %d files"
PRUNE_WITH_ERRORS = "pruned %d files, %d failed (%s%% failure rate)"


def _column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def failure_rate(succeeded: str | Column, failed: str | Column) -> Column:
    """Failures as a percentage of everything tried; 0 when nothing was tried."""
    succeeded, failed = _column(succeeded), _column(failed)
    tried = (succeeded + failed).cast("double")
    return F.when(tried == 0, F.lit(0.0)).otherwise(failed.cast("double") / tried * F.lit(100.0))


def compression_ratio(original: str | Column, compressed: str | Column) -> Column:
    """Compressed size as a percentage of the original; 100 when there was nothing."""
    original, compressed = _column(original), _column(compressed)
    return F.when(F.coalesce(original, F.lit(0)) == 0, F.lit(100.0)).otherwise(
        compressed.cast("double") / original.cast("double") * F.lit(100.0)
    )


def space_saved(original: str | Column, compressed: str | Column) -> Column:
    return F.lit(100.0) - compression_ratio(original, compressed)


def breaches(succeeded: str | Column, failed: str | Column, percent: float) -> Column:
    """Strictly above the threshold; a threshold of 0 switches the breaker off."""
    if percent <= 0:
        return F.lit(False)
    return failure_rate(succeeded, failed) > F.lit(float(percent))


def _one_decimal(rate: Column) -> Column:
    # format_number rounds the exact binary value half-even; format_string does not
    return F.format_number(rate, 1)


def summary_line(
    succeeded: str | Column, failed: str | Column, backed_up: str | Column, pruned: str | Column
) -> Column:
    """One sentence about a whole run."""
    succeeded, failed = _column(succeeded), _column(failed)
    clean = F.format_string(RUN_CLEAN, succeeded, _column(backed_up), _column(pruned))
    rate = _one_decimal(failure_rate(succeeded, failed))
    troubled = F.format_string(RUN_WITH_ERRORS, succeeded, failed, rate)
    return F.when(failed == 0, clean).otherwise(troubled)


def prune_summary_line(pruned: str | Column, failed: str | Column) -> Column:
    """One sentence about the prune phase alone."""
    pruned, failed = _column(pruned), _column(failed)
    clean = F.format_string(PRUNE_CLEAN, pruned)
    rate = _one_decimal(failure_rate(pruned, failed))
    troubled = F.format_string(PRUNE_WITH_ERRORS, pruned, failed, rate)
    return F.when(failed == 0, clean).otherwise(troubled)
