"""Policy rules as one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierdown.functions.naming import (
    ALGORITHM_EXTENSIONS,
    DEFAULT_FORMAT,
    FORMAT_EXTENSIONS,
    GROUPINGS,
    GZIP,
    merge_destinations,
)

# Defaults and limits of a policy.
DEFAULT_LEVEL = 6
LEVEL_RANGE = (1, 9)
DEFAULT_LEVEL_MARKS = (0, -1)
DEFAULT_GROUPING = "daily"
# user@host:/path or host:/path
REMOTE_PATTERN = r"^([a-zA-Z0-9._-]+@)?[a-zA-Z0-9._-]+:.+\z"


def _blank(value: Column) -> Column:
    return F.coalesce(value, F.lit("")) == ""


def _default_text(value: Column, default: str) -> Column:
    return F.when(_blank(value), F.lit(default)).otherwise(F.lower(value))


def with_defaults(policies: DataFrame) -> DataFrame:
    """Fills the optional settings and merges destination lists.

    ``compression`` and ``archive`` are never NULL afterwards; names are lower case.
    """
    comp, arch = F.col("compression"), F.col("archive")
    level = F.coalesce(comp["level"], F.lit(0))
    return policies.withColumns(
        {
            "enable_backup": F.coalesce("enable_backup", F.lit(False)),
            "error_threshold_percent": F.coalesce("error_threshold_percent", F.lit(0.0)),
            "destinations": merge_destinations("backup_path", "backup_paths"),
            "remotes": merge_destinations("remote_backup", "remote_backups"),
            "compression": F.struct(
                F.coalesce(comp["enabled"], F.lit(False)).alias("enabled"),
                _default_text(comp["algorithm"], GZIP).alias("algorithm"),
                F.when(level.isin(*DEFAULT_LEVEL_MARKS), F.lit(DEFAULT_LEVEL))
                .otherwise(level)
                .alias("level"),
            ),
            "archive": F.struct(
                F.coalesce(arch["enabled"], F.lit(False)).alias("enabled"),
                _default_text(arch["format"], DEFAULT_FORMAT).alias("format"),
                _default_text(arch["group_by"], DEFAULT_GROUPING).alias("group_by"),
            ),
        }
    )


def policy_lint(policies: DataFrame) -> DataFrame:
    """Adds ``violations``, in rule order; an empty array means the policy is valid."""
    full = with_defaults(policies)
    comp, arch = F.col("compression"), F.col("archive")
    positive = lambda name: F.coalesce(F.col(name), F.lit(0)) > 0
    low, high = LEVEL_RANGE
    rules = [
        (~positive("prune_after_hours"), "prune_after_hours must be positive"),
        (~positive("run_interval"), "run_interval must be positive"),
        (_blank(F.col("target_folder")), "target_folder is required"),
        (
            F.col("enable_backup") & (F.size("destinations") == 0),
            "a backup destination is required when backup is on",
        ),
        (
            F.exists("remotes", lambda r: ~r.rlike(REMOTE_PATTERN)),
            "a remote must look like user@host:/path or host:/path",
        ),
        (
            ~F.col("error_threshold_percent").between(0, 100),
            "error_threshold_percent must lie between 0 and 100",
        ),
        (
            comp["enabled"] & ~comp["algorithm"].isin(*ALGORITHM_EXTENSIONS),
            "unknown compression algorithm",
        ),
        (
            comp["enabled"] & (comp["algorithm"] == GZIP) & ~comp["level"].between(low, high),
            "compression level must lie between 1 and 9",
        ),
        (arch["enabled"] & ~arch["format"].isin(*FORMAT_EXTENSIONS), "unknown archive format"),
        (arch["enabled"] & ~arch["group_by"].isin(*GROUPINGS), "unknown archive grouping"),
        (
            arch["enabled"] & comp["enabled"],
            "archive and compression exclude each other",
        ),
    ]
    found = F.array(*[F.when(broken, F.lit(message)) for broken, message in rules])
    return full.withColumn("violations", F.filter(found, lambda v: v.isNotNull()))
