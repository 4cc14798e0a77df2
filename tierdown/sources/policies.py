"""Policies as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_TEXTS = T.ArrayType(T.StringType())

POLICY_SCHEMA = (
    T.StructType()
    .add("prune_after_hours", T.DoubleType())
    .add("target_folder", T.StringType())
    .add("run_interval", T.IntegerType())
    .add("backup_path", T.StringType())
    .add("backup_paths", _TEXTS)
    .add("remote_backup", T.StringType())
    .add("remote_backups", _TEXTS)
    .add("enable_backup", T.BooleanType())
    .add("log_level", T.StringType())
    .add("log_format", T.StringType())
    .add("error_threshold_percent", T.DoubleType())
    .add(
        "compression",
        T.StructType()
        .add("enabled", T.BooleanType())
        .add("algorithm", T.StringType())
        .add("level", T.IntegerType()),
    )
    .add(
        "archive",
        T.StructType()
        .add("enabled", T.BooleanType())
        .add("format", T.StringType())
        .add("group_by", T.StringType()),
    )
)


def read_policies(spark: SparkSession, path: str) -> DataFrame:
    """JSON policy files, one document per file; unknown keys are ignored."""
    return spark.read.schema(POLICY_SCHEMA).option("multiLine", "true").json(path)
