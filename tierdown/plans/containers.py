"""Containers by calendar bucket, and the way back.

A container is one ``bucket=`` folder of Parquet below ``run_id=``. Rows are
rebalanced by bucket before the write: small buckets end up in few files, and a
bucket that holds a large share of all rows is split over many tasks by adaptive
execution instead of going through one.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierdown.functions.age import cutoff
from tierdown.functions.naming import DEFAULT_FORMAT, FORMAT_EXTENSIONS, archive_bucket
from tierdown.operators.restoring import latest_copies, split_unsafe_keys
from tierdown.plans.copying import (
    DEFAULT_LEVEL,
    CopyOutcome,
    checked_copy,
    refuse_names,
    refuse_overlap,
    write_compressed,
)
from tierdown.sources.inventory import object_reader

BUCKET = "bucket"
RUN = "run_id"


def codec(format: str) -> str:
    # a plain container is stored plainly, the compressed ones with the same deflate codec
    if format not in FORMAT_EXTENSIONS:
        raise ValueError(f"format must be one of {tuple(FORMAT_EXTENSIONS)}, got {format}")
    return "none" if format == "tar" else "gzip"


def _to_all(
    bucketed: DataFrame,
    schema: T.StructType,
    destinations: Sequence[str],
    run_id: str,
    format: str,
    level: int,
    size: str | None,
) -> list[CopyOutcome]:
    """The first copy is shuffled into place; later ones are made from a good copy."""
    spark = bucketed.sparkSession
    stored = T.StructType([*schema.fields, T.StructField(BUCKET, T.StringType())])
    outcomes: list[CopyOutcome] = []

    def read(path: str) -> DataFrame:
        return spark.read.schema(stored).parquet(path)

    def write(rows: DataFrame, path: str) -> None:
        write_compressed(rows, path, codec(format), level, partition_by=[BUCKET])

    for destination in destinations:
        path = f"{destination.rstrip('/')}/{RUN}={run_id}"
        good = next((o for o in outcomes if o.ok), None)
        rows = bucketed.hint("rebalance", BUCKET) if good is None else read(good.path)
        outcomes.append(checked_copy(rows, stored, destination, path, write, read, size))
    return outcomes


def archive_table(
    df: DataFrame,
    ts: str,
    destinations: Sequence[str],
    run_id: str,
    group_by: str = "daily",
    format: str = DEFAULT_FORMAT,
    level: int = DEFAULT_LEVEL,
    size: str | None = None,
    bucket_by: str = "item",
    run_time: datetime | None = None,
) -> list[CopyOutcome]:
    """Bundle rows by the bucket of their own age, or by that of the run.

    With ``bucket_by='run'`` everything goes into the one bucket of ``run_time``.
    """
    refuse_names(df, [BUCKET, RUN])
    if bucket_by == "run":
        if run_time is None:
            raise ValueError("bucket_by='run' needs run_time")
        instant = F.lit(run_time.isoformat(sep=" ")).cast("timestamp_ntz")
    else:
        instant = F.col(ts)
    bucketed = df.withColumn(BUCKET, archive_bucket(instant, group_by))
    return _to_all(bucketed, df.schema, destinations, run_id, format, level, size)


def archive_objects(
    spark: SparkSession,
    root: str,
    destinations: Sequence[str],
    run_id: str,
    hours: float,
    as_of: datetime,
    group_by: str = "daily",
    format: str = DEFAULT_FORMAT,
    level: int = DEFAULT_LEVEL,
    max_bytes: int = 1 << 30,
) -> tuple[list[CopyOutcome], DataFrame]:
    """Opaque files with their key, age and bytes, in splittable containers.

    Returns the outcomes and the error rows of files too large for one row.
    """
    refuse_overlap(root, destinations)
    objects, oversize = object_reader(spark, root, cutoff(as_of, hours), max_bytes)
    items = objects.select("rel_path", "mtime", "size", "content")
    bucketed = items.withColumn(BUCKET, archive_bucket("mtime", group_by))
    outcomes = _to_all(bucketed, items.schema, destinations, run_id, format, level, "size")
    return outcomes, oversize


def open_archive(spark: SparkSession, root: str, schema: T.StructType | None = None) -> DataFrame:
    """All runs and buckets below ``root``; both stay text, whatever they look like.

    ``schema`` is that of the archived rows; without it one file is asked.
    """
    if schema is None:
        schema = spark.read.parquet(root).schema
    fields = [f for f in schema.fields if f.name not in (RUN, BUCKET)]
    fields += [T.StructField(RUN, T.StringType()), T.StructField(BUCKET, T.StringType())]
    return spark.read.schema(T.StructType(fields)).parquet(root)


def restore(
    spark: SparkSession,
    root: str,
    key: str,
    buckets: Sequence[str] | None = None,
    as_of_run: str | None = None,
    schema: T.StructType | None = None,
) -> DataFrame:
    """The newest copy of every key, optionally only from some buckets or older runs.

    Buckets and runs are folders, so both conditions prune files.
    """
    archive = open_archive(spark, root, schema)
    if buckets is not None:
        archive = archive.where(F.col(BUCKET).isin(*buckets))
    if as_of_run is not None:
        archive = archive.where(F.col(RUN) <= as_of_run)
    return latest_copies(archive, key, RUN)


def restore_objects(
    spark: SparkSession,
    root: str,
    buckets: Sequence[str] | None = None,
    as_of_run: str | None = None,
    key: str = "rel_path",
) -> tuple[DataFrame, DataFrame]:
    """(objects to put back, error rows for keys that would leave the folder)."""
    return split_unsafe_keys(restore(spark, root, key, buckets, as_of_run), key)


def archive_sizes(archive: DataFrame, bucket: str = BUCKET) -> DataFrame:
    """Items, files and stored bytes per container, from file metadata alone."""
    files = archive.select(bucket, "_metadata.file_path", "_metadata.file_size")
    per_file = files.groupBy(bucket, "file_path").agg(
        F.max("file_size").alias("file_size"), F.count(F.lit(1)).alias("items")
    )
    return per_file.groupBy(bucket).agg(
        F.sum("items").cast("bigint").alias("items"),
        F.count(F.lit(1)).alias("files"),
        F.sum("file_size").cast("bigint").alias("archive_size"),
    )
