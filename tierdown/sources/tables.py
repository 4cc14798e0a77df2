"""Tables and streams with an age column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table_source(df: DataFrame, ts: str, size: str | None = None, key: str | None = None) -> DataFrame:
    """Checks that ``df`` can be aged, and puts nothing in the way of column pruning."""
    missing = [c for c in (ts, size, key) if c is not None and c not in df.columns]
    if missing:
        raise ValueError(f"no such column: {', '.join(missing)}")
    dtype = df.schema[ts].dataType
    if not isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        raise TypeError(f"{ts} must be a date or timestamp, got {dtype.simpleString()}")
    return df


def file_ages(df: DataFrame) -> DataFrame:
    """One row per file behind a table of any format: path, age, size and row count.

    Only file metadata is asked for, so no data column is read.
    """
    meta = df.select("_metadata.file_path", "_metadata.file_modification_time", "_metadata.file_size")
    return meta.groupBy("file_path").agg(
        F.max("file_modification_time").alias("mtime"),
        F.max("file_size").alias("size"),
        F.count(F.lit(1)).alias("items"),
    )


def event_stream(
    spark: SparkSession, path: str, schema: T.StructType, ts: str, files_per_batch: int | None = None
) -> DataFrame:
    """A file stream whose age column is an instant, as watermarks need it.

    Wall-clock columns without a zone are read as UTC. ``path`` may be a folder or
    one file; ``files_per_batch`` limits what one batch takes.
    """
    # a stream wants a folder or a pattern; this pattern matches just the one name,
    # be it a folder or a single file
    path = path.rstrip("/")
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    stream = reader.parquet(f"{path[:-1]}[{path[-1]}]")
    if isinstance(schema[ts].dataType, T.TimestampType):
        return stream
    wall = F.col(ts).cast("timestamp_ntz")
    local = F.convert_timezone(F.lit("UTC"), F.current_timezone(), wall)
    return stream.withColumn(ts, local.cast("timestamp"))
