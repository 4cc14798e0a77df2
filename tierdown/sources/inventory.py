"""Object stores as DataFrames: one row per file.

Spark lists nested folders in parallel jobs once a level has more than
``spark.sql.sources.parallelPartitionDiscovery.threshold`` paths. Names starting
with ``.`` or ``_`` are skipped by Spark's file index.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierdown.functions.naming import relative_key


def _reader(spark: SparkSession, root: str, older_than: datetime | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if older_than is not None:
        # young files are dropped from the listing, so no task is planned for them
        reader = reader.option("modifiedBefore", older_than.isoformat()).option("timeZone", "UTC")
    files = reader.load(root)
    # both paths in the same spelling, whatever scheme the file system adds
    path = F.regexp_replace(F.col("path"), "^file:/+", "/")
    folder = root if "://" in root else F.lit(root.removeprefix("file:"))
    return files.select(
        path.alias("path"),
        F.col("_metadata.file_path").alias("file_uri"),
        F.col("modificationTime").alias("mtime"),
        F.col("length").alias("size"),
        "content",
    ).withColumn("rel_path", relative_key("path", folder))


def file_inventory(
    spark: SparkSession, root: str, older_than: datetime | None = None
) -> DataFrame:
    """Every file below ``root``: path, key, age and size. No file is opened."""
    return _reader(spark, root, older_than).select("path", "rel_path", "file_uri", "mtime", "size")


def object_reader(
    spark: SparkSession, root: str, older_than: datetime | None = None, max_bytes: int = 1 << 30
) -> tuple[DataFrame, DataFrame]:
    """(objects with content, error rows for objects above ``max_bytes``).

    Age is tested on the listing (strictly older, UTC), size by the reader before any
    content is loaded.
    """
    files = _reader(spark, root, older_than)
    objects = files.where(F.col("size") <= max_bytes)
    oversize = files.where(F.col("size") > max_bytes).select(
        F.col("rel_path").alias("key"),
        F.lit("access").alias("operation"),
        F.concat(F.lit("larger than the limit of "), F.lit(max_bytes), F.lit(" bytes")).alias("err"),
    )
    return objects, oversize
