"""A folder tree walked by tasks: every name in it, hidden ones too, level by level.

Spark's own file index runs on the driver and passes over names that start with ``.`` or
``_``. Here the folders of one level are rows; tasks list them, and what they find there
is written to shared storage before the next level starts, so a lost executor repeats
the listing of some folders and nothing else. The driver learns one number per level.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierdown.scratch import scratch_dir

_LISTED = "kind string, rel_path string, mtime_us long, size long, err string"
_FOLDERS_PER_TASK = 64
_ROWS_PER_BATCH = 10_000


def open_root(root: str) -> tuple[pafs.FileSystem, str]:
    """The store that ``root`` is in, and its path there. Runs in tasks; stores are those
    that pyarrow knows (local or mounted folders, HDFS, S3, GCS)."""
    scheme, found, rest = root.partition("://")
    if not found or scheme == "file":
        local = rest if found else root.removeprefix("file:")
        return pafs.LocalFileSystem(), local.rstrip("/") or "/"
    scheme = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
    authority, _, path = rest.partition("/")
    # only scheme and authority are parsed as a URI: keys may hold any character
    store, base = pafs.FileSystem.from_uri(f"{scheme}://{authority}")
    return store, "/".join(filter(None, [base.rstrip("/"), path.rstrip("/")])) or "/"


def below(base: str, key: str) -> str:
    return f"{base.rstrip('/')}/{key}" if key else base


def _entries(store: pafs.FileSystem, base: str, folder: str) -> Iterator[tuple]:
    try:
        for info in store.get_file_info(pafs.FileSelector(below(base, folder))):
            key = f"{folder}/{info.base_name}" if folder else info.base_name
            link = isinstance(store, pafs.LocalFileSystem) and os.path.islink(info.path)
            if info.type == pafs.FileType.File:
                yield "file", key, (info.mtime_ns or 0) // 1000, info.size, None
            elif info.type == pafs.FileType.Directory and not link:
                yield "folder", key, None, None, None
            else:
                yield "error", key, None, None, "a link to a folder is not followed" if link else "neither a file nor a folder"
    except OSError as problem:
        yield "error", folder, None, None, str(problem).splitlines()[0]


def walk_objects(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(every file below ``root``: ``rel_path, mtime, size``; one ``access`` error for each
    folder that could not be listed and each name that is neither file nor folder).

    Hidden names are names like any other. Links to folders are reported, not followed, so
    the walk ends. A folder without files gives no row; a root that is missing gives one
    error. One folder is listed by one task.
    """

    def listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_root(root)
        schema = pa.schema([("kind", pa.string()), ("rel_path", pa.string()), ("mtime_us", pa.int64()), ("size", pa.int64()), ("err", pa.string())])

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        rows: list[tuple] = []
        for folders in batches:
            for folder in folders.column(0):
                for row in _entries(store, base, folder.as_py()):
                    rows.append(row)
                    if len(rows) == _ROWS_PER_BATCH:
                        yield batch(rows)
                        rows = []
        if rows:
            yield batch(rows)

    at = scratch_dir(spark, "walk")
    levels: list[str] = []
    frontier = spark.createDataFrame([("",)], "folder string").coalesce(1)
    waiting = 1
    while waiting:
        levels.append(f"{at}/level-{len(levels)}")
        frontier.mapInArrow(listing, _LISTED).write.mode("overwrite").parquet(levels[-1])
        folders = spark.read.schema(_LISTED).parquet(levels[-1]).where("kind = 'folder'").select("rel_path")
        waiting = folders.count()
        tasks = max(spark.sparkContext.defaultParallelism, waiting // _FOLDERS_PER_TASK)
        frontier = folders.repartition(max(1, min(waiting, tasks)))

    found = spark.read.schema(_LISTED).parquet(*levels)
    files = found.where("kind = 'file'").select("rel_path", F.timestamp_micros("mtime_us").alias("mtime"), "size")
    errors = found.where("kind = 'error'").select(F.col("rel_path").alias("key"), F.lit("access").alias("operation"), "err")
    return files, errors
