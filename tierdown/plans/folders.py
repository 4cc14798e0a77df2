"""Small questions to whatever file system a path is on."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession


def _opened(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def exists(spark: SparkSession, path: str) -> bool:
    files, folder = _opened(spark, path)
    return files.exists(folder)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none if there is no such folder."""
    files, folder = _opened(spark, path)
    if not files.exists(folder):
        return []
    return sorted(status.getPath().getName() for status in files.listStatus(folder))


def committed(spark: SparkSession, path: str) -> bool:
    """Whether a writer finished there."""
    return exists(spark, f"{path.rstrip('/')}/_SUCCESS")


def remove(spark: SparkSession, paths: Iterable[str]) -> int:
    """Remove files or folders; those that are gone already are passed over."""
    removed = 0
    for path in paths:
        files, folder = _opened(spark, path)
        removed += bool(files.delete(folder, True))
    return removed


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file, as it is."""
    files, target = _opened(spark, path)
    out = files.create(target, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
