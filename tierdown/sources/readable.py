"""Reading what can be read, and reporting the rest."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierdown.operators.linking import unread_items

_TEXT_FORMATS = ("text", "csv", "json")


_STEP = 1 << 20


def _stream_fault(content: bytes) -> str | None:
    """What is wrong with a gzip file of one or more members. Its end mark and checksum are
    tested by decoding it, a megabyte at a time, and keeping nothing."""
    rest = memoryview(content)
    while True:
        member = zlib.decompressobj(31)
        try:
            while not member.eof:
                if not member.unconsumed_tail and not rest:
                    return "the stream ends before its end mark"
                piece = member.unconsumed_tail or bytes(rest[:_STEP])
                if not member.unconsumed_tail:
                    rest = rest[_STEP:]
                member.decompress(piece, _STEP)
        except zlib.error as problem:
            return f"the stream is broken: {problem}"
        left = member.unused_data + bytes(rest)
        if not left.strip(b"\0"):
            return None  # zeros after the last member are padding
        rest = memoryview(left)


def broken_streams(spark: SparkSession, path: str) -> DataFrame:
    """One ``access`` error for each ``.gz`` file below ``path`` that is cut off or damaged.

    Text formats state no number of rows, and Spark passes over a broken stream without a
    word when it is told to go on, so completeness is proven by the stream itself.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(uri.as_py(), _stream_fault(content.as_py())) for uri, content in zip(*batch.columns)]
            found = [(uri, "access", fault) for uri, fault in rows if fault is not None]
            columns = zip(*found) if found else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["key", "operation", "err"])

    named = files.where(F.col("length") > 0).select(F.col("_metadata.file_path").alias("file_uri"), "content")
    return named.mapInArrow(check, "key string, operation string, err string")


def read_with_errors(
    inventory: DataFrame, read_fn: Callable[[SparkSession], DataFrame], streams: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(rows of the readable files, one ``access`` error per unreadable file).

    ``read_fn`` returns a file-based DataFrame. Spark skips missing and corrupt
    files without a word, so the rows that each file really delivers, with all columns
    decoded, are counted and compared with the inventory and with the count that the
    file states (for formats that have one, like Parquet). A file that breaks half-way
    is an error too, though the rows before the break are among the good ones. Empty
    files deliver nothing and are not errors. ``streams`` are errors found otherwise
    (``broken_streams``); a file that is among them is reported once, with what they say.
    """
    spark = inventory.sparkSession
    good = read_fn(spark)
    path = F.col("_metadata.file_path").alias("file_uri")
    # hashing every column is what makes the reader decode every page
    decoded = good.select(path, F.hash(F.struct(*good.columns)).alias("code"))
    delivered = decoded.groupBy("file_uri").agg(F.count("code").alias("rows"), F.max("code").alias("code"))
    stated = good.select(path).groupBy("file_uri").agg(F.count(F.lit(1)).alias("stated"))
    broken = stated.join(delivered.select("file_uri", "rows"), "file_uri", "left").where("coalesce(rows, 0) < stated")
    listed = inventory.where(F.col("size") > 0)
    errors = unread_items(listed, stated, "file_uri").unionByName(
        broken.select(
            F.col("file_uri").alias("key"),
            F.lit("access").alias("operation"),
            F.format_string("%d of %d rows were readable", F.coalesce("rows", F.lit(0)), F.col("stated")).alias("err"),
        )
    )
    if streams is not None:
        errors = errors.join(streams.select("key"), "key", "left_anti").unionByName(streams)
    return good, errors


def tolerant(spark: SparkSession, fmt: str, path: str, schema=None, **options: str) -> DataFrame:
    """A read that skips files it cannot open instead of failing the job. With a ``schema``
    no file is opened to find one."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return (
        reader.format(fmt)
        .options(**options)
        .option("ignoreMissingFiles", "true")
        .option("ignoreCorruptFiles", "true")
        .option("recursiveFileLookup", "true")
        .load(path)
    )


def decompress_read(spark: SparkSession, path: str, fmt: str = "text", schema=None) -> DataFrame:
    """Text formats, plain or compressed: the codec follows from the file name."""
    if fmt not in _TEXT_FORMATS:
        raise ValueError(f"format must be one of {_TEXT_FORMATS}, got {fmt}")
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)
