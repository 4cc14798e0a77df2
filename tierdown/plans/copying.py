"""Copies of expired rows in every destination.

Each destination is one write job that scans the source with the age filter pushed
down; nothing is cached or shuffled, because re-reading the filtered source costs
less than keeping it. The jobs of several destinations overlap. While rows are
written, Spark counts and fingerprints them in the same pass; a copy is good only
if reading it back gives the same numbers.
"""

from __future__ import annotations

import posixpath
import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierdown.functions.rates import compression_ratio, space_saved
from tierdown.sources.inventory import file_inventory

# How a numeric level is spelled for the writers' zlib codec.
ZLIB_LEVELS = {
    1: "BEST_SPEED",
    2: "TWO",
    3: "THREE",
    4: "FOUR",
    5: "FIVE",
    6: "SIX",
    7: "SEVEN",
    8: "EIGHT",
    9: "BEST_COMPRESSION",
}
DEFAULT_LEVEL = 6

OUTCOME_SCHEMA = (
    "run_id STRING, phase STRING, destination STRING, path STRING, ok BOOLEAN, err STRING, "
    "items BIGINT, bytes BIGINT, seconds DOUBLE"
)


class BackupFailed(RuntimeError):
    """No destination holds a complete copy."""


@dataclass(frozen=True)
class CopyOutcome:
    """What became of one destination."""

    destination: str
    path: str
    ok: bool
    err: str | None
    items: int
    bytes: int
    seconds: float


def _folder(path: str) -> str:
    """One spelling of a path: scheme variants, doubled and relative steps."""
    scheme, found, rest = path.partition("://")
    if not found:
        scheme, rest = "", path.removeprefix("file:")
    elif scheme == "file":
        scheme = ""
    scheme = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
    return f"{scheme}|{posixpath.normpath('/' + rest)}".rstrip("/") + "/"


def refuse_overlap(source: str, targets: Sequence[str]) -> None:
    """A target inside its own source would be read while it is written, and a source
    inside its target would be written into."""
    for target in targets:
        if _folder(target).startswith(_folder(source)):
            raise ValueError(f"{target} lies in the source {source}")
        if _folder(source).startswith(_folder(target)):
            raise ValueError(f"the source {source} lies in {target}")


def source_folders(df: DataFrame) -> list[str]:
    """Folders of the files behind ``df``: partition folders are left out, and a file that
    is no part of a written folder stands for itself."""
    found = set()
    for path in df.inputFiles():
        folder, _, name = path.rpartition("/")
        while "=" in folder.rpartition("/")[2]:
            folder = folder.rpartition("/")[0]
        found.add(folder if name.startswith("part-") else path)
    return sorted(found)


def refuse_names(df: DataFrame, names: Sequence[str]) -> None:
    """Columns of these names would be taken for the folders that copies are kept in."""
    taken = [c for c in df.columns if c.lower() in names]
    if taken:
        raise ValueError(f"columns {taken} have names of archive folders; rename them before they are copied")


def _codes(field: T.StructField) -> list[Column]:
    """What of a column goes into the fingerprint. ``xxhash64`` passes over NULLs, also
    nested ones, and takes no maps, so nested values are written out first and each
    column says whether it is NULL."""
    column = F.col(f"`{field.name}`")
    nested = (T.ArrayType, T.StructType, T.MapType, T.VariantType)
    value = F.to_json(F.struct(column.alias("v")), {"ignoreNullFields": "false"}) if isinstance(field.dataType, nested) else column
    return [value, column.isNull()]


def content_digest(schema: T.StructType) -> Column:
    """A SHA-256 of a whole row: equal digests are equal rows."""
    parts = [F.when(F.col(f"`{f.name}`").isNull(), "n").otherwise(F.concat(F.lit("v"), _text(f))) for f in schema.fields]
    # each part with its length, so that no two rows are written alike
    return F.sha2(F.concat(*[F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts]), 256)


def _text(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.BinaryType):
        return F.hex(column)
    if isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType, T.VariantType)):
        exact = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
        return F.to_json(F.struct(column.alias("v")), exact)
    return column.cast("string")


def row_code(schema: T.StructType) -> Column:
    """A 64-bit code of a whole row."""
    return F.xxhash64(*[c for f in schema.fields for c in _codes(f)])


def fingerprint_columns(schema: T.StructType, size: str | None = None) -> list[Column]:
    """Aggregates that tell two sets of rows apart, whatever their order."""
    code = row_code(schema)
    return [
        F.count(F.lit(1)).alias("items"),
        F.coalesce(F.sum(code.cast("decimal(20,0)")), F.lit(0)).cast("string").alias("code_sum"),
        F.coalesce(F.bit_xor(code), F.lit(0)).alias("code_xor"),
        F.coalesce(F.sum(F.lit(0) if size is None else F.col(size)), F.lit(0))
        .cast("bigint")
        .alias("bytes"),
    ]


def fingerprint(df: DataFrame, schema: T.StructType | None = None, size: str | None = None) -> dict:
    """One pass, one row: no shuffle beyond a single partial aggregate per task."""
    return df.agg(*fingerprint_columns(schema or df.schema, size)).first().asDict()


def write_compressed(
    df: DataFrame,
    path: str,
    algorithm: str = "none",
    level: int = DEFAULT_LEVEL,
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
    mode: str = "overwrite",
) -> None:
    """Write with a codec and level, or plainly with ``none``."""
    writer = df.write.format(fmt).mode(mode)
    if algorithm == "gzip":
        writer = writer.option("zlib.compress.level", ZLIB_LEVELS[level])
    elif algorithm != "none":
        raise ValueError(f"algorithm must be none or gzip, got {algorithm}")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if algorithm == "none" and fmt == "parquet":
        writer.save(path)  # no codec asked for: that of the session, pages are never stored bare
    else:
        writer.option("compression", algorithm).save(path)


def checked_copy(
    rows: DataFrame,
    schema: T.StructType,
    destination: str,
    path: str,
    write: Callable[[DataFrame, str], None],
    read: Callable[[str], DataFrame],
    size: str | None = None,
) -> CopyOutcome:
    """Write one copy, read it back, and compare both fingerprints.

    ``rows`` must end in the stage that writes, so that retried tasks are counted once.
    """
    started = time.monotonic()
    written = {"items": 0, "bytes": 0}
    err = None
    try:
        observation = Observation()
        write(rows.observe(observation, *fingerprint_columns(schema, size)), path)
        written = observation.get
        found = fingerprint(read(path), schema, size)
        if found != written:
            err = f"copy differs: wrote {written['items']} items, found {found['items']}"
    except Exception as problem:  # one bad destination must not stop the others
        err = (str(problem).strip() or type(problem).__name__).splitlines()[0]
    return CopyOutcome(
        destination, path, err is None, err,
        int(written["items"]), int(written["bytes"]), time.monotonic() - started,
    )


def backup(
    df: DataFrame,
    destinations: Sequence[str],
    run_id: str,
    algorithm: str = "none",
    level: int = DEFAULT_LEVEL,
    size: str | None = None,
    compact: bool = False,
) -> list[CopyOutcome]:
    """All rows to all destinations; one outcome each.

    Every run writes below its own ``run_id``, so a repeated run replaces only itself.
    ``compact`` evens out the files with one shuffle per destination, which is worth
    it when few rows of each source file are expired.
    """
    spark = df.sparkSession
    rows = df.hint("rebalance") if compact else df

    def read(path: str) -> DataFrame:
        return spark.read.schema(df.schema).parquet(path)

    def write(rows: DataFrame, path: str) -> None:
        write_compressed(rows, path, algorithm, level)

    def copy(destination: str) -> CopyOutcome:
        path = f"{destination.rstrip('/')}/run_id={run_id}"
        return checked_copy(rows, df.schema, destination, path, write, read, size)

    refuse_names(df, ["run_id"])
    if not destinations:
        return []
    with ThreadPoolExecutor(max_workers=len(destinations)) as pool:
        return list(pool.map(inheritable_thread_target(spark)(copy), destinations))


def copy_outcomes(
    spark: SparkSession, run_id: str, outcomes: Sequence[CopyOutcome], phase: str = "backup"
) -> DataFrame:
    """The outcomes as a table, one row per destination."""
    rows = [
        (run_id, phase, o.destination, o.path, o.ok, o.err, o.items, o.bytes, o.seconds)
        for o in outcomes
    ]
    return spark.createDataFrame(rows, OUTCOME_SCHEMA)


def stored_sizes(spark: SparkSession, outcomes: Sequence[CopyOutcome]) -> DataFrame:
    """Files, original and stored bytes and their ratio for each good copy.

    Sizes come from the file listing; no copy is opened.
    """
    rows = [(o.destination, o.path, o.bytes) for o in outcomes if o.ok]
    copies = spark.createDataFrame(rows, "destination STRING, path STRING, original_bytes BIGINT")
    listed = spark.createDataFrame([], "path STRING, size BIGINT")
    for _, path, _ in rows:
        files = file_inventory(spark, path).select(F.lit(path).alias("path"), "size")
        listed = listed.unionByName(files)
    stored = listed.groupBy("path").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").cast("bigint").alias("stored_bytes")
    )
    # one row per destination on both sides
    sized = copies.join(F.broadcast(stored), "path", "left").fillna(0, ["files", "stored_bytes"])
    return sized.select(
        "destination",
        "files",
        "original_bytes",
        "stored_bytes",
        compression_ratio("original_bytes", "stored_bytes").alias("compression_ratio"),
        space_saved("original_bytes", "stored_bytes").alias("space_saved"),
    )


def read_copies(
    spark: SparkSession, outcomes: Sequence[CopyOutcome], schema: T.StructType, only_good: bool = True
) -> DataFrame:
    """What the destinations hold, with the ``destination`` of each row."""
    copies = spark.createDataFrame([], schema).withColumn("destination", F.lit(""))
    for outcome in outcomes:
        if only_good and not outcome.ok:
            continue
        try:
            held = spark.read.schema(schema).parquet(outcome.path)
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            continue  # nothing was ever written there
        copies = copies.unionByName(held.withColumn("destination", F.lit(outcome.destination)))
    return copies
