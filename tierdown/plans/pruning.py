"""Removing rows without ever overwriting what is being read.

Two forms. A path gets a new generation with the kept rows, checked against the
counts of the old one, and a view is pointed at it. A partitioned table loses its
dead partitions by metadata alone; only partitions that hold both kinds of rows are
staged and rewritten.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tierdown.functions.age import is_expired, is_retained
from tierdown.operators.joins import skew_safe_join
from tierdown.operators.linking import proven_counts, proven_digests
from tierdown.plans import folders
from tierdown.plans.copying import content_digest
from tierdown.scratch import scratch_dir

_PARTITIONS_PER_STATEMENT = 200


class PruneMismatch(RuntimeError):
    """The rows written are not the rows that should have been kept."""


def split_for_prune(
    df: DataFrame, ts: str, hours: float, as_of: datetime, copies: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(rows to keep, rows that may go).

    With ``copies`` an expired row may go only if they prove it (``split_proven``); without
    them age alone decides. Rows without an age stay.
    """
    if copies is not None:
        return split_proven(df, ts, hours, as_of, copies)
    return df.where(is_retained(df, ts, hours, as_of)), df.where(is_expired(df, ts, hours, as_of))


def split_proven(
    df: DataFrame, ts: str, hours: float, as_of: datetime, copies: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(rows to keep, rows that may go) where copies are incomplete or differ.

    ``copies`` has the columns of ``df`` and ``destination``. An expired row may go only
    if one destination holds rows with exactly its content, and as many of them.
    """
    old, held = _digested(df, ts, hours, as_of, copies)
    proven = proven_digests(old, held, "_digest", "destination")
    goes = skew_safe_join(old, proven, "_digest", "left_semi").select(*df.columns)
    return keep_unproven(df, ts, hours, as_of, proven), goes


def _digested(df: DataFrame, ts: str, hours: float, as_of: datetime, copies: DataFrame) -> tuple[DataFrame, DataFrame]:
    digest = content_digest(df.schema)
    return df.where(is_expired(df, ts, hours, as_of)).withColumn("_digest", digest), copies.withColumn("_digest", digest)


def write_proven(
    df: DataFrame, ts: str, hours: float, as_of: datetime, copies: DataFrame, path: str, size: str | Column | None = None
) -> tuple[int, int]:
    """Writes ``proven_counts`` of ``split_proven`` to ``path``; returns the number of rows that
    may go and the sum of ``size`` over them.

    Copies are read, digested and matched once. What is counted here and what
    ``keep_unproven`` leaves out afterwards come from the same table, whatever becomes of
    the copies in between.
    """
    old, held = _digested(df, ts, hours, as_of, copies)
    observation = Observation()
    total = lambda name: F.coalesce(F.sum(name), F.lit(0)).cast("bigint").alias(name)
    proven_counts(old, held, "_digest", "destination", size).observe(observation, total("items"), total("amount")).write.mode("overwrite").parquet(path)
    return observation.get["items"], observation.get["amount"]


def keep_unproven(df: DataFrame, ts: str, hours: float, as_of: datetime, proven: DataFrame) -> DataFrame:
    """Rows that are not expired, and expired rows whose content is not in ``proven``."""
    old = df.where(is_expired(df, ts, hours, as_of)).withColumn("_digest", content_digest(df.schema))
    stays = skew_safe_join(old, proven.select("_digest"), "_digest", "left_anti").select(*df.columns)
    return df.where(is_retained(df, ts, hours, as_of)).unionByName(stays)


def interrupted(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is what a writer left that never committed: Spark's own working
    folder is still there and its marker of success is not."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(hadoop.Path(folder, "_temporary")) and not files.exists(hadoop.Path(folder, "_SUCCESS"))


def path_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def prune_generation(
    kept: DataFrame, expected: int, path: str, algorithm: str = "snappy"
) -> int:
    """Write the kept rows to a new place and check that there are ``expected`` of them.

    Whatever is at ``path`` already stays: it may be what is being read. Only what an
    interrupted attempt left there, which nothing can read, is replaced.
    """
    observation = Observation()
    counted = kept.observe(observation, F.count(F.lit(1)).alias("items"))
    mode = "overwrite" if interrupted(kept.sparkSession, path) else "errorifexists"
    counted.write.mode(mode).option("compression", algorithm).parquet(path)
    items = observation.get["items"]
    if items != expected:
        # nobody may open it, and the next attempt must find the place free
        folders.remove(kept.sparkSession, [path])
        raise PruneMismatch(f"expected to keep {expected} rows, wrote {items} to {path}")
    return items


def point_view(spark: SparkSession, name: str, path: str) -> None:
    """Readers of ``name`` see the generation at ``path`` from now on."""
    spark.read.parquet(path).createOrReplaceTempView(name)


def _any_of(column: str, values: list) -> Column:
    """Membership that also finds NULL. Only partition values, so the list is short."""
    known = [v for v in values if v is not None]
    found = F.col(column).isin(known)
    return found if len(known) == len(values) else found | F.col(column).isNull()


def _replace_partitions(staged: DataFrame, path: str, chosen: Column, table: str) -> None:
    """Replace exactly the partitions that occur in the chosen rows staged at ``path``.

    The setting for that holds for a session, so it is made in one of its own: writers in
    other threads are not disturbed.
    """
    spark = staged.sparkSession
    own = spark.newSession()
    own.catalog.setCurrentDatabase(spark.catalog.currentDatabase())
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    own.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    rows = own.read.schema(staged.schema).parquet(path)
    rows.where(chosen).select(*staged.columns).write.mode("overwrite").insertInto(table)
    spark.catalog.refreshTable(table)  # this session may know the old files


def _literal(value) -> str:
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return "null" if value is None else f"'{text}'"


def prune_partitions(
    spark: SparkSession,
    table: str,
    ts: str,
    partition: str,
    hours: float,
    as_of: datetime,
    copies: DataFrame | None = None,
) -> dict[str, int]:
    """Prune a table partitioned by one column; returns what was done.

    With ``copies`` (the columns of the table and ``destination``) only rows go that one
    destination holds as they are, and as often; a key alone proves nothing.
    Mixed partitions are staged in shared storage, counted, and only then replaced;
    dead ones are dropped last. After a failure at any point the same call finishes
    the work, since expired rows are found again.
    """
    df = spark.table(table)
    # the cutoff reaches the scan: files and partitions without expired rows are not read
    aged = df.where(is_expired(df, ts, hours, as_of)).groupBy(partition).agg(F.count(F.lit(1)).alias("old"))
    old = {row[partition]: row["old"] for row in aged.collect()}
    report = {"dropped_partitions": 0, "rewritten_partitions": 0, "pruned": 0}
    if not old:
        return report
    touched = df.where(_any_of(partition, list(old)))
    items = {row[partition]: row["items"] for row in touched.groupBy(partition).agg(F.count(F.lit(1)).alias("items")).collect()}
    if copies is None:
        # where all rows are expired nothing can be left, so only mixed partitions are staged
        mixed = [v for v in old if old[v] < items[v]]
        keep = df.where(is_retained(df, ts, hours, as_of))
    else:
        mixed = list(old)
        keep, _ = split_proven(df, ts, hours, as_of, copies)
    left: dict = {}
    if mixed:
        stage = scratch_dir(spark, "prune-stage")
        keep.where(_any_of(partition, mixed)).write.mode("overwrite").parquet(stage)
        staged = spark.read.schema(df.schema).parquet(stage)
        counts = staged.groupBy(partition).agg(F.count(F.lit(1)).alias("items"))
        left = {row[partition]: row["items"] for row in counts.collect()}
    for value in old:
        fewest = items[value] - old[value]
        if not fewest <= left.get(value, 0) <= items[value]:
            raise PruneMismatch(f"partition {value}: staged {left.get(value, 0)} of {items[value]}")
    rewritten = [v for v in old if 0 < left.get(v, 0) < items[v]]
    dead = [v for v in old if left.get(v, 0) == 0]
    if rewritten:
        _replace_partitions(staged, stage, _any_of(partition, rewritten), table)
    for start in range(0, len(dead), _PARTITIONS_PER_STATEMENT):
        some = dead[start : start + _PARTITIONS_PER_STATEMENT]
        specs = ", ".join(f"PARTITION (`{partition}` = {_literal(v)})" for v in some)
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {specs}")
    report["dropped_partitions"] = len(dead)
    report["rewritten_partitions"] = len(rewritten)
    report["pruned"] = sum(items[v] - left.get(v, 0) for v in old)
    return report
