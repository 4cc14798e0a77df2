"""Mending a copy from a good one by reconciliation.

Both copies are summed up as a tree of digests: ranges of row codes below the container
they are in, each with a count and two sums. A tree can be recorded when a copy is made,
so that the good side need not be read to be compared. Only rows in ranges that differ
are matched by the digest of their whole content; missing ones are added as new files,
and files that hold rows they should not are written anew without them. All other files
keep their names and times.
"""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierdown.plans import folders
from tierdown.plans.containers import BUCKET
from tierdown.plans.copying import content_digest, fingerprint_columns, refuse_overlap, row_code, write_compressed
from tierdown.scratch import scratch_dir
from tierdown.sources.inventory import file_inventory
from tierdown.sources.readable import read_with_errors

RANGE_ROWS = 10_000
_LEAST_RANGES = 64
_SUMS = ("items", "code_sum", "code_xor")


class RepairFailed(RuntimeError):
    """The copy still differs after its repair."""


@dataclass(frozen=True)
class Repair:
    """What was found and done. ``added`` counts rows written from the good copy."""

    ranges: int
    differing: int
    added: int
    dropped: int
    rewritten: tuple[str, ...]
    unreadable: tuple[str, ...]


def _held(spark: SparkSession, path: str, schema: T.StructType, tolerant: bool = False) -> DataFrame:
    """The rows of one copy with their container; plain copies have none."""
    bucketed = any(name.startswith(f"{BUCKET}=") for name in folders.names(spark, path))
    stored = T.StructType([*schema.fields, T.StructField(BUCKET, T.StringType())]) if bucketed else schema
    reader = spark.read.schema(stored)
    if tolerant:
        reader = reader.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    rows = reader.parquet(path)
    return rows if bucketed else rows.withColumn(BUCKET, F.lit(None).cast("string"))


def _tree_path(path: str) -> str:
    parent, _, name = path.rstrip("/").rpartition("/")
    return f"{parent}/_trees/of-{name}"


def _range(schema: T.StructType, ranges: int) -> Column:
    return F.pmod(row_code(schema), F.lit(ranges).cast("long"))


def _tree(rows: DataFrame, schema: T.StructType, ranges: int) -> DataFrame:
    # partial sums per task: what is shuffled is one row per container, range and task
    return rows.groupBy(BUCKET, _range(schema, ranges).alias("part")).agg(*fingerprint_columns(schema)).select(BUCKET, "part", *_SUMS)


def record_tree(spark: SparkSession, path: str, schema: T.StructType) -> int:
    """Write the tree of a copy beside it; returns the number of ranges of a container.

    That number follows the rows, so that a range has about ``RANGE_ROWS`` of them if
    there is one container, and fewer otherwise.
    """
    rows = _held(spark, path, schema)
    ranges = max(_LEAST_RANGES, rows.count() // RANGE_ROWS)
    tree = _tree(rows, schema, ranges).withColumn("ranges", F.lit(ranges).cast("long"))
    tree.write.mode("overwrite").parquet(_tree_path(path))
    return ranges


def _recorded(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, int]:
    at = _tree_path(path)
    if not folders.committed(spark, at):
        record_tree(spark, path, schema)
    tree = spark.read.schema(f"{BUCKET} string, part long, items long, code_sum string, code_xor long, ranges long").parquet(at)
    first = tree.select("ranges").first()
    return tree.drop("ranges"), _LEAST_RANGES if first is None else first.ranges


def _same(one: str, other: str, columns: tuple[str, ...]) -> Column:
    test = F.lit(True)
    for name in columns:
        test = test & F.col(f"{one}.{name}").eqNullSafe(F.col(f"{other}.{name}"))
    return test


def _differing(good: DataFrame, bad: DataFrame) -> DataFrame:
    both = good.alias("g").join(bad.alias("b"), _same("g", "b", (BUCKET, "part")), "full_outer")
    found = F.coalesce(F.col("g.part"), F.col("b.part")).alias("part")
    of = F.when(F.col("g.part").isNotNull(), F.col(f"g.{BUCKET}")).otherwise(F.col(f"b.{BUCKET}")).alias(BUCKET)
    return both.where(~_same("g", "b", _SUMS)).select(of, found)


def _among(rows: DataFrame, other: DataFrame, columns: tuple[str, ...], how: str) -> DataFrame:
    return rows.alias("r").join(other.alias("o"), _same("r", "o", columns), how)


def repair_copy(
    spark: SparkSession,
    good: str,
    bad: str,
    schema: T.StructType,
    algorithm: str = "gzip",
) -> Repair:
    """Make the copy below ``bad`` hold the rows that the one below ``good`` holds, as often.

    Both are folders of one run (``<destination>/run_id=<id>``), plain or in containers;
    ``schema`` is that of the rows. Files of ``bad`` that cannot be read in full are
    replaced. New files are there before old ones are removed, so a run that is cut off
    leaves rows too often and never too few; the next run finds and mends that. Equal
    rows are one row as often as it occurs. A tree recorded for ``good`` is taken as it
    is (``record_tree``). Names of files that change and of containers that differ come
    to the driver.
    """
    refuse_overlap(good, [bad])
    tree, ranges = _recorded(spark, good, schema)
    listed = file_inventory(spark, bad)
    _, errors = read_with_errors(listed, lambda s: _held(s, bad, schema, tolerant=True))
    broken = sorted(row.key for row in errors.select("key").collect())
    uri = F.col("_metadata.file_path")

    def readable() -> DataFrame:
        rows = _held(spark, bad, schema, tolerant=bool(broken))
        return rows.where(~uri.isin(broken)) if broken else rows

    at = scratch_dir(spark, "repair")
    _differing(tree, _tree(readable(), schema, ranges)).write.parquet(f"{at}/ranges")
    differing = spark.read.schema(f"{BUCKET} string, part long").parquet(f"{at}/ranges")
    counted = differing.count()
    if not counted:
        folders.remove(spark, map(unquote, broken))
        return Repair(ranges, 0, 0, 0, (), tuple(broken))
    buckets = [row[BUCKET] for row in differing.select(BUCKET).distinct().collect()]

    def touched(rows: DataFrame) -> DataFrame:
        # folders of other containers are not read
        some = F.col(BUCKET).isin([b for b in buckets if b is not None])
        return rows.where(some | F.col(BUCKET).isNull() if None in buckets else some)

    names = [f.name for f in schema.fields]
    columns = [F.col(f"`{name}`") for name in names]
    part, digest = _range(schema, ranges).alias("part"), content_digest(schema).alias("digest")
    marked = ("digest", BUCKET)
    sound = _among(touched(_held(spark, good, schema)).select(*columns, BUCKET, part, digest), differing, (BUCKET, "part"), "left_semi")
    hurt = _among(touched(readable()).select(BUCKET, part, digest, uri.alias("file")), differing, (BUCKET, "part"), "left_semi")
    needed = sound.groupBy(*marked).agg(F.count(F.lit(1)).alias("n"))
    found = hurt.groupBy(*marked).agg(F.count(F.lit(1)).alias("n"))
    both = needed.alias("g").join(found.alias("b"), _same("g", "b", marked), "full_outer")
    need, have = (F.coalesce(F.col(f"{side}.n"), F.lit(0)) for side in "gb")
    both.where(need != have).select(
        F.coalesce("g.digest", "b.digest").alias("digest"),
        F.when(F.col("g.digest").isNotNull(), F.col(f"g.{BUCKET}")).otherwise(F.col(f"b.{BUCKET}")).alias(BUCKET),
        # what there is too much of is taken away altogether and written as often as needed
        F.when(have > need, need).otherwise(need - have).alias("added"),
        F.when(have > need, have).otherwise(0).cast("long").alias("dropped"),
    ).write.parquet(f"{at}/rows")
    changes = spark.read.schema(f"digest string, {BUCKET} string, added long, dropped long").parquet(f"{at}/rows")
    sums = changes.agg(F.sum("added").alias("added"), F.sum("dropped").alias("dropped")).first()

    surplus = changes.where("dropped > 0")
    files = sorted(row.file for row in _among(hurt, surplus, marked, "left_semi").select("file").distinct().collect())
    once = sound.dropDuplicates(["digest", BUCKET]).alias("r")
    added = once.join(changes.where("added > 0").alias("o"), _same("r", "o", marked)).select(
        *[F.col(f"r.`{name}`") for name in names], F.col(f"r.{BUCKET}"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("o.added"))).alias("_n")
    ).drop("_n")
    stay = _among(readable().where(uri.isin(files)).select(*columns, BUCKET, digest), surplus, marked, "left_anti").drop("digest") if files else None
    rows = added if stay is None else stay.unionByName(added)
    bucketed = buckets != [None] or any(n.startswith(f"{BUCKET}=") for n in folders.names(spark, good))
    if bucketed:
        write_compressed(rows.hint("rebalance", BUCKET), bad, algorithm, partition_by=[BUCKET], mode="append")
    else:
        write_compressed(rows.drop(BUCKET).hint("rebalance"), bad, algorithm, mode="append")
    folders.remove(spark, map(unquote, [*files, *broken]))

    spark.catalog.refreshByPath(bad)
    left = _differing(touched(tree), _tree(touched(_held(spark, bad, schema)), schema, ranges)).count()
    if left:
        raise RepairFailed(f"{left} ranges of {bad} differ from {good} after the repair")
    return Repair(ranges, counted, sums["added"] or 0, sums["dropped"] or 0, tuple(files), tuple(broken))
