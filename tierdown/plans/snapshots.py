"""Pruning at the cost of what expires: a folder of Parquet files under a manifest.

A snapshot says, for each file of a table, how many rows it holds, its oldest and newest
age and how many rows have none. Against a cutoff that makes a file

* dead (all of it is expired): it is not opened, it just leaves the manifest;
* alive (nothing is expired): it is not opened either, the next snapshot refers to it;
* mixed: its remaining rows are written to a new file, which takes its place.

So bytes read and written grow with what expires, not with what stays. Snapshots are
written below ``_tierdown`` in the folder, where Spark's readers do not look, and become
valid with their marker of success; files are removed only after that. ``read_snapshot``
is the table from then on: rewritten rows are not where a plain reader would find them.

Lists that come to the driver are names of files that change, and for reading the names
of all files, which the driver holds for any scan.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import asdict
from datetime import datetime
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierdown.functions.age import is_expired, is_retained
from tierdown.plans import folders
from tierdown.plans.copying import BackupFailed, CopyOutcome, backup, read_copies, refuse_overlap
from tierdown.plans.cycle import COUNTERS, CycleResult, ThresholdExceeded, new_run_id
from tierdown.plans.journal import Journal
from tierdown.plans.pruning import PruneMismatch, interrupted, keep_unproven, path_exists, write_proven
from tierdown.scratch import scratch_dir
from tierdown.sources.inventory import file_inventory

STATE = "_tierdown"
_GLOB = re.compile(r"([\[\]{}*?\\])")


class FileTable:
    """A folder of Parquet files whose rows have an age in ``ts``."""

    def __init__(self, spark: SparkSession, source: str, ts: str, schema: T.StructType | None = None):
        self.spark, self.source, self.ts = spark, source.rstrip("/"), ts
        self.root = f"{self.source}/{STATE}"
        self.schema = schema or spark.read.parquet(self.source).schema

    # ---- files ----

    def read(self, files: Sequence[str]) -> DataFrame:
        """The rows of some files, in the columns of the table. Files of the folder may
        take columns from the names of their folders; rewritten ones hold all columns."""
        own = [f for f in files if f"/{STATE}/" not in f]
        new = [f for f in files if f"/{STATE}/" in f]
        reader = self.spark.read.schema(self.schema)
        parts = []
        if own:
            parts.append(reader.option("basePath", self.source).parquet(*map(_path, own)))
        if new:
            parts.append(self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(*map(_path, new)))
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def _described(self, rows: DataFrame) -> DataFrame:
        """One manifest row per file; of the data only the age column is read."""
        age = F.col(self.ts)
        return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"), age.alias("age")).groupBy("file").agg(
            F.max("bytes").alias("bytes"),
            F.count(F.lit(1)).alias("items"),
            F.count_if(F.col("age").isNull()).alias("ageless"),
            F.min("age").alias("oldest"),
            F.max("age").alias("newest"),
        )

    # ---- snapshots ----

    def snapshots(self) -> list[int]:
        found = [n for n in folders.names(self.spark, self.root) if n.startswith("snapshot-")]
        return [int(n.removeprefix("snapshot-")) for n in found if folders.committed(self.spark, f"{self.root}/{n}")]

    def manifest(self, number: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/snapshot-{number:06d}")

    def _commit(self, number: int, files: DataFrame) -> None:
        files.write.mode("overwrite").parquet(f"{self.root}/snapshot-{number:06d}")

    def refresh(self) -> int:
        """The number of a snapshot that knows every file of the folder. Files that no
        snapshot knows are looked into; the others' entries are taken over."""
        listed = file_inventory(self.spark, self.source).select(F.col("file_uri").alias("file"), "size")
        known = self.snapshots()
        if not known:
            files = self._described(self.spark.read.schema(self.schema).parquet(self.source))
            empty = listed.join(files, "file", "left_anti").where(F.col("file").endswith(".parquet"))
            self._commit(0, self._entries(files, empty))
            return 0
        last = self.manifest(known[-1])
        new = [r.file for r in listed.where(F.col("file").endswith(".parquet")).join(last, "file", "left_anti").collect()]
        if not new:
            return known[-1]
        added = self._described(self.spark.read.schema(self.schema).option("basePath", self.source).parquet(*map(_path, new)))
        empty = self.spark.createDataFrame([(f,) for f in new], "file string").join(added, "file", "left_anti").withColumn("size", F.lit(0).cast("long"))
        self._commit(known[-1] + 1, last.unionByName(self._entries(added, empty)))
        return known[-1] + 1

    def _entries(self, files: DataFrame, empty: DataFrame) -> DataFrame:
        """Files without a row are known too, so that they are not looked into again."""
        zero, none = F.lit(0).cast("long"), F.lit(None).cast(self.schema[self.ts].dataType)
        blank = empty.select("file", F.col("size").alias("bytes"), zero.alias("items"), zero.alias("ageless"), none.alias("oldest"), none.alias("newest"))
        return files.unionByName(blank).withColumn("live", F.lit(True))

    def states(self, number: int, hours: float, as_of: datetime) -> DataFrame:
        """The live files of a snapshot with ``state``: dead, alive or mixed."""
        files = self.manifest(number).where("live")
        some = is_expired(files, "oldest", hours, as_of)
        every = is_expired(files, "newest", hours, as_of) & (F.col("ageless") == 0)
        return files.withColumn("state", F.when(every, "dead").when(F.coalesce(some, F.lit(False)), "mixed").otherwise("alive"))

    def current(self) -> DataFrame:
        """The table as of its newest snapshot."""
        live = self.manifest(self.snapshots()[-1]).where("live and items > 0")
        return self.read([r.file for r in live.select("file").collect()])


def _path(uri: str) -> str:
    return _GLOB.sub(r"\\\1", unquote(uri))


def read_snapshot(spark: SparkSession, source: str, ts: str, schema: T.StructType | None = None) -> DataFrame:
    return FileTable(spark, source, ts, schema).current()


def _changed(table: FileTable, number: int, hours: float, as_of: datetime) -> dict:
    """What a cutoff does to the files of a snapshot; of mixed ones the ages are read."""
    states = table.states(number, hours, as_of)
    counts = {r.state: r for r in states.groupBy("state").agg(F.count(F.lit(1)).alias("files"), F.sum("items").alias("items"), F.sum("bytes").alias("bytes")).collect()}
    names = {"dead": [], "mixed": []}
    for row in states.where("state <> 'alive'").select("file", "state").collect():
        names[row.state].append(row.file)
    mixed = table.read(names["mixed"])
    old = mixed.where(is_expired(mixed, table.ts, hours, as_of)).count() if names["mixed"] else 0
    part = lambda state, what: int(counts[state][what] or 0) if state in counts else 0
    return {
        "number": number,
        **{f"{state}_files": part(state, "files") for state in ("dead", "mixed", "alive")},
        "dead": names["dead"],
        "mixed": names["mixed"],
        "expired": part("dead", "items") + old,
        "stays_in_mixed": part("mixed", "items") - old,
        "total": sum(part(s, "items") for s in ("dead", "mixed", "alive")),
    }


def _stage(table: FileTable, found: dict, kept: DataFrame | None, expected: int) -> dict:
    """Write what stays of the files that go, and check it. Nothing refers to it yet, so
    a second attempt replaces it."""
    path = f"{table.root}/data-{found['number'] + 1:06d}"
    if kept is None or expected == 0:
        return {"data": None, "rewritten": 0, "bytes": 0}
    kept.write.mode("overwrite").parquet(path)
    written = table._described(table.spark.read.schema(table.schema).parquet(path)).agg(F.sum("items").alias("n"), F.sum("bytes").alias("b")).first()
    if (written.n or 0) != expected:
        folders.remove(table.spark, [path])
        raise PruneMismatch(f"expected to keep {expected} rows of {len(found['mixed'])} files, wrote {written.n}")
    return {"data": path, "rewritten": expected, "bytes": int(written.b)}


def _switch(table: FileTable, found: dict, staged: dict) -> dict:
    """The next snapshot: files that go are no longer live, what was staged is."""
    number = found["number"] + 1
    if number not in table.snapshots():
        gone = table.spark.createDataFrame([(f,) for f in [*found["dead"], *found["mixed"]]], "file string").withColumn("gone", F.lit(True))
        files = table.manifest(found["number"]).join(gone, "file", "left")
        files = files.withColumn("live", F.col("live") & F.col("gone").isNull()).drop("gone")
        if staged["data"] is not None:
            added = table._described(table.spark.read.schema(table.schema).parquet(staged["data"]))
            files = files.unionByName(added.withColumn("live", F.lit(True)))
        table._commit(number, files)
    return {"snapshot": number}


def _remove(table: FileTable, found: dict) -> dict:
    """Files that no snapshot from now on refers to. A file that is gone already was
    removed by an attempt before this one."""
    return {"removed": folders.remove(table.spark, [unquote(f) for f in [*found["dead"], *found["mixed"]]])}


def prune_files(
    spark: SparkSession,
    source: str,
    ts: str,
    hours: float,
    as_of: datetime,
    schema: T.StructType | None = None,
    run_id: str | None = None,
) -> dict:
    """Remove expired rows from a folder of Parquet files, file by file.

    Returns counts: files dead, mixed and alive, rows pruned and kept, rows and bytes
    rewritten, and the number of the new snapshot. The same call with the same ``run_id``
    goes on where an interrupted one stopped. Without expired rows no snapshot is made.
    """
    table = FileTable(spark, source, ts, schema)
    journal = Journal(spark, f"{table.root}/journal", run_id or new_run_id())
    found = journal.once("counted", lambda: _changed(table, table.refresh(), hours, as_of))
    return _pruned(table, journal, found, lambda: _kept_of_mixed(table, found, hours, as_of), found["stays_in_mixed"])


def _kept_of_mixed(table: FileTable, found: dict, hours: float, as_of: datetime) -> DataFrame | None:
    if not found["mixed"]:
        return None
    rows = table.read(found["mixed"])
    return rows.where(is_retained(rows, table.ts, hours, as_of))


def _pruned(table: FileTable, journal: Journal, found: dict, kept: Callable[[], DataFrame | None], expected: int) -> dict:
    changed = bool(found["dead"] or found["mixed"])
    staged = journal.once("staged", lambda: _stage(table, found, kept(), expected) if changed else {"data": None, "rewritten": 0, "bytes": 0})
    switched = journal.once("committed", lambda: _switch(table, found, staged) if changed else {"snapshot": found["number"]})
    removed = journal.once("removed", lambda: _remove(table, found) if changed else {"removed": 0})
    gone = found["expired"] + found["stays_in_mixed"] - expected
    counts = {k: found[k] for k in ("dead_files", "mixed_files", "alive_files")}
    return {**counts, "pruned": gone, "kept": found["total"] - gone, "rewritten": staged["rewritten"], "bytes_written": staged["bytes"], **switched, **removed}


def _metrics(found: dict, outcomes: Sequence[CopyOutcome], safe: int, moved: int) -> dict:
    failed = found["expired"] - safe
    return dict.fromkeys(COUNTERS, 0) | {
        "succeeded": safe,
        "failed": failed,
        "skipped": found["total"] - found["expired"],
        "backed_up": safe,
        "copies": sum(o.ok for o in outcomes),
        "total_bytes": moved,
        "failure_rate": failed / found["expired"] * 100 if found["expired"] else 0.0,
    }


def backup_then_prune_files(
    spark: SparkSession,
    source: str,
    ts: str,
    hours: float,
    as_of: datetime,
    destinations: Sequence[str],
    size: Column | None = None,
    run_id: str | None = None,
    schema: T.StructType | None = None,
    algorithm: str = "none",
    error_threshold_percent: float = 0.0,
) -> CycleResult:
    """A whole run over a folder of Parquet files, in which alive files are never opened.

    Expired rows go to every destination. With one complete copy all of them are pruned;
    with incomplete ones only rows that some destination holds as they are, and the rest
    is kept. Steps are journalled (counted, copied, staged, committed, removed): a run that
    was interrupted anywhere goes on from there when it is called with its ``run_id``.
    ``size`` is what one row counts in ``total_bytes``.
    """
    refuse_overlap(source, destinations)
    run_id = run_id or new_run_id()
    table = FileTable(spark, source, ts, schema)
    journal = Journal(spark, f"{table.root}/journal", run_id)
    found = journal.once("counted", lambda: _changed(table, table.refresh(), hours, as_of))
    going = [*found["dead"], *found["mixed"]]
    weight = F.lit(0) if size is None else size

    def expired_rows() -> DataFrame:
        rows = table.read(going)
        return rows.where(is_expired(rows, ts, hours, as_of))

    def prove(outcomes: list[CopyOutcome], path: str) -> tuple[int, int]:
        held = read_copies(spark, outcomes, table.schema, only_good=False)
        return write_proven(table.read(going), ts, hours, as_of, held, path, size)

    def copy() -> dict:
        outcomes = backup(expired_rows(), destinations, run_id, algorithm)
        safe, stays = found["expired"], found["stays_in_mixed"]
        amount = F.coalesce(F.sum(weight), F.lit(0)).cast("bigint")
        complete, proven = any(o.ok and o.items == found["expired"] for o in outcomes), None
        if complete:
            moved = expired_rows().agg(amount).first()[0]
        else:
            proven = scratch_dir(spark, "proven")
            safe, moved = prove(outcomes, proven)
            stays += found["expired"] - safe
        metrics = _metrics(found, outcomes, safe, moved)
        # a run that fails here has no record of this step, so that its next attempt copies anew
        if 0 < error_threshold_percent < metrics["failure_rate"]:
            raise ThresholdExceeded(CycleResult(run_id, metrics, outcomes), error_threshold_percent)
        if found["expired"] and not safe:
            raise BackupFailed("; ".join(f"{o.destination}: {o.err}" for o in outcomes))
        return {"outcomes": [asdict(o) for o in outcomes], "proven": proven, "complete": complete, "metrics": metrics, "stays": stays}

    copied = journal.once("copied", copy)
    metrics, outcomes = copied["metrics"], [CopyOutcome(**o) for o in copied["outcomes"]]
    result = CycleResult(run_id, metrics, outcomes, table.root)

    def kept() -> DataFrame | None:
        if copied["complete"]:
            return _kept_of_mixed(table, found, hours, as_of)
        proven = copied.get("proven") or scratch_dir(spark, "proven")
        # the shared folder may have been cleared since
        if not path_exists(spark, proven) or interrupted(spark, proven):
            prove(outcomes, proven)
        return keep_unproven(table.read(going), ts, hours, as_of, spark.read.parquet(proven))

    report = _pruned(table, journal, found, kept, copied["stays"])
    metrics["pruned"], metrics["kept"] = report["pruned"], report["kept"]
    return result
