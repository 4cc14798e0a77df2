"""One whole run: copy, check, gate, prune, report."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tierdown.functions.age import is_expired
from tierdown.functions.naming import DEFAULT_FORMAT
from tierdown.operators.linting import policy_lint
from tierdown.operators.planning import archive_plan, destination_plan, dry_run
from tierdown.operators.retention import expired, retained
from tierdown.plans.containers import archive_table
from tierdown.plans.copying import (
    DEFAULT_LEVEL,
    BackupFailed,
    CopyOutcome,
    backup,
    copy_outcomes,
    read_copies,
    refuse_overlap,
    source_folders,
)
from tierdown.plans.pruning import interrupted, keep_unproven, path_exists, prune_generation, write_proven
from tierdown.scratch import scratch_dir

COUNTERS = (
    "succeeded", "failed", "skipped", "backed_up", "pruned", "kept", "copies", "total_bytes",
)


class ThresholdExceeded(RuntimeError):
    """Too many items failed, so nothing was pruned."""

    def __init__(self, result: CycleResult, percent: float):
        rate = result.metrics["failure_rate"]
        super().__init__(f"{rate:.1f}% of the items failed, more than the {percent:.1f}% allowed")
        self.result = result


class RunCancelled(RuntimeError):
    """The run was asked to stop before it removed anything."""


class PolicyError(ValueError):
    """The policy breaks a rule."""


@dataclass
class CycleResult:
    run_id: str
    metrics: dict
    copies: list[CopyOutcome] = field(default_factory=list)
    kept_path: str | None = None

    def to_df(self, spark: SparkSession) -> DataFrame:
        counters = [int(self.metrics[name]) for name in COUNTERS]
        row = (self.run_id, *counters, float(self.metrics["failure_rate"]))
        schema = ", ".join(f"{name} BIGINT" for name in COUNTERS)
        return spark.createDataFrame([row], f"run_id STRING, {schema}, failure_rate DOUBLE")


def _counts(df: DataFrame, ts: str, hours: float, as_of: datetime, size: str | None) -> dict:
    old = is_expired(df, ts, hours, as_of)
    amount = F.lit(0) if size is None else F.col(size)
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(old).alias("old"),
        F.coalesce(F.sum(F.when(old, amount)), F.lit(0)).cast("bigint").alias("bytes"),
    ).first().asDict()


def _stop_if_asked(should_stop: Callable[[], bool], phase: str) -> None:
    if should_stop():
        raise RunCancelled(f"stopped before {phase}")


def new_run_id() -> str:
    """Ids sort by the time they were made, so the newest run is the largest id."""
    return f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"


def plan_cycle(
    df: DataFrame,
    ts: str,
    hours: float,
    as_of: datetime,
    destinations: Sequence[str],
    key: str,
    size: str,
    group_by: str | None = None,
    algorithm: str = "none",
) -> DataFrame:
    """The dry run: what a run would write where. Nothing is created."""
    old = expired(df, ts, hours, as_of)
    if group_by is not None:
        plan = archive_plan(old, destinations, ts, group_by)
        return dry_run(plan, size, ["destination", "target_path"])
    plan = destination_plan(old, destinations, key, algorithm)
    return dry_run(plan, size)


def backup_then_prune(
    df: DataFrame,
    ts: str,
    hours: float,
    as_of: datetime,
    kept_path: str,
    destinations: Sequence[str] = (),
    key: str | None = None,
    size: str | None = None,
    run_id: str | None = None,
    group_by: str | None = None,
    format: str = DEFAULT_FORMAT,
    algorithm: str = "none",
    level: int = DEFAULT_LEVEL,
    error_threshold_percent: float = 0.0,
    enable_backup: bool = True,
    prune_unbacked: bool = False,
    should_stop: Callable[[], bool] = lambda: False,
) -> CycleResult:
    """Back up what is expired, then keep the rest in a new generation at ``kept_path``.

    ``group_by`` turns on archive mode. An item counts as backed up if any
    destination holds it. When one destination has a complete, verified copy every
    expired row is safe and no join is needed. Otherwise, if a ``key`` is named, rows are
    matched with what the incomplete copies really hold, by their whole content and as
    often as it occurs, and unmatched rows are kept; a key alone proves nothing.
    ``prune_unbacked`` removes them all the same. With ``enable_backup`` off, age
    alone decides. Any error before the prune leaves the source as it is.
    ``should_stop`` is asked before the copies and before the prune.
    """
    spark = df.sparkSession
    _stop_if_asked(should_stop, "the backup")
    for source in source_folders(df):
        refuse_overlap(source, [kept_path, *destinations])
    if path_exists(spark, kept_path) and not interrupted(spark, kept_path):
        raise FileExistsError(f"{kept_path} already exists; a generation takes a new path")
    run_id = run_id or new_run_id()
    old = expired(df, ts, hours, as_of)
    counts = _counts(df, ts, hours, as_of, size)
    metrics = dict.fromkeys(COUNTERS, 0) | {"failure_rate": 0.0}
    metrics["skipped"] = counts["total"] - counts["old"]
    result = CycleResult(run_id, metrics)

    complete, proven = not enable_backup, None
    if enable_backup:
        if not destinations:
            raise ValueError("a backup destination is required when backup is on")
        if group_by is not None:
            result.copies = archive_table(
                old, ts, destinations, run_id, group_by, format, level, size
            )
        else:
            result.copies = backup(old, destinations, run_id, algorithm, level, size)
        complete = any(c.ok and c.items == counts["old"] for c in result.copies)
        if complete:
            safe, safe_bytes = counts["old"], counts["bytes"]
        elif key is None:
            safe, safe_bytes = 0, 0
        else:
            backed_up = read_copies(spark, result.copies, df.schema, only_good=False)
            proven = scratch_dir(spark, "proven")
            safe, safe_bytes = write_proven(df, ts, hours, as_of, backed_up, proven, size)
        metrics["copies"] = sum(c.ok for c in result.copies)
        metrics["succeeded"] = metrics["backed_up"] = safe
        metrics["failed"] = counts["old"] - safe
        metrics["total_bytes"] = safe_bytes
        tried = metrics["succeeded"] + metrics["failed"]
        metrics["failure_rate"] = metrics["failed"] / tried * 100 if tried else 0.0
        if 0 < error_threshold_percent < metrics["failure_rate"]:
            raise ThresholdExceeded(result, error_threshold_percent)
        if counts["old"] > 0 and safe == 0 and not prune_unbacked:
            errors = "; ".join(f"{c.destination}: {c.err}" for c in result.copies)
            raise BackupFailed(f"all backups failed: {errors}")

    _stop_if_asked(should_stop, "the prune")
    if complete or prune_unbacked:
        kept = retained(df, ts, hours, as_of)
        expected = counts["total"] - counts["old"]
    else:
        kept = df if proven is None else keep_unproven(df, ts, hours, as_of, spark.read.parquet(proven))
        expected = counts["total"] - metrics["backed_up"]
    metrics["kept"] = prune_generation(kept, expected, kept_path)
    metrics["pruned"] = counts["total"] - metrics["kept"]
    result.kept_path = kept_path
    return result


def run_once(
    spark: SparkSession,
    source: str,
    kept_path: str,
    ts: str,
    hours: float,
    as_of: datetime,
    **options,
) -> CycleResult:
    """One run over a fresh read of ``source``."""
    refuse_overlap(source, [kept_path, *options.get("destinations", ())])
    return backup_then_prune(
        spark.read.parquet(source), ts, hours, as_of, kept_path, **options
    )


def record_run(spark: SparkSession, result: CycleResult, root: str) -> None:
    """Add a run to the history below ``root``: ``run_metrics`` and ``copies``.

    A repeated run replaces its own entry. ``merge_results`` adds runs up.
    """
    root = root.rstrip("/")
    history = {
        "run_metrics": result.to_df(spark),
        "copies": copy_outcomes(spark, result.run_id, result.copies),
    }
    for name, rows in history.items():
        rows.drop("run_id").coalesce(1).write.mode("overwrite").parquet(
            f"{root}/{name}/run_id={result.run_id}"
        )


def policy_options(policy: Row) -> dict:
    """What a linted policy row says about a run, as arguments of ``run_once``."""
    archive, compression = policy.archive, policy.compression
    return {
        "source": policy.target_folder,
        "hours": policy.prune_after_hours,
        "destinations": list(policy.destinations),
        "enable_backup": policy.enable_backup,
        "error_threshold_percent": policy.error_threshold_percent,
        "group_by": archive.group_by if archive.enabled else None,
        "format": archive.format,
        "algorithm": compression.algorithm if compression.enabled else "none",
        "level": compression.level,
    }


def run_policies(
    policies: DataFrame,
    ts: str,
    as_of: datetime,
    kept_root: str,
    remotes: Mapping[str, str] | None = None,
    **options,
) -> list[CycleResult]:
    """One run per policy, after all of them have passed the rules.

    Policies are a handful of settings rows; each run is a set of Spark jobs. Policies
    run in the order of their folders, and the kept rows of the n-th go to
    ``kept_root/policy-n``. A remote copy is one more destination: ``remotes`` says which,
    and a policy with a remote that it does not name is refused.
    """
    spark = policies.sparkSession
    rows = policy_lint(policies).collect()
    rows.sort(key=lambda row: (row.target_folder or "", row.prune_after_hours or 0.0))
    broken = [f"{row.target_folder}: {row.violations[0]}" for row in rows if row.violations]
    known = remotes or {}
    broken += [f"{row.target_folder}: no destination is given for the remote {r}" for row in rows for r in row.remotes or () if r not in known]
    if broken:
        raise PolicyError("; ".join(broken))
    results = []
    for n, row in enumerate(rows):
        chosen = {**policy_options(row), **options}
        chosen["destinations"] = [*chosen["destinations"], *(known[r] for r in row.remotes or ())]
        kept = f"{kept_root.rstrip('/')}/policy-{n}"
        results.append(run_once(spark, kept_path=kept, ts=ts, as_of=as_of, **chosen))
    return results
