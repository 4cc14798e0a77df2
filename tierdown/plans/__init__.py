"""Actions: everything that writes."""

from tierdown.plans.containers import (
    archive_objects,
    archive_sizes,
    archive_table,
    open_archive,
    restore,
    restore_objects,
)
from tierdown.plans.copying import (
    BackupFailed,
    CopyOutcome,
    backup,
    copy_outcomes,
    fingerprint,
    read_copies,
    refuse_overlap,
    stored_sizes,
    write_compressed,
)
from tierdown.plans.cycle import (
    CycleResult,
    PolicyError,
    RunCancelled,
    ThresholdExceeded,
    backup_then_prune,
    plan_cycle,
    policy_options,
    record_run,
    run_once,
    run_policies,
)
from tierdown.plans.keyindex import files_for_keys, index_keys, restore_keys
from tierdown.plans.objects import archive_chunks, composed_digest, open_manifest, prune_objects, restore_chunks
from tierdown.plans.pruning import (
    PruneMismatch,
    keep_unproven,
    point_view,
    prune_generation,
    prune_partitions,
    split_for_prune,
    split_proven,
    write_proven,
)
from tierdown.plans.repair import Repair, RepairFailed, record_tree, repair_copy

from tierdown.plans.journal import Journal
from tierdown.plans.snapshots import FileTable, backup_then_prune_files, prune_files, read_snapshot

__all__ = [
    "BackupFailed",
    "CopyOutcome",
    "CycleResult",
    "FileTable",
    "Journal",
    "PolicyError",
    "PruneMismatch",
    "Repair",
    "RepairFailed",
    "RunCancelled",
    "ThresholdExceeded",
    "archive_chunks",
    "archive_objects",
    "archive_sizes",
    "archive_table",
    "backup",
    "backup_then_prune",
    "backup_then_prune_files",
    "composed_digest",
    "copy_outcomes",
    "files_for_keys",
    "fingerprint",
    "index_keys",
    "keep_unproven",
    "open_archive",
    "open_manifest",
    "plan_cycle",
    "point_view",
    "policy_options",
    "prune_files",
    "prune_generation",
    "prune_objects",
    "prune_partitions",
    "read_copies",
    "read_snapshot",
    "record_run",
    "record_tree",
    "refuse_overlap",
    "repair_copy",
    "restore",
    "restore_chunks",
    "restore_keys",
    "restore_objects",
    "run_once",
    "run_policies",
    "split_for_prune",
    "split_proven",
    "stored_sizes",
    "write_compressed",
    "write_proven",
]
