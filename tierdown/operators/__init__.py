"""DataFrame-to-DataFrame operators; none of them writes anything."""

from tierdown.operators.accounting import (
    any_destination_ok,
    archive_stats,
    compression_stats,
    error_counts,
    error_report,
    merge_errors,
    merge_results,
    phase_rates,
    run_summary,
    threshold_gate,
    union_outcomes,
)
from tierdown.operators.breaker import running_failure_rate, stop_at_breach
from tierdown.operators.joins import skew_safe_join
from tierdown.operators.linking import overlap_guard, prune_safe, unbacked, unread_items
from tierdown.operators.linting import policy_lint, with_defaults
from tierdown.operators.planning import archive_plan, destination_plan, dry_run
from tierdown.operators.restoring import latest_copies, restore_over, split_unsafe_keys
from tierdown.operators.retention import (
    apply_policies,
    classify,
    expired,
    expired_by_policy,
    retained,
    retention_split,
)

__all__ = [
    "any_destination_ok",
    "apply_policies",
    "archive_plan",
    "archive_stats",
    "classify",
    "compression_stats",
    "destination_plan",
    "dry_run",
    "error_counts",
    "error_report",
    "expired",
    "expired_by_policy",
    "latest_copies",
    "merge_errors",
    "merge_results",
    "overlap_guard",
    "phase_rates",
    "policy_lint",
    "prune_safe",
    "restore_over",
    "retained",
    "retention_split",
    "run_summary",
    "running_failure_rate",
    "skew_safe_join",
    "split_unsafe_keys",
    "stop_at_breach",
    "threshold_gate",
    "unbacked",
    "union_outcomes",
    "unread_items",
    "with_defaults",
]
