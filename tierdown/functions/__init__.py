"""Column expressions: ages, names, rates and destination lists."""

from tierdown.functions.age import cutoff, is_expired, is_retained
from tierdown.functions.naming import (
    archive_bucket,
    archive_extension,
    archive_name,
    destination_path,
    extension_for,
    merge_destinations,
    relative_key,
)
from tierdown.functions.rates import (
    breaches,
    compression_ratio,
    failure_rate,
    prune_summary_line,
    space_saved,
    summary_line,
)

__all__ = [
    "archive_bucket",
    "archive_extension",
    "archive_name",
    "breaches",
    "compression_ratio",
    "cutoff",
    "destination_path",
    "extension_for",
    "failure_rate",
    "is_expired",
    "is_retained",
    "merge_destinations",
    "prune_summary_line",
    "relative_key",
    "space_saved",
    "summary_line",
]
