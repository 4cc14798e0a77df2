"""Runs on a clock, and incremental forms on streams."""

from tierdown.streaming.expiry import buckets_from_days, buckets_with_late, finished_buckets, late_rows, stream_expire_buckets, stream_expire_with_late, write_buckets
from tierdown.streaming.fanout import stream_backup
from tierdown.streaming.loop import run_every

__all__ = [
    "buckets_from_days",
    "buckets_with_late",
    "finished_buckets",
    "late_rows",
    "stream_expire_with_late",
    "run_every",
    "stream_backup",
    "stream_expire_buckets",
    "write_buckets",
]
