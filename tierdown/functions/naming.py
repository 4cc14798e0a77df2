"""Where an item goes: keys, buckets, container names and destination paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and extensions as users of the file format expect them.
GZIP = "gzip"
ALGORITHM_EXTENSIONS = {"none": "", "gzip": ".gz"}
FORMAT_EXTENSIONS = {"tar": ".tar", "tar.gz": ".tar.gz", "zip": ".zip"}
DEFAULT_FORMAT = "tar.gz"
GROUPINGS = ("daily", "weekly", "monthly")
ARCHIVE_PREFIX = "backup-"


def _column(value: str | Column) -> Column:
    return F.lit(value) if isinstance(value, str) else value


def _lookup(value: str | Column, table: dict[str, str], default: str) -> Column:
    result = F.lit(default)
    for name, text in table.items():
        result = F.when(_column(value) == name, F.lit(text)).otherwise(result)
    return result


def extension_for(algorithm: str | Column) -> Column:
    return _lookup(algorithm, ALGORITHM_EXTENSIONS, "")


def archive_extension(format: str | Column) -> Column:
    return _lookup(format, FORMAT_EXTENSIONS, FORMAT_EXTENSIONS[DEFAULT_FORMAT])


def relative_key(path: str | Column, root: str | Column) -> Column:
    """``path`` below ``root``; NULL when it lies elsewhere.

    A plain string names the path column, or is the root itself.
    """
    path = F.col(path) if isinstance(path, str) else path
    folder = F.concat(F.rtrim(_column(root), F.lit("/")), F.lit("/"))
    inside = F.startswith(path, folder)
    return F.when(inside, F.substring(path, F.length(folder) + 1, F.length(path)))


def archive_bucket(ts: str | Column, group_by: str | Column = "daily") -> Column:
    """Calendar bucket of an instant: ``2024-01-21``, ISO ``2024-W03`` or ``2024-01``.

    ``group_by`` may be a column, so that each policy groups in its own way; an
    unknown grouping means daily.
    """
    day = F.to_date(ts)
    daily = day.cast("string")
    weekly = F.concat(
        F.date_part(F.lit("YEAROFWEEK"), day).cast("string"),
        F.lit("-W"),
        F.lpad(F.weekofyear(day).cast("string"), 2, "0"),
    )
    monthly = F.substring(daily, 1, 7)
    if isinstance(group_by, str):
        return {"weekly": weekly, "monthly": monthly}.get(group_by, daily)
    return F.when(group_by == "weekly", weekly).when(group_by == "monthly", monthly).otherwise(daily)


def archive_name(bucket: str | Column, format: str | Column = DEFAULT_FORMAT) -> Column:
    bucket = F.col(bucket) if isinstance(bucket, str) else bucket
    return F.concat(F.lit(ARCHIVE_PREFIX), bucket, archive_extension(format))


def destination_path(
    destination: str | Column, key: str | Column, algorithm: str | Column | None = None
) -> Column:
    """Path of one copy; the codec's extension is added when there is a codec."""
    destination = F.col(destination) if isinstance(destination, str) else destination
    key = F.col(key) if isinstance(key, str) else key
    path = F.concat(F.rtrim(destination, F.lit("/")), F.lit("/"), key)
    return path if algorithm is None else F.concat(path, extension_for(algorithm))


def merge_destinations(single: str | Column, many: str | Column) -> Column:
    """The single destination first, then the list: no blanks, no repeats, same order."""
    single = F.col(single) if isinstance(single, str) else single
    many = F.col(many) if isinstance(many, str) else many
    listed = F.coalesce(many, F.array().cast("array<string>"))
    both = F.concat(F.array(single), listed)
    return F.array_distinct(F.filter(both, lambda d: d.isNotNull() & (d != "")))
