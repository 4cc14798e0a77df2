"""Age tests written so that the comparison reaches the file scan.

All arithmetic happens on the literal side: ``ts < literal`` is pushed down to
Parquet and prunes partitions, ``ts + interval < literal`` is not.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cutoff(as_of: datetime, hours: float) -> datetime:
    """The instant before which an item is expired. Fractions of an hour count."""
    if hours <= 0:
        raise ValueError(f"retention hours must be positive, got {hours}")
    if as_of.tzinfo is not None:
        as_of = as_of.astimezone(timezone.utc).replace(tzinfo=None)
    return as_of - timedelta(hours=hours)


def instant_literal(limit: datetime, dtype: T.DataType) -> Column:
    """``limit`` (UTC wall clock) in the type of the column it is compared with."""
    text = limit.isoformat(sep=" ")
    if isinstance(dtype, T.TimestampNTZType):
        return F.lit(text).cast("timestamp_ntz")
    if isinstance(dtype, T.TimestampType):
        return F.lit(f"{text}+00:00").cast("timestamp")
    if isinstance(dtype, T.DateType):
        # a date stands for its midnight, so it is older than every later instant
        day = limit.date()
        if limit > datetime(day.year, day.month, day.day):
            day += timedelta(days=1)
        return F.lit(day.isoformat()).cast("date")
    raise TypeError(f"age column must be a date or timestamp, got {dtype.simpleString()}")


def _limit_for(df: DataFrame, ts: str, hours: float, as_of: datetime) -> Column:
    return instant_literal(cutoff(as_of, hours), df.schema[ts].dataType)


def is_expired(df: DataFrame, ts: str, hours: float, as_of: datetime) -> Column:
    """Strictly older than the cutoff; NULL for a row without an age."""
    return F.col(ts) < _limit_for(df, ts, hours, as_of)


def is_retained(df: DataFrame, ts: str, hours: float, as_of: datetime) -> Column:
    """The complement, with rows of unknown age kept. Both halves are pushed down."""
    return F.col(ts).isNull() | (F.col(ts) >= _limit_for(df, ts, hours, as_of))
