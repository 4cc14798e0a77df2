"""Streaming forms, run to the end of the given tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierdown.catalog.registry import EVENTS_AS_OF, EVENTS_CUTOFF, HOURS, query, table
from tierdown.plans import backup_then_prune
from tierdown.scratch import scratch_dir
from tierdown.sources import event_stream
from tierdown.streaming import (
    buckets_from_days,
    buckets_with_late,
    finished_buckets,
    late_rows,
    run_every,
    stream_backup,
    stream_expire_buckets,
    stream_expire_with_late,
    write_buckets,
)


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    stream = event_stream(spark, f"{sf_dir.rstrip('/')}/events.parquet", schema, "ts")
    return stream.withColumn("bytes", F.octet_length("props").cast("bigint"))


def _finished(spark: SparkSession, sf_dir: str, group_by: str) -> DataFrame:
    base = scratch_dir(spark, "expiry")
    buckets = stream_expire_buckets(_stream(spark, sf_dir), "ts", HOURS, group_by, "bytes")
    write_buckets(buckets, f"{base}/buckets", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(buckets.schema).parquet(f"{base}/buckets")


_EXPIRED_BUCKETS_SQL = """
    SELECT strftime({start}, '{shape}') AS bucket, count(*) AS items,
           CAST(sum(strlen(props)) AS BIGINT) AS bytes
    FROM events
    WHERE date_trunc('{unit}', ts) + {length} <= (SELECT max(ts) - INTERVAL 240 HOUR FROM events)
    GROUP BY 1
"""


@query(
    "stream_expire_daily",
    _EXPIRED_BUCKETS_SQL.format(start="ts", shape="%Y-%m-%d", unit="day", length="INTERVAL 1 DAY"),
)
def expire_daily(spark, sf_dir):
    return _finished(spark, sf_dir, "daily")


@query(
    "stream_expire_weekly",
    _EXPIRED_BUCKETS_SQL.format(start="ts", shape="%G-W%V", unit="week", length="INTERVAL 7 DAY"),
)
def expire_weekly(spark, sf_dir):
    return _finished(spark, sf_dir, "weekly")


@query(
    "stream_expire_monthly",
    """
    WITH days AS (
      SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS items, CAST(sum(o_orderkey) AS BIGINT) AS bytes
      FROM orders
      WHERE date_trunc('day', o_orderdate) + INTERVAL 1 DAY <= (SELECT max(o_orderdate) - INTERVAL 240 HOUR FROM orders)
      GROUP BY 1
    )
    SELECT strftime(day, '%Y-%m') AS bucket, CAST(sum(items) AS BIGINT) AS items, CAST(sum(bytes) AS BIGINT) AS bytes
    FROM days WHERE last_day(day) <= (SELECT max(day) FROM days) GROUP BY 1
    """,
)
def expire_monthly(spark, sf_dir):
    base = scratch_dir(spark, "expiry")
    schema = table(spark, sf_dir, "orders").schema
    stream = event_stream(spark, f"{sf_dir.rstrip('/')}/orders.parquet", schema, "o_orderdate")
    days = stream_expire_buckets(stream, "o_orderdate", HOURS, "daily", "o_orderkey")
    write_buckets(days, f"{base}/days", f"{base}/checkpoint").awaitTermination()
    return buckets_from_days(spark.read.schema(days.schema).parquet(f"{base}/days"), "monthly")


@query(
    "stream_expire_late",
    _EXPIRED_BUCKETS_SQL.format(start="ts", shape="%Y-%m-%d", unit="day", length="INTERVAL 1 DAY"),
)
def expire_late(spark, sf_dir):
    """A fifth of the rows comes after all others; finished buckets and late rows together
    are what a batch over everything gives."""
    base = scratch_dir(spark, "late")
    rows = table(spark, sf_dir, "events")
    last = F.col("event_id") % 5 == 0
    for n, part in enumerate((~last, last)):
        part = rows.where(part).repartitionByRange(2 - n, "ts")
        part.write.mode("append").parquet(f"{base}/source")
    schema = rows.schema
    stream = event_stream(spark, f"{base}/source", schema, "ts", files_per_batch=1).withColumn("bytes", F.octet_length("props").cast("bigint"))
    stream_expire_with_late(stream, "ts", HOURS, f"{base}/buckets", f"{base}/checkpoint", "daily", "bytes").awaitTermination()
    late = late_rows(spark, f"{base}/buckets", stream.schema)
    return buckets_with_late(finished_buckets(spark, f"{base}/buckets"), late, "ts", "daily", "bytes")


@query(
    "stream_backup",
    f"""
    SELECT destination, event_type, count(*) AS items, CAST(sum(event_id) AS BIGINT) AS id_sum
    FROM events, (VALUES ('a'), ('b')) AS d(destination)
    WHERE ts < {EVENTS_CUTOFF} GROUP BY ALL
    """,
)
def backup_stream(spark, sf_dir):
    base = scratch_dir(spark, "stream-copies")
    copies = [f"{base}/a", f"{base}/b"]
    stream_backup(
        _stream(spark, sf_dir), "ts", HOURS, EVENTS_AS_OF, copies, f"{base}/checkpoint"
    ).awaitTermination()
    held = None
    for path in copies:
        rows = spark.read.parquet(path).select(
            F.lit(path[-1]).alias("destination"), "event_type", "event_id"
        )
        held = rows if held is None else held.unionByName(rows)
    return held.groupBy("destination", "event_type").agg(
        F.count(F.lit(1)).alias("items"), F.sum("event_id").alias("id_sum")
    )


FIRST_AS_OF = datetime(2024, 1, 25)


@query(
    "stream_backup_two_runs",
    f"""
    SELECT run, event_type, count(*) AS items, CAST(sum(event_id) AS BIGINT) AS id_sum FROM (
      SELECT 'one' AS run, * FROM events WHERE ts < {EVENTS_CUTOFF}
      UNION ALL SELECT 'two', * FROM events WHERE ts < {EVENTS_CUTOFF}
    ) GROUP BY ALL
    """,
)
def backup_streams_twice(spark, sf_dir):
    """Two streams into one destination, the second in two runs with a later cutoff."""
    base = scratch_dir(spark, "stream-twice")
    runs = (("one", EVENTS_AS_OF), ("two", FIRST_AS_OF), ("two", EVENTS_AS_OF))
    for name, as_of in runs:
        stream = _stream(spark, sf_dir).withColumn("run", F.lit(name))
        stream_backup(stream, "ts", HOURS, as_of, [f"{base}/vault"], f"{base}/checkpoint-{name}").awaitTermination()
    held = spark.read.parquet(f"{base}/vault")
    return held.groupBy("run", "event_type").agg(F.count(F.lit(1)).alias("items"), F.sum("event_id").alias("id_sum"))


MANY = 6


@query(
    "stream_backup_many_batches",
    f"""
    SELECT event_type, count(*) AS items, CAST(sum(event_id) AS BIGINT) AS id_sum, count(DISTINCT event_id) AS ids
    FROM events WHERE ts < {EVENTS_CUTOFF} GROUP BY ALL
    """,
)
def backup_in_many_batches(spark, sf_dir):
    """Files that arrive one after the other, each a batch; the cutoff moves twice."""
    base = scratch_dir(spark, "stream-many")
    rows = table(spark, sf_dir, "events")
    rows.repartitionByRange(MANY, "event_id").write.parquet(f"{base}/source")
    for as_of in (FIRST_AS_OF, EVENTS_AS_OF):
        stream = event_stream(spark, f"{base}/source", rows.schema, "ts", files_per_batch=1)
        stream_backup(stream, "ts", HOURS, as_of, [f"{base}/vault"], f"{base}/checkpoint").awaitTermination()
    held = spark.read.parquet(f"{base}/vault")
    return held.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("items"), F.sum("event_id").alias("id_sum"), F.countDistinct("event_id").alias("ids")
    )


TICKS = (datetime(2024, 1, 25), EVENTS_AS_OF)


@query(
    "run_every",
    f"""
    SELECT CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 'tick-0' WHEN ts < {EVENTS_CUTOFF} THEN 'tick-1'
           ELSE 'kept' END AS place, count(*) AS items, CAST(sum(event_id) AS BIGINT) AS id_sum
    FROM events GROUP BY 1
    """,
)
def two_ticks(spark, sf_dir):
    base = scratch_dir(spark, "every")
    sources = [f"{sf_dir.rstrip('/')}/events.parquet", f"{base}/kept-0", f"{base}/kept-1"]

    def cycle(tick: int) -> None:
        backup_then_prune(
            spark.read.parquet(sources[tick]),
            "ts",
            HOURS,
            TICKS[tick],
            sources[tick + 1],
            [f"{base}/vault"],
            key="event_id",
            run_id=f"tick-{tick}",
        )

    run_every(spark, cycle, 1, max_cycles=len(TICKS), checkpoint=f"{base}/checkpoint")
    copied = spark.read.parquet(f"{base}/vault").select(
        F.col("run_id").alias("place"), "event_id"
    )
    kept = spark.read.parquet(sources[-1]).select(F.lit("kept").alias("place"), "event_id")
    return copied.unionByName(kept).groupBy("place").agg(
        F.count(F.lit(1)).alias("items"), F.sum("event_id").alias("id_sum")
    )
