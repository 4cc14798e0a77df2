"""Calendar buckets that come out of a stream once all of them is old."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tierdown.functions.naming import archive_bucket
from tierdown.plans import folders

# weeks are counted from 1970-01-01, a Thursday; four days later is a Monday
_WINDOWS = {"daily": ("1 day", "0 days"), "weekly": ("1 week", "4 days")}


def _wall(instant):
    """UTC wall clock of an instant, whatever the session's zone."""
    return F.to_utc_timestamp(instant, F.current_timezone()).cast("timestamp_ntz")


def stream_expire_buckets(
    stream: DataFrame, ts: str, hours: float, group_by: str = "daily", size: str | None = None
) -> DataFrame:
    """Items and bytes per bucket, in append mode.

    The watermark trails the newest item by ``hours``, so a bucket is emitted when
    its end is that old, and state never holds more than the open buckets. Rows of
    one bucket combine before the shuffle. Rows that arrive behind the watermark are
    dropped by Spark; ``stream_expire_with_late`` keeps them.
    """
    if group_by not in _WINDOWS:
        raise ValueError(f"group_by must be one of {tuple(_WINDOWS)}; months are made from days")
    length, start = _WINDOWS[group_by]
    amount = F.lit(0) if size is None else F.col(size)
    counted = (
        stream.withWatermark(ts, f"{int(hours * 3600)} seconds")
        .groupBy(F.window(ts, length, length, start))
        .agg(
            F.count(F.lit(1)).alias("items"),
            F.coalesce(F.sum(amount), F.lit(0)).cast("bigint").alias("bytes"),
        )
    )
    begin = _wall(F.col("window.start"))
    return counted.select(archive_bucket(begin, group_by).alias("bucket"), "items", "bytes")


def write_buckets(
    buckets: DataFrame, path: str, checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Append finished buckets to ``path``, each exactly once."""
    writer = (
        buckets.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def buckets_from_days(days: DataFrame, group_by: str = "monthly") -> DataFrame:
    """Longer buckets from finished daily ones, each only once it is over: its last day
    must not lie behind the newest finished day."""
    day = F.to_date("bucket")
    last_day = F.last_day(day) if group_by == "monthly" else F.date_add(F.date_trunc("week", day).cast("date"), 6)
    if group_by != "daily":
        newest = days.agg(F.max(day)).first()[0]
        days = days.where(last_day <= F.lit(newest))
    return days.groupBy(archive_bucket(day, group_by).alias("bucket")).agg(
        F.sum("items").cast("bigint").alias("items"), F.sum("bytes").cast("bigint").alias("bytes")
    )


# ---- buckets with their late rows ----------------------------------------------------


def bucket_end(instant: Column, group_by: str) -> Column:
    """The first instant after the calendar bucket of a wall clock."""
    day = F.to_date(instant)
    if group_by == "daily":
        after = F.date_add(day, 1)
    elif group_by == "weekly":
        after = F.date_add(F.date_trunc("week", day).cast("date"), 7)
    elif group_by == "monthly":
        after = F.date_add(F.last_day(day), 1)
    else:
        raise ValueError(f"group_by must be daily, weekly or monthly, got {group_by}")
    return after


class _Buckets:
    """Open buckets of a stream, in folders named by the day they end.

    ``open/ends=<day>/step=<name>`` holds what a step counted for buckets that end then,
    ``finished/step=<name>`` the buckets that were over after it, ``late/step=<name>`` the
    rows that came for buckets that were over before it, ``done/<name>`` its record: the
    newest age seen and the ends it used up. A step that is repeated replaces its folders.
    """

    def __init__(self, spark: SparkSession, path: str, group_by: str):
        self.spark, self.root, self.group_by = spark, path.rstrip("/"), group_by

    def last(self) -> tuple[str | None, dict]:
        done = [n for n in folders.names(self.spark, f"{self.root}/done") if folders.committed(self.spark, f"{self.root}/done/{n}")]
        if not done:
            return None, {"newest": None, "used": []}
        row = self.spark.read.schema("record string").parquet(f"{self.root}/done/{done[-1]}").first()
        return done[-1], json.loads(row.record)

    def clear(self) -> None:
        folders.remove(self.spark, [f"{self.root}/open/ends={day}" for day in self.last()[1]["used"]])

    def step(self, batch: DataFrame, name: str, ts: str, hours: float, size: Column) -> None:
        self.clear()
        last, record = self.last()
        if last == name:
            return
        schema = batch.schema
        wall = _wall(F.col(ts))
        rows = batch.where(F.col(ts).isNotNull()).withColumns(
            {"_ends": bucket_end(wall, self.group_by), "_bucket": archive_bucket(wall, self.group_by)}
        )
        over = self._over(record["newest"], hours)
        late = rows.where(F.col("_ends") <= over).select(*[f.name for f in schema.fields]) if over is not None else rows.limit(0).select(*[f.name for f in schema.fields])
        late.write.mode("overwrite").parquet(f"{self.root}/late/step={name}")
        fresh = rows if over is None else rows.where(F.col("_ends") > over)
        amount = F.coalesce(F.sum(size), F.lit(0)).cast("bigint")
        counted = fresh.groupBy(F.col("_ends").alias("ends"), F.col("_bucket").alias("bucket")).agg(
            F.count(F.lit(1)).alias("items"), amount.alias("bytes"), F.max(wall).cast("timestamp_ntz").alias("newest")
        )
        for day in self._ends():  # what an earlier attempt of this step left
            folders.remove(self.spark, [f"{self.root}/open/ends={day}/step={name}"])
        seen = Observation()
        placed = counted.observe(seen, F.max("newest").cast("string").alias("newest")).drop("newest").withColumn("step", F.lit(name))
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ends", "step").parquet(f"{self.root}/open")
        newest = max(filter(None, (record["newest"], seen.get["newest"])), default=None)
        limit = self._limit(newest, hours)
        used = [day for day in self._ends() if limit is not None and datetime.fromisoformat(day) <= limit]
        paths = [f"{self.root}/open/ends={day}" for day in used]
        reader = self.spark.read.schema("bucket string, items long, bytes long").option("recursiveFileLookup", "true")
        opened = reader.parquet(*paths) if paths else self.spark.createDataFrame([], "bucket string, items long, bytes long")
        finished = opened.groupBy("bucket").agg(F.sum("items").alias("items"), F.sum("bytes").alias("bytes"))
        finished.write.mode("overwrite").parquet(f"{self.root}/finished/step={name}")
        row = self.spark.createDataFrame([(json.dumps({"newest": newest, "used": used}),)], "record string")
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/done/{name}")
        self.clear()
        folders.remove(self.spark, [f"{self.root}/done/{n}" for n in folders.names(self.spark, f"{self.root}/done")[:-2]])

    def _ends(self) -> list[str]:
        return [n.removeprefix("ends=") for n in folders.names(self.spark, f"{self.root}/open") if n.startswith("ends=")]

    @staticmethod
    def _limit(newest: str | None, hours: float) -> datetime | None:
        return None if newest is None else datetime.fromisoformat(newest) - timedelta(hours=hours)

    def _over(self, newest: str | None, hours: float) -> Column | None:
        """Buckets that end by then are over; an end is a midnight."""
        limit = self._limit(newest, hours)
        return None if limit is None else F.lit(limit.date().isoformat()).cast("date")


def stream_expire_with_late(
    stream: DataFrame, ts: str, hours: float, path: str, checkpoint: str, group_by: str = "daily", size: str | None = None, once: bool = True
) -> StreamingQuery:
    """Buckets that are over, each once, and the rows that came too late for theirs.

    A bucket is over when its end is ``hours`` behind the newest age of all earlier batches
    and its own. Rows for buckets that were over before their batch are kept whole below
    ``path/late``; ``buckets_with_late`` adds them up. Calendar months are buckets like any
    other here. What a batch writes is its own counts, the buckets it finishes and its late
    rows. Rows without an age are in no bucket.
    """
    bucket_end(F.lit(None).cast("timestamp_ntz"), group_by)  # refuses other groupings now
    buckets = _Buckets(stream.sparkSession, path, group_by)
    amount = F.lit(0) if size is None else F.col(size)

    def step(batch: DataFrame, number: int) -> None:
        buckets.step(batch, f"b{number:012d}", ts, hours, amount)

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def finished_buckets(spark: SparkSession, path: str) -> DataFrame:
    schema = "bucket string, items long, bytes long"
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path.rstrip('/')}/finished")


def late_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path.rstrip('/')}/late")


def buckets_with_late(finished: DataFrame, late: DataFrame, ts: str, group_by: str = "daily", size: str | None = None) -> DataFrame:
    """What a batch over all rows would say of the buckets that are over. ``late`` is summed
    up before it meets the finished buckets."""
    amount = F.lit(0) if size is None else F.col(size)
    added = late.groupBy(archive_bucket(_wall(F.col(ts)), group_by).alias("bucket")).agg(
        F.count(F.lit(1)).alias("items"), F.coalesce(F.sum(amount), F.lit(0)).cast("bigint").alias("bytes")
    )
    return finished.unionByName(added).groupBy("bucket").agg(F.sum("items").alias("items"), F.sum("bytes").alias("bytes"))
