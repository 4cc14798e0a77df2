"""Expired rows of a stream, to every destination."""

from __future__ import annotations

import calendar
import json
import uuid
from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tierdown.functions.age import cutoff, instant_literal
from tierdown.plans import folders
from tierdown.plans.copying import BackupFailed, CopyOutcome, backup, copy_outcomes

_STATE = "tierdown-backup"
_HOUR = 3600


def _slot_of(ts: str) -> Column:
    """The hour a row's age falls in, counted from 1970; rows of one hour wait together."""
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(_HOUR * 1_000_000)).cast("long")


class _Ledger:
    """What a stream has to remember from step to step, beside its checkpoint.

    ``owner`` names the folders of this stream. ``young/slot=<hour>/step=<name>`` holds the
    rows of one hour that came in one step and wait to get old: a step opens the hours that
    are due and no others, so it reads and writes what came with it and what expires, however
    long the stream has run. ``done/<name>`` ends a step: the copies that are still missing,
    and the hours it used up, which are removed after it (by the next step, if this one is
    cut off there). Only the last two are kept. ``outcomes/step=<name>`` is a history for
    people, never read here.
    """

    def __init__(self, spark: SparkSession, checkpoint: str):
        self.spark, self.root = spark, f"{checkpoint.rstrip('/')}-{_STATE}"
        if not folders.committed(spark, f"{self.root}/owner"):
            row = spark.createDataFrame([(uuid.uuid4().hex[:12],)], "owner string")
            row.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/owner")
        self.owner = spark.read.parquet(f"{self.root}/owner").first()[0]

    # ---- steps ----

    def last(self) -> str | None:
        done = [n for n in folders.names(self.spark, f"{self.root}/done") if folders.committed(self.spark, f"{self.root}/done/{n}")]
        return done[-1] if done else None

    def missing(self) -> list[tuple[str, str, str]]:
        """``(run, destination, path of a good copy)`` of copies that are still missing."""
        last = self.last()
        return [] if last is None else [tuple(m) for m in self._record(last)["missing"]]

    def _record(self, step: str) -> dict:
        return json.loads(self.spark.read.schema("record string").parquet(f"{self.root}/done/{step}").first().record)

    def finish(self, step: str, missing: list[tuple[str, str, str]], used: list[int]) -> None:
        row = self.spark.createDataFrame([(json.dumps({"missing": missing, "used": used}),)], "record string")
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/done/{step}")
        self.clear()
        older = folders.names(self.spark, f"{self.root}/done")[:-2]
        folders.remove(self.spark, [f"{self.root}/done/{n}" for n in older])

    def clear(self) -> None:
        """Remove what the last step used up; doing it again changes nothing."""
        last = self.last()
        if last is not None:
            for slot in self._record(last)["used"]:
                self._remove_steps(slot, lambda name: name != last)

    # ---- young rows ----

    def _slots(self) -> list[int]:
        return [int(n.removeprefix("slot=")) for n in folders.names(self.spark, f"{self.root}/young") if n.startswith("slot=")]

    def _remove_steps(self, slot: int, which: Callable[[str], bool]) -> None:
        at = f"{self.root}/young/slot={slot}"
        steps = [n for n in folders.names(self.spark, at) if n.startswith("step=")]
        gone = [n for n in steps if which(n.removeprefix("step="))]
        folders.remove(self.spark, [at] if len(gone) == len(steps) else [f"{at}/{n}" for n in gone])

    def due(self, limit: datetime) -> list[int]:
        """Hours that began before the limit."""
        seconds = calendar.timegm(limit.timetuple()) + limit.microsecond / 1e6
        return [slot for slot in self._slots() if slot * _HOUR < seconds]

    def held(self, slots: list[int], step: str, schema: T.StructType) -> DataFrame | None:
        """The rows of some hours, without what an earlier attempt of this step left."""
        for slot in self._slots():
            self._remove_steps(slot, lambda name: name == step)
        paths = [f"{self.root}/young/slot={s}" for s in slots]
        paths = [p for p in paths if folders.exists(self.spark, p)]
        if not paths:
            return None
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*paths)

    def hold(self, rows: DataFrame, step: str, ts: str) -> None:
        placed = rows.withColumns({"slot": _slot_of(ts), "step": F.lit(step)})
        writer = placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("slot", "step").parquet(f"{self.root}/young")

    def tell(self, step: str, outcomes: dict[str, list[CopyOutcome]]) -> None:
        rows = None
        for run, found in outcomes.items():
            one = copy_outcomes(self.spark, run, found)
            rows = one if rows is None else rows.unionByName(one)
        if rows is not None:
            rows.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/outcomes/step={step}")


def stream_backup(
    stream: DataFrame,
    ts: str,
    hours: float,
    as_of: datetime,
    destinations: Sequence[str],
    checkpoint: str,
    algorithm: str = "none",
    once: bool = True,
    report: Callable[[int, list[CopyOutcome]], None] | None = None,
) -> StreamingQuery:
    """Copy what is older than the cutoff, batch by batch.

    Each batch writes below a folder named after this stream and the batch, so a replayed
    batch replaces its first attempt, and other streams, or one that lost its checkpoint,
    write beside it. Rows that are too young wait beside the checkpoint, hour by hour, and an
    hour is opened when it is due: by a batch, or at a start, when ``as_of`` may be later.
    Rows without an age never expire and are not held. A destination that missed a batch gets it from a
    good copy in the next batch or start. A batch that no destination could take fails the
    query instead of being skipped; ``report`` gets the outcomes of every batch.
    """
    spark = stream.sparkSession
    ended = cutoff(as_of, hours)
    limit = instant_literal(ended, T.TimestampType())
    ledger = _Ledger(spark, checkpoint)

    def step(rows: DataFrame, name: str, number: int) -> None:
        ledger.clear()
        if ledger.last() == name:
            return  # all of it was done; only the stream's own record of it was lost
        used = ledger.due(ended)
        held = ledger.held(used, name, rows.schema)
        rows = rows if held is None else rows.unionByName(held)
        outcomes: dict[str, list[CopyOutcome]] = {}
        missing = []
        for run, where, good in ledger.missing():
            source = spark.read.schema(rows.schema).parquet(good)
            again = backup(source, [where], run, algorithm)
            outcomes.setdefault(run, []).extend(again)
            missing += [(run, where, good) for o in again if not o.ok]
        run = f"{ledger.owner}-{name}"
        outcomes[run] = backup(rows.where(F.col(ts) < limit), destinations, run, algorithm)
        if report is not None:
            report(number, outcomes[run])
        good = [o.path for o in outcomes[run] if o.ok]
        if not good:
            raise BackupFailed("; ".join(f"{o.destination}: {o.err}" for o in outcomes[run]))
        missing += [(run, o.destination, good[0]) for o in outcomes[run] if not o.ok]
        ledger.hold(rows.where(F.col(ts) >= limit), name, ts)
        ledger.tell(name, outcomes)
        ledger.finish(name, missing, used)

    # batches are b<number>; what waits at a start is step b<last>.s<count>, after that batch
    # and before the next
    last = ledger.last()
    if last is not None:
        batch, _, starts = last.partition(".s")
        step(spark.createDataFrame([], stream.schema), f"{batch}.s{int(starts or 0) + 1:06d}", -1)

    def copy(batch: DataFrame, batch_id: int) -> None:
        step(batch, f"b{batch_id:012d}", batch_id)

    writer = stream.writeStream.foreachBatch(copy).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
