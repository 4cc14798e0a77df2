"""A run every so many seconds."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tierdown.scratch import scratch_dir


def run_every(
    spark: SparkSession,
    cycle: Callable[[int], object],
    seconds: float,
    max_cycles: int | None = None,
    checkpoint: str | None = None,
) -> StreamingQuery:
    """Call ``cycle(tick)`` at once and then every ``seconds``; runs never overlap.

    The ticks come from a stream of one row per trigger, so that a restart with the
    same ``checkpoint`` repeats the interrupted tick and goes on from there. Each
    cycle should read its source afresh. After ``max_cycles`` the query stops
    between two ticks; without it, call ``stop()`` on the returned query.
    """
    done = threading.Event()

    def on_tick(_: DataFrame, tick: int) -> None:
        if done.is_set():
            return
        cycle(tick)
        if max_cycles is not None and tick + 1 >= max_cycles:
            done.set()

    query = (
        spark.readStream.format("rate-micro-batch")
        .option("rowsPerBatch", 1)
        .load()
        .writeStream.foreachBatch(on_tick)
        .option("checkpointLocation", checkpoint or scratch_dir(spark, "ticks"))
        .trigger(processingTime=f"{seconds} seconds")
        .start()
    )
    if max_cycles is not None:
        while not done.wait(0.2):
            if not query.isActive:
                query.awaitTermination()  # raises what went wrong
                break
        query.stop()
    return query
