"""A record of the steps of a run, from which an interrupted run goes on."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import SparkSession

from tierdown.plans import folders


class Journal:
    """Steps of one run, each a small committed folder below ``root``.

    A step is recorded after its work is done, with what the later steps have to know. A
    run that starts again with the same id takes recorded steps as done; so the work of a
    step must be such that doing it a second time, after a failure before the record, ends
    in the same state.
    """

    def __init__(self, spark: SparkSession, root: str, run_id: str):
        self.spark, self.root = spark, f"{root.rstrip('/')}/{run_id}"

    def recorded(self, step: str) -> dict | None:
        path = f"{self.root}/{step}"
        if not folders.committed(self.spark, path):
            return None
        return json.loads(self.spark.read.schema("record string").parquet(path).first().record)

    def once(self, step: str, work: Callable[[], dict]) -> dict:
        found = self.recorded(step)
        if found is None:
            found = work()
            row = self.spark.createDataFrame([(json.dumps(found),)], "record string")
            row.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/{step}")
        return found
