"""The ordered failure breaker.

The rate is looked at after every item, in order, and the first breach ends the run.
An ordinary part is one window. A part that holds a large share of the rows, or a
single run over everything, goes through the slices of ``scans``: running counts come
out of levels of slice totals. To find the breach, each slice is summed up by what can
be joined in any grouping: its items, its failures, and the most that ``100 x failures -
percent x items`` reaches at one of its failures. Together with what came before, that
tells which slice trips; only that one is looked at row by row, and later ones never.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierdown.functions.rates import breaches, failure_rate
from tierdown.operators.joins import DEFAULT_SUPPORT, frequent_keys
from tierdown.operators.scans import FANOUT, PART, ROW, SLICE, local, running, sliced, totals_before, written

_RATES = ["running_succeeded", "running_failed", "running_rate"]
# rates are compared as doubles; slices this near to the threshold are looked at too
_MARGIN = 1e-9


def _hot_parts(df: DataFrame, part: Sequence[str]) -> list[int]:
    """Hash codes of parts larger than half of an even share of a task."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    support = max(DEFAULT_SUPPORT, 1 / (2 * partitions))
    return frequent_keys(df.select(F.xxhash64(*part).alias("code")), "code", support)


def _split(outcomes: DataFrame, part: Sequence[str]) -> tuple[DataFrame | None, DataFrame | None]:
    """(rows of ordinary parts, rows of hot parts); None where there is nothing to do."""
    if not part:
        return None, outcomes
    hot = _hot_parts(outcomes, part)
    if not hot:
        return outcomes, None
    # parts that share a hash code go the same way, which does no harm
    is_hot = F.xxhash64(*part).isin(hot)
    return outcomes.where(~is_hot), outcomes.where(is_hot)


def _rated(rows: DataFrame, n: Column, f: Column) -> DataFrame:
    return rows.withColumns(
        {
            "running_succeeded": n - f,
            "running_failed": f,
            "running_rate": failure_rate(n - f, f),
        }
    )


def _ordinary(rows: DataFrame, part: Sequence[str], order: Sequence[str], failed: str) -> DataFrame:
    window = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.select("*", F.count(F.lit(1)).over(window).alias("_n"), F.count_if(failed).over(window).alias("_f"))
    return _rated(counted, F.col("_n"), F.col("_f")).drop("_n", "_f")


def _counters(failed: str) -> dict[str, tuple[str, Column]]:
    return {"_n": ("sum", F.lit(1).cast("bigint")), "_f": ("sum", F.coalesce(F.col(failed).cast("bigint"), F.lit(0)))}


def _over_slices(rows: DataFrame, failed: str, fanout: int) -> DataFrame:
    counted = running(rows, _counters(failed), fanout)
    return _rated(counted, F.col("_n"), F.col("_f")).drop("_n", "_f")


def _union(pieces: list[DataFrame]) -> DataFrame:
    return pieces[0] if len(pieces) == 1 else pieces[0].unionByName(pieces[1])


def running_failure_rate(
    outcomes: DataFrame,
    part: Sequence[str],
    order: Sequence[str],
    failed: str,
    slices: int | None = None,
    fanout: int = FANOUT,
) -> DataFrame:
    """Adds ``running_succeeded``, ``running_failed`` and ``running_rate``.

    ``failed`` is a boolean column, ``order`` must identify a row within its part, and
    an empty ``part`` means one run over everything.
    """
    ordinary, hot = _split(outcomes, part)
    columns = [*outcomes.columns, *_RATES]
    pieces = []
    if ordinary is not None:
        pieces.append(_ordinary(ordinary, part, order, failed).select(*columns))
    if hot is not None:
        pieces.append(_over_slices(sliced(hot, part, order, slices), failed, fanout).select(*columns))
    return _union(pieces)


def _trips(failed: str, percent: float) -> Column:
    return F.coalesce(F.col(failed), F.lit(False)) & breaches("running_succeeded", "running_failed", percent)


def slice_breaches(rows: DataFrame, failed: str, percent: float, fanout: int = FANOUT) -> DataFrame:
    """``_part, _slice, _n, _f`` of the slices that may trip, with what came before them.

    A slice is ``(items, failures, peak)``, the peak being the highest excess at one of
    its failures. Two neighbours join to ``(n + n', f + f', max(peak, excess(n, f) +
    peak'))``, so it does not matter how slices are grouped.
    """
    share = float(percent) - _MARGIN
    excess = lambda n, f: F.lit(100.0) * f - F.lit(share) * n
    counted = local(rows, _counters(failed))
    at_failure = F.when(F.coalesce(F.col(failed), F.lit(False)), excess(F.col("_n"), F.col("_f")))
    summed = written(
        counted.groupBy(PART, SLICE).agg(F.max("_n").alias("_n"), F.max("_f").alias("_f"), F.max(at_failure).alias("_peak")), "sums"
    )
    before = totals_before(summed.drop("_peak"), {"_n": "sum", "_f": "sum"}, fanout)
    joined = before.join(summed.select(PART, SLICE, "_peak"), [PART, SLICE])
    return joined.where(excess(F.col("_n"), F.col("_f")) + F.col("_peak") > 0).select(PART, SLICE, "_n", "_f")


def _stops(rows: DataFrame, failed: str, percent: float, fanout: int) -> DataFrame:
    """``_part, _stop``: the row that trips, for parts that have one."""
    open_ = written(slice_breaches(rows, failed, percent, fanout), "breaches")
    found: DataFrame | None = None
    # the first slice decides, unless a rate within a rounding of the threshold misled
    while not open_.isEmpty():
        first = open_.groupBy(PART).agg(F.min_by(F.struct(SLICE, "_n", "_f"), SLICE).alias("s")).select(PART, "s.*")
        offsets = first.withColumnsRenamed({"_n": "_n0", "_f": "_f0"})
        counted = local(rows.join(offsets, [PART, SLICE]), _counters(failed))
        rated = _rated(counted, F.col("_n") + F.col("_n0"), F.col("_f") + F.col("_f0"))
        stops = written(rated.where(_trips(failed, percent)).groupBy(PART).agg(F.min(ROW).alias("_stop")), "stops")
        found = stops if found is None else found.unionByName(stops)
        rest = open_.join(stops, PART, "left_anti").join(first, [PART, SLICE], "left_anti")
        open_ = written(rest, "breaches")
    return found if found is not None else rows.select(PART, F.col(ROW).alias("_stop")).limit(0)


def stop_at_breach(
    outcomes: DataFrame,
    part: Sequence[str],
    order: Sequence[str],
    failed: str,
    percent: float,
    slices: int | None = None,
    fanout: int = FANOUT,
) -> DataFrame:
    """Rows up to and including the first failure that pushes the rate over ``percent``.

    Rows after it were never looked at, so they are left out. Only a failure can
    trip the breaker. Adds ``tripped``, true on the row that ended the run.
    """
    ordinary, hot = _split(outcomes, part)
    columns = [*outcomes.columns, *_RATES, "tripped"]
    pieces = []
    if ordinary is not None:
        rates = _ordinary(ordinary, part, order, failed).withColumn("tripped", _trips(failed, percent))
        earlier = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        marked = rates.withColumn("_stopped", F.coalesce(F.max("tripped").over(earlier), F.lit(False)))
        pieces.append(marked.where(~F.col("_stopped")).select(*columns))
    if hot is not None:
        rows = sliced(hot, part, order, slices)
        if percent > 0:
            stops = _stops(rows, failed, percent, fanout)
            kept = rows.join(stops, PART, "left").where(F.col("_stop").isNull() | (F.col(ROW) <= F.col("_stop")))
        else:
            kept = rows.withColumn("_stop", F.lit(None).cast("bigint"))
        rates = _over_slices(kept, failed, fanout)
        pieces.append(rates.withColumn("tripped", F.coalesce(F.col(ROW) == F.col("_stop"), F.lit(False))).select(*columns))
    return _union(pieces)
