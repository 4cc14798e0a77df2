"""Running totals in an order, over rows of any number.

A window over one large part is one task. Here rows are range-partitioned by part and
order into slices of about ``ROWS_PER_SLICE`` rows, and three steps give what a window
would:

1. slices are written once, each in order, so that later passes (and retried tasks) see
   the same slices whatever a sample of the keys would say the next time;
2. totals per (part, slice) are summed up level by level: at most ``FANOUT`` totals meet
   in one window, and blocks of that many make the next level, so neither the number of
   slices nor of levels is bounded;
3. a window per (slice, part) adds what came before its slice.

Values are any of the associative kinds below. Nothing is broadcast by this module: what
came before a slice is a written table, whose size Spark knows when it chooses the join.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierdown.scratch import scratch_dir

SLICE = "_slice"
ROW = "_row"
PART = "_part"
ROWS_PER_SLICE = 1 << 20
FANOUT = 1024

#: kind -> (aggregate, what joins two of its values, the value of no rows)
KINDS = {
    "sum": (F.sum, lambda a, b: a + b, 0),
    "max": (F.max, F.greatest, None),
    "xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b), 0),
}
Values = Mapping[str, tuple[str, Column]]


def part_key(part: Sequence[str]) -> Column:
    """A struct is never NULL itself, so rows without a part find their totals too."""
    return F.struct(*part) if part else F.struct(F.lit(0).alias("all"))


def slice_count(df: DataFrame) -> int:
    """As many slices as the rows need, and at least one for each shuffle partition."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, math.ceil(df.count() / ROWS_PER_SLICE))


def sliced(
    df: DataFrame, part: Sequence[str], order: Sequence[str], slices: int | None = None, kept: Sequence[Column | str] = ("*",)
) -> DataFrame:
    """``df`` as a written table with ``_part`` (a struct of the part columns), ``_slice``
    and ``_row``, a number that grows with part and order over the whole table. Of the
    columns, or of what is made of them, ``kept`` is written; it is worked out after the
    shuffle, not once more for the sample that the slices are cut by.

    Rows that are equal in all of ``part`` and ``order`` stay in one slice; columns of the
    same three names are refused by Spark.
    """
    at = scratch_dir(df.sparkSession, "slices")
    keys = [*part, *order]
    ordered = df.repartitionByRange(slices or slice_count(df), *keys).sortWithinPartitions(*keys)
    placed = ordered.select(*kept, part_key(part).alias(PART), F.spark_partition_id().alias(SLICE), F.monotonically_increasing_id().alias(ROW))
    placed.write.parquet(at)
    return df.sparkSession.read.parquet(at)


def totals_before(totals: DataFrame, values: Mapping[str, str], fanout: int = FANOUT) -> DataFrame:
    """For each ``_part, _slice`` of ``totals`` what all earlier slices of the part hold.

    ``values`` names the kind of each value column. A window never sees more than
    ``fanout`` rows. Slices without an earlier one have the value of no rows.
    """
    low, high = totals.agg(F.min(SLICE), F.max(SLICE)).first()
    if low is None or high - low < fanout:
        return _exclusive(totals, [PART], SLICE, values)
    block = F.floor((F.col(SLICE) - F.lit(low)) / F.lit(fanout)).cast("int")
    blocked = totals.withColumn("_block", block)
    within = _exclusive(blocked, [PART, "_block"], SLICE, values)
    upper = blocked.groupBy(PART, F.col("_block").alias(SLICE)).agg(*[KINDS[kind][0](name).alias(name) for name, kind in values.items()])
    above = totals_before(upper, values, fanout).select(
        PART, F.col(SLICE).alias("_block"), *[F.col(name).alias(f"_above_{name}") for name in values]
    )
    joined = within.join(above, [PART, "_block"], "left")
    return joined.select(PART, SLICE, *[_joined(kind, f"_above_{name}", name).alias(name) for name, kind in values.items()])


def _joined(kind: str, earlier: str, later: str) -> Column:
    aggregate, join, nothing = KINDS[kind]
    if nothing is None:
        return join(F.col(earlier), F.col(later))
    return join(F.coalesce(earlier, F.lit(nothing)), F.coalesce(later, F.lit(nothing)))


def _exclusive(rows: DataFrame, group: Sequence[str], order: str, values: Mapping[str, str]) -> DataFrame:
    window = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    others = [c for c in rows.columns if c not in values]
    found = {name: KINDS[kind][0](name).over(window) for name, kind in values.items()}
    return rows.select(*others, *[(c if KINDS[values[n]][2] is None else F.coalesce(c, F.lit(KINDS[values[n]][2]))).alias(n) for n, c in found.items()])


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table whose size Spark knows, cut off from its lineage."""
    at = scratch_dir(df.sparkSession, label)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def running(rows: DataFrame, values: Values, fanout: int = FANOUT) -> DataFrame:
    """``rows`` of ``sliced`` with each value taken from the start of its part up to and
    with the row."""
    kinds = {name: kind for name, (kind, _) in values.items()}
    totals = rows.groupBy(PART, SLICE).agg(*[KINDS[kind][0](column).alias(name) for name, (kind, column) in values.items()])
    before = written(totals_before(written(totals, "totals"), kinds, fanout), "before")
    before = before.select(PART, SLICE, *[F.col(name).alias(f"_before_{name}") for name in kinds])
    return _with_before(local(rows, values), before, kinds)


def local(rows: DataFrame, values: Values) -> DataFrame:
    """The same within each slice."""
    window = Window.partitionBy(SLICE, PART).orderBy(ROW).rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("*", *[KINDS[kind][0](column).over(window).alias(name) for name, (kind, column) in values.items()])


def _with_before(rows: DataFrame, before: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    joined = rows.join(before, [SLICE, PART], "left")
    names = [c for c in rows.columns if c not in kinds]
    return joined.select(*names, *[_joined(kind, f"_before_{name}", name).alias(name) for name, kind in kinds.items()])
