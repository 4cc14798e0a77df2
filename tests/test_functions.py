import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tierdown import functions as fn
from tierdown.operators import classify, expired, retained

AS_OF = datetime(2024, 1, 3)


def test_cutoff_honours_fractions_and_zones():
    assert fn.cutoff(AS_OF, 0.5) == datetime(2024, 1, 2, 23, 30)
    assert fn.cutoff(AS_OF.replace(tzinfo=timezone.utc), 24) == datetime(2024, 1, 2)
    for hours in (0, -1):
        with pytest.raises(ValueError):
            fn.cutoff(AS_OF, hours)


@pytest.mark.parametrize("dtype", ["timestamp", "timestamp_ntz", "date"])
def test_equal_age_and_unknown_age_are_kept(spark, dtype):
    rows = [("older", "2024-01-01"), ("equal", "2024-01-02"), ("newer", "2024-01-03"), ("none", None)]
    df = spark.createDataFrame(rows, "k STRING, t STRING").select("k", F.col("t").cast(dtype))
    old = {r.k for r in expired(df, "t", 24, AS_OF).collect()}
    young = {r.k for r in retained(df, "t", 24, AS_OF).collect()}
    assert old == {"older"}
    assert young == {"equal", "newer", "none"}
    flags = {r.k: r.expired for r in classify(df, "t", 24, AS_OF).collect()}
    assert flags == {"older": True, "equal": False, "newer": False, "none": False}


def test_date_column_with_a_cutoff_inside_the_day(spark):
    df = spark.createDataFrame([("2024-01-02",), ("2024-01-03",)], "t STRING")
    df = df.select(F.col("t").cast("date"))
    kept = retained(df, "t", 12, AS_OF).collect()
    # midnight of the 2nd lies before noon of the 2nd
    assert [str(r.t) for r in kept] == ["2024-01-03"]


def test_age_filter_reaches_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for rows, wanted in ((expired, "LessThan(ts"), (retained, "GreaterThanOrEqual(ts")):
        plan = rows(df, "ts", 240, datetime(2024, 1, 31)).select("event_id")._jdf
        text = plan.queryExecution().executedPlan().toString()
        assert wanted in text.split("PushedFilters")[1]
        assert "user_id" not in text


BUCKETS = [
    ("2026-01-24 15:30:00", "daily", "tar.gz", "backup-2026-01-24.tar.gz"),
    ("2026-01-24 15:30:00", "weekly", "tar.gz", "backup-2026-W04.tar.gz"),
    ("2026-01-24 15:30:00", "monthly", "tar.gz", "backup-2026-01.tar.gz"),
    ("2026-01-24 15:30:00", "daily", "tar", "backup-2026-01-24.tar"),
    ("2026-01-24 15:30:00", "daily", "zip", "backup-2026-01-24.zip"),
    ("2027-01-01 00:00:00", "weekly", "rar", "backup-2026-W53.tar.gz"),
    ("2026-01-24 15:30:00", "hourly", "zip", "backup-2026-01-24.zip"),
]


def test_container_names(spark):
    df = spark.createDataFrame(BUCKETS, "ts STRING, g STRING, f STRING, expected STRING")
    bucket = fn.archive_bucket(F.col("ts").cast("timestamp_ntz"), F.col("g"))
    name = fn.archive_name(bucket, F.col("f"))
    assert df.where(name != F.col("expected")).count() == 0
    for ts, group_by, format, expected in BUCKETS:
        instant = F.lit(ts).cast("timestamp")
        found = spark.range(1).select(fn.archive_name(fn.archive_bucket(instant, group_by), format))
        assert found.first()[0] == expected


def test_extensions(spark):
    row = spark.range(1).select(
        fn.extension_for("gzip"), fn.extension_for("none"), fn.extension_for("lz4"),
        fn.archive_extension("tar"), fn.archive_extension("rar"),
    ).first()
    assert tuple(row) == (".gz", "", "", ".tar", ".tar.gz")


def test_relative_keys_keep_folders_apart(spark):
    paths = ["/logs/app1/error.log", "/logs/app2/error.log", "/other/error.log", "/logsx/a"]
    df = spark.createDataFrame([(p,) for p in paths], "path STRING")
    for root in ("/logs", "/logs/"):
        keys = [r[0] for r in df.select(fn.relative_key("path", root)).collect()]
        assert keys == ["app1/error.log", "app2/error.log", None, None]


def test_destination_lists(spark):
    cases = [
        ("", ["d1", "d2"], ["d1", "d2"]),
        ("d1", ["d2", "d3"], ["d1", "d2", "d3"]),
        ("a", ["b", "", "a", "c", "b"], ["a", "b", "c"]),
        (None, None, []),
        ("a", None, ["a"]),
        ("", [None, "x"], ["x"]),
    ]
    df = spark.createDataFrame(cases, "s STRING, m ARRAY<STRING>, e ARRAY<STRING>")
    for row in df.select(fn.merge_destinations("s", "m").alias("got"), "e").collect():
        assert row.got == row.e


def test_ratios(spark):
    df = spark.createDataFrame([(1000, 200), (0, 0), (0, 5)], "o BIGINT, c BIGINT")
    rows = df.select(fn.compression_ratio("o", "c"), fn.space_saved("o", "c")).collect()
    assert [tuple(r) for r in rows] == [(20.0, 80.0), (100.0, 0.0), (100.0, 0.0)]


def test_rate_is_strict_and_zero_switches_off(spark):
    df = spark.createDataFrame([(9, 1), (0, 0), (0, 1)], "s BIGINT, f BIGINT")
    rates = [r[0] for r in df.select(fn.failure_rate("s", "f")).collect()]
    assert rates == [10.0, 0.0, 100.0]
    assert [r[0] for r in df.select(fn.breaches("s", "f", 10.0)).collect()] == [False, False, True]
    assert [r[0] for r in df.select(fn.breaches("s", "f", 0.0)).collect()] == [False] * 3


def test_sentences_round_like_printf(spark):
    chance = random.Random(5)
    rows = [(chance.randint(0, 4000), chance.randint(1, 400)) for _ in range(4000)]
    rows += [(1997, 3), (7, 1), (15, 1), (399, 1), (0, 1)]
    df = spark.createDataFrame(rows, "s BIGINT, f BIGINT")
    one = F.lit(1)
    for row in df.select("s", "f", fn.summary_line("s", "f", one, one).alias("line")).collect():
        rate = row.f / (row.s + row.f) * 100
        assert row.line == (
            f"completed with errors: {row.s} succeeded, {row.f} failed ({rate:.1f}% failure rate)"
        )


def test_clean_sentences(spark):
    row = spark.range(1).select(
        fn.summary_line(F.lit(3), F.lit(0), F.lit(3), F.lit(2)),
        fn.prune_summary_line(F.lit(1234), F.lit(0)),
        fn.prune_summary_line(F.lit(3), F.lit(1)),
    ).first()
    assert tuple(row) == (
        "completed: 3 files processed, 3 backed up, 2 pruned",
        "pruned 1234 files",
        "pruned 3 files, 1 failed (25.0% failure rate)",
    )
