import time
from collections import Counter
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest

from tierdown import plans, streaming
from tierdown.sources import event_stream

START = datetime(2024, 1, 1)
SCHEMA = "id BIGINT, ts TIMESTAMP_NTZ, size BIGINT"


@pytest.fixture
def source(spark, tmp_path):
    """One file per five days, an item every six hours, 30 days."""
    folder = f"{tmp_path}/src"
    rows = [(n, START + timedelta(hours=6 * n), n) for n in range(120)]
    for start in range(0, 120, 20):
        part = spark.createDataFrame(rows[start : start + 20], SCHEMA).coalesce(1)
        part.write.mode("append").parquet(folder)
        time.sleep(0.01)
    return folder


def stream_of(spark, source):
    return event_stream(spark, source, spark.read.parquet(source).schema, "ts")


def finished(spark, stream, base, group_by, hours=240):
    buckets = streaming.stream_expire_buckets(stream, "ts", hours, group_by, "size")
    streaming.write_buckets(buckets, f"{base}/out-{group_by}", f"{base}/cp-{group_by}").awaitTermination()
    return spark.read.schema(buckets.schema).parquet(f"{base}/out-{group_by}")


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_buckets_come_out_when_all_of_them_is_old(spark, source, tmp_path, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        daily = finished(spark, stream_of(spark, source), tmp_path, "daily")
        rows = {r.bucket: (r["items"], r.bytes) for r in daily.collect()}
        # newest item 2024-01-30 18:00, minus 240 h: the 20th is not yet over
        assert set(rows) == {f"2024-01-{d:02d}" for d in range(1, 20)}
        assert set(n for n, _ in rows.values()) == {4}
        assert rows["2024-01-02"] == (4, 4 + 5 + 6 + 7)
        # the month is not over yet; with its last day it is
        assert streaming.buckets_from_days(daily, "monthly").count() == 0
        last = daily.unionByName(spark.createDataFrame([("2024-01-31", 1, 5)], daily.schema))
        months = {tuple(r) for r in streaming.buckets_from_days(last, "monthly").collect()}
        assert months == {("2024-01", 77, sum(range(76)) + 5)}
        assert {r.bucket for r in streaming.buckets_from_days(daily, "weekly").collect()} == {"2024-W01", "2024-W02"}
        weekly = finished(spark, stream_of(spark, source), tmp_path, "weekly")
        assert {r.bucket: r["items"] for r in weekly.collect()} == {"2024-W01": 28, "2024-W02": 28}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_months_are_not_a_window(spark, source):
    with pytest.raises(ValueError):
        streaming.stream_expire_buckets(stream_of(spark, source), "ts", 240, "monthly")


@pytest.mark.parametrize("group_by", ["daily", "weekly", "monthly"])
def test_finished_buckets_and_late_rows_are_the_batch_answer(spark, tmp_path, group_by):
    from tierdown.functions import archive_bucket
    from pyspark.sql import functions as F

    source, out = f"{tmp_path}/src", f"{tmp_path}/out"
    spans = [range(0, 40), range(30, 70), range(5, 25), range(70, 110), [], range(0, 109, 7)]
    for n, days in enumerate(spans):
        rows = [(1000 * n + d, START + timedelta(days=d, hours=n), d) for d in days] + [(900 + n, None, 1)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = event_stream(spark, source, spark.read.parquet(source).schema, "ts", files_per_batch=1)
        streaming.stream_expire_with_late(stream, "ts", 240, out, f"{tmp_path}/cp", group_by, "size").awaitTermination()
    finished, late = streaming.finished_buckets(spark, out), streaming.late_rows(spark, out, stream.schema)
    assert late.count() > 20 and finished.groupBy("bucket").count().where("count > 1").count() == 0
    got = {tuple(r) for r in streaming.buckets_with_late(finished, late, "ts", group_by, "size").collect()}
    whole = spark.read.parquet(source).where("ts is not null").withColumn("bucket", archive_bucket("ts", group_by))
    whole = whole.withColumn("ends", streaming.expiry.bucket_end(F.col("ts"), group_by))
    limit = START + timedelta(days=109, hours=3) - timedelta(hours=240)
    expected = whole.where(F.col("ends").cast("timestamp_ntz") <= F.lit(limit)).groupBy("bucket").agg(F.count("id"), F.sum("size"))
    assert got == {tuple(r) for r in expected.collect()}


def test_stream_backup_is_complete_and_survives_a_restart(spark, source, tmp_path):
    targets = [f"{tmp_path}/a", f"{tmp_path}/b"]
    as_of = START + timedelta(days=30)
    reports = []

    def run():
        stream = stream_of(spark, source)
        streaming.stream_backup(
            stream, "ts", 240, as_of, targets, f"{tmp_path}/cp", report=lambda b, o: reports.append(b)
        ).awaitTermination()

    run()
    for target in targets:
        assert sorted(r.id for r in spark.read.parquet(target).collect()) == list(range(80))
    spark.createDataFrame([(500, START, 1)], SCHEMA).write.mode("append").parquet(source)
    run()
    for target in targets:
        assert sorted(r.id for r in spark.read.parquet(target).collect()) == [*range(80), 500]
    assert len(reports) == 3 and reports[0] == 0


def test_streams_into_one_destination_and_rows_that_wait(spark, source, tmp_path):
    def run(name, days, targets):
        streaming.stream_backup(
            stream_of(spark, source), "ts", 240, START + timedelta(days=days), targets, f"{tmp_path}/cp-{name}"
        ).awaitTermination()

    run("one", 30, [f"{tmp_path}/v"])
    run("two", 20, [f"{tmp_path}/v"])
    held = Counter(r.id for r in spark.read.parquet(f"{tmp_path}/v").collect())
    assert held == Counter(range(80)) + Counter(range(40))
    run("two", 30, [f"{tmp_path}/v"])  # nothing new came, but the cutoff moved
    held = Counter(r.id for r in spark.read.parquet(f"{tmp_path}/v").collect())
    assert held == Counter(range(80)) + Counter(range(80))


def test_a_missed_destination_is_made_good(spark, source, tmp_path):
    blocked, good = tmp_path / "blocked", f"{tmp_path}/good"
    blocked.write_text("in the way")

    def run():
        streaming.stream_backup(
            stream_of(spark, source), "ts", 240, START + timedelta(days=30), [str(blocked), good], f"{tmp_path}/cp"
        ).awaitTermination()

    run()
    blocked.rename(tmp_path / "moved")
    spark.createDataFrame([(500, START, 1)], SCHEMA).write.mode("append").parquet(source)
    run()
    for target in (str(blocked), good):
        assert sorted(r.id for r in spark.read.parquet(target).collect()) == [*range(80), 500]


def test_an_interrupted_tick_is_finished_by_the_next_start(spark, source, tmp_path):
    half = tmp_path / "kept-0" / "_temporary"
    half.mkdir(parents=True)
    (tmp_path / "kept-0" / "part-00000.parquet").write_text("half")
    result = plans.run_once(
        spark, source, f"{tmp_path}/kept-0", "ts", 240, START + timedelta(days=30), destinations=[f"{tmp_path}/vault"]
    )
    assert spark.read.parquet(f"{tmp_path}/kept-0").count() == result.metrics["kept"] > 0
    with pytest.raises(FileExistsError):
        plans.run_once(
            spark, source, f"{tmp_path}/kept-0", "ts", 240, START + timedelta(days=30), destinations=[f"{tmp_path}/vault"]
        )


def stored(root):
    return {str(p): p.stat().st_size for p in Path(root).rglob("*.parquet")}


def test_a_batch_writes_what_came_and_what_is_due(spark, tmp_path):
    """Ten equal batches of young rows: each writes the same, and a start opens due hours only."""
    source, cp = f"{tmp_path}/src", f"{tmp_path}/cp"
    written, seen = [], set()

    def run(days, report=None):
        streaming.stream_backup(
            stream_of(spark, source), "ts", 240, START + timedelta(days=days), [f"{tmp_path}/v"], cp, report=report
        ).awaitTermination()

    for n in range(6):
        rows = [(100 * n + k, START + timedelta(days=20, hours=k % 5), 1) for k in range(20)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        run(10)
        young = stored(f"{cp}-tierdown-backup/young")
        written.append(sum(size for path, size in young.items() if path not in seen))
        seen.update(young)
    assert max(written) < 1.2 * min(written)
    assert len(list(Path(f"{cp}-tierdown-backup/done").iterdir())) <= 3
    before = stored(f"{cp}-tierdown-backup/young")
    run(30 + 2.5 / 24)  # the hours 0, 1 and half of 2 are due
    after = stored(f"{cp}-tierdown-backup/young")
    late = {p: s for p, s in before.items() if f"slot={int(START.replace(tzinfo=timezone.utc).timestamp()) // 3600 + 20 * 24 + 3}" in p or f"slot={int(START.replace(tzinfo=timezone.utc).timestamp()) // 3600 + 20 * 24 + 4}" in p}
    assert late and late.items() <= after.items()
    held = Counter(r.id for r in spark.read.parquet(f"{tmp_path}/v").collect())
    assert held == Counter(100 * n + k for n in range(6) for k in range(20) if k % 5 <= 2)
    run(40)
    held = Counter(r.id for r in spark.read.parquet(f"{tmp_path}/v").collect())
    assert held == Counter(100 * n + k for n in range(6) for k in range(20))
    assert not stored(f"{cp}-tierdown-backup/young")


@pytest.mark.parametrize("broken", ["hold", "finish", "clear"])
def test_a_step_that_was_cut_off_is_done_once(spark, tmp_path, monkeypatch, broken):
    from tierdown.streaming import fanout

    source = f"{tmp_path}/src"
    spark.createDataFrame([(k, START + timedelta(hours=k), 1) for k in range(30)], SCHEMA).coalesce(1).write.parquet(source)

    def run(hours):
        streaming.stream_backup(
            stream_of(spark, source), "ts", 240, START + timedelta(hours=240 + hours), [f"{tmp_path}/v"], f"{tmp_path}/cp"
        ).awaitTermination()

    def ids():
        return Counter(r.id for r in spark.read.parquet(f"{tmp_path}/v").collect())

    run(9.5)
    plain, calls = getattr(fanout._Ledger, broken), []

    def cut(self, *args):
        if broken != "clear" or calls:
            raise RuntimeError("lost")
        calls.append(1)
        return plain(self, *args)

    with monkeypatch.context() as patch:
        patch.setattr(fanout._Ledger, broken, cut)
        with pytest.raises(RuntimeError, match="lost"):
            run(19.5)
    run(19.5)
    assert ids() == Counter(range(20))
    run(500)
    assert ids() == Counter(range(30))


def test_stream_backup_fails_rather_than_skips(spark, source, tmp_path):
    (tmp_path / "blocked").write_text("in the way")
    as_of = START + timedelta(days=30)
    query = streaming.stream_backup(
        stream_of(spark, source), "ts", 240, as_of, [f"{tmp_path}/blocked"], f"{tmp_path}/cp"
    )
    with pytest.raises(Exception, match="blocked"):
        query.awaitTermination()


def test_run_every_reads_afresh_and_stops_between_ticks(spark, source, tmp_path):
    seen = []

    def cycle(tick):
        result = plans.run_once(
            spark, source, f"{tmp_path}/kept-{tick}", "ts", 240, START + timedelta(days=30),
            destinations=[f"{tmp_path}/vault"], run_id=f"tick-{tick}",
        )
        seen.append((tick, result.metrics["pruned"]))
        # an old item arrives before the next tick
        late = spark.createDataFrame([(1000 + tick, START, 1)], SCHEMA)
        late.write.mode("append").parquet(source)

    query = streaming.run_every(spark, cycle, 0.5, max_cycles=3, checkpoint=f"{tmp_path}/cp")
    assert seen == [(0, 80), (1, 81), (2, 82)]
    assert not query.isActive
    assert {p.name for p in Path(tmp_path / "vault").iterdir()} == {"run_id=tick-0", "run_id=tick-1", "run_id=tick-2"}


def test_run_every_reports_a_failing_cycle(spark, tmp_path):
    def cycle(tick):
        raise RuntimeError("disk on fire")

    with pytest.raises(Exception, match="disk on fire"):
        streaming.run_every(spark, cycle, 0.5, max_cycles=2, checkpoint=f"{tmp_path}/cp")
