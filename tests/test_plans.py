import hashlib
import json
import os
import time
from collections import Counter
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tierdown import plans
from tierdown.operators import merge_results, restore_over
from tierdown.plans import cycle as cycles
from tierdown.sources import decompress_read, file_inventory, object_reader, read_policies, read_with_errors
from tierdown.sources.readable import tolerant

AS_OF = datetime(2024, 1, 31)


@pytest.fixture(scope="module")
def items(spark):
    """40 days, an item exactly at the cutoff of 240 h, and one without an age."""
    rows = [(n, AS_OF - timedelta(days=n), f"log line {n}", 10 + n) for n in range(40)]
    rows += [(100, None, "no age", 7)]
    return spark.createDataFrame(rows, "id BIGINT, ts TIMESTAMP_NTZ, text STRING, size BIGINT").coalesce(2)


OLD = {n for n in range(40) if n > 10}


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


@pytest.fixture
def blocked(tmp_path):
    """A destination nothing can be written to: a file stands in its place."""
    (tmp_path / "blocked").write_text("in the way")
    return str(tmp_path / "blocked")


# ---- backup --------------------------------------------------------------------------


def test_backup_to_three_destinations(spark, items, tmp_path):
    targets = [f"{tmp_path}/{n}" for n in "abc"]
    outcomes = plans.backup(items, targets, "run-1", "gzip", 9, "size")
    assert [o.ok for o in outcomes] == [True] * 3
    assert {(o.items, o.bytes) for o in outcomes} == {(41, sum(range(10, 50)) + 7)}
    held = plans.read_copies(spark, outcomes, items.schema)
    per = Counter(r.destination for r in held.collect())
    assert per == {t: 41 for t in targets}
    assert list(Path(targets[0]).rglob("*.gz.parquet"))
    table = plans.copy_outcomes(spark, "run-1", outcomes)
    assert table.where("ok").count() == 3


def test_a_bad_destination_does_not_stop_the_others(spark, items, tmp_path, blocked):
    good = f"{tmp_path}/good"
    outcomes = plans.backup(items, [blocked, good], "run-1")
    assert [o.ok for o in outcomes] == [False, True]
    assert outcomes[0].err
    assert plans.read_copies(spark, outcomes, items.schema, only_good=False).count() == 41


def test_a_repeated_run_replaces_only_itself(spark, items, tmp_path):
    target = f"{tmp_path}/v"
    for run in ("r1", "r2", "r2"):
        plans.backup(items, [target], run)
    assert spark.read.parquet(target).count() == 2 * 41


def test_a_copy_that_differs_is_not_ok(spark, items, tmp_path):
    from tierdown.plans.copying import checked_copy

    def write(rows, path):
        rows.write.parquet(path)

    def read(path):  # one row is lost on the way back
        return spark.read.parquet(path).where("id <> 3")

    outcome = checked_copy(items, items.schema, "d", f"{tmp_path}/x", write, read)
    assert not outcome.ok and "found 40" in outcome.err


def test_fingerprint_sees_changes_not_order(spark, items):
    base = plans.fingerprint(items)
    assert plans.fingerprint(items.repartition(7)) == base
    assert plans.fingerprint(items.withColumn("size", F.col("size") + F.when(F.col("id") == 5, 1).otherwise(0))) != base
    assert plans.fingerprint(items.limit(0))["items"] == 0


def test_compression_levels_and_text_round_trip(spark, tmp_path):
    line = "this is a repeated log line for compression testing "
    df = spark.range(2000).select(F.concat(F.lit(line), F.col("id")).alias("value")).coalesce(1)
    sizes = {}
    for name, algorithm, level in (("plain", "none", 6), ("fast", "gzip", 1), ("best", "gzip", 9)):
        path = f"{tmp_path}/{name}"
        plans.write_compressed(df, path, algorithm, level, "text")
        sizes[name] = sum(f.stat().st_size for f in Path(path).glob("part-*"))
        assert decompress_read(spark, path).exceptAll(df).count() == 0
    assert sizes["best"] < sizes["fast"] < sizes["plain"] / 2
    with pytest.raises(ValueError):
        plans.write_compressed(df, f"{tmp_path}/z", "lz4")


# ---- containers ----------------------------------------------------------------------


def test_archive_and_restore(spark, items, tmp_path):
    old = items.where("id > 10 and id < 100")
    targets = [f"{tmp_path}/a", f"{tmp_path}/b"]
    outcomes = plans.archive_table(old, "ts", targets, "r1", "monthly", size="size")
    assert [(o.ok, o.items) for o in outcomes] == [(True, 29)] * 2
    for target in targets:
        back = plans.restore(spark, target, "id")
        assert back.select(*old.columns).exceptAll(old).count() == 0 and back.count() == 29
    december = plans.restore(spark, targets[0], "id", buckets=["2023-12"])
    assert {r.bucket for r in december.collect()} == {"2023-12"}
    plan = december._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters")[1][:80]
    sizes = plans.archive_sizes(plans.open_archive(spark, targets[0])).collect()
    assert sum(r["items"] for r in sizes) == 29 and all(r.archive_size > 0 for r in sizes)


def test_daily_buckets_stay_text(spark, items, tmp_path):
    plans.archive_table(items.where("id = 12"), "ts", [f"{tmp_path}/v"], "0007", "daily")
    row = plans.open_archive(spark, f"{tmp_path}/v").first()
    assert (row.bucket, row.run_id) == ("2024-01-19", "0007")


def test_a_second_run_in_the_same_period_loses_nothing(spark, items, tmp_path):
    vault = f"{tmp_path}/v"
    first, second = items.where("id in (11, 12)"), items.where("id in (12, 13)")
    plans.archive_table(first, "ts", [vault], "r1", bucket_by="run", run_time=AS_OF)
    plans.archive_table(second.withColumn("size", F.lit(0).cast("bigint")), "ts", [vault], "r2", bucket_by="run", run_time=AS_OF)
    everything = plans.open_archive(spark, vault)
    assert {r.bucket for r in everything.collect()} == {"2024-01-31"}
    assert ids(everything) == [11, 12, 12, 13]
    assert {(r.id, r["size"]) for r in plans.restore(spark, vault, "id").collect()} == {(11, 21), (12, 0), (13, 0)}
    assert ids(plans.restore(spark, vault, "id", as_of_run="r1")) == [11, 12]


def test_empty_archive(spark, items, tmp_path):
    outcomes = plans.archive_table(items.limit(0), "ts", [f"{tmp_path}/v"], "r1")
    assert outcomes[0].items == 0


def test_later_copies_come_from_a_good_one(spark, items, tmp_path, blocked):
    targets = [blocked, f"{tmp_path}/b", f"{tmp_path}/c"]
    outcomes = plans.archive_table(items.where("id > 10 and id < 100"), "ts", targets, "r1")
    assert [o.ok for o in outcomes] == [False, True, True]


# ---- object stores -------------------------------------------------------------------


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "logs dir"
    contents = {
        "old.log": (48, b"old log data"),
        "new.log": (0, b"new log data"),
        "half.log": (12, b"new log data"),
        "app1/logs/error.log": (48, b"error log from app1"),
        "app2/logs/error.log": (48, b"error log from app2"),
        "big.bin": (48, os.urandom(5000)),
    }
    for name, (age, data) in contents.items():
        file = root / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(data)
        stamp = time.time() - age * 3600
        os.utime(file, (stamp, stamp))
    return str(root), contents


def utc_now():
    return datetime.now(timezone.utc).replace(tzinfo=None)


def test_inventory(spark, folder):
    root, contents = folder
    for spelling in (root, root + "/", "file:" + root):
        rows = file_inventory(spark, spelling).collect()
        assert {r.rel_path: r["size"] for r in rows} == {k: len(d) for k, (_, d) in contents.items()}
    plan = file_inventory(spark, root)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


def most_rows_dealt(df):
    """(rows of the result, most rows that one exchange of its plan wrote), without broadcasts."""
    df.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = df.collect()
    finally:
        df.sparkSession.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    written, nodes = [], [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        kind = node.getClass().getSimpleName()
        if kind == "ShuffleExchangeExec":
            written.append(node.metrics().get("shuffleRecordsWritten").get().value())
        if kind == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            nodes.append(node.plan())
        nodes += [node.children().apply(n) for n in range(node.children().size())]
    return rows, max(written)


def test_rows_are_summed_by_file_before_they_meet_its_age(spark, tmp_path):
    from tierdown.catalog import QUERIES

    flags, table = ("A", "N", None), tmp_path / "lineitem.parquet"
    rows = [(None if n % 7 == 0 else n % 50, flags[n % 3]) for n in range(6000)] + [(None, "keyless")] * 3
    spark.createDataFrame(rows, "l_orderkey BIGINT, l_returnflag STRING").repartition(4).write.parquet(str(table))
    first, *others = sorted(table.glob("*.parquet"))
    old = spark.read.parquet(str(first)).collect()
    assert len(others) == 3 and old
    os.utime(first, (86400 * 3653, 86400 * 3653))  # early in 1980
    expected = {
        flag: (len(keys), sum(k for k in keys if k is not None) if any(k is not None for k in keys) else None,
               len(keys), sum(r.l_returnflag == flag for r in old), len(rows))
        for flag in (*flags, "keyless")
        for keys in [[k for k, f in rows if f == flag]]
    }
    found, dealt = most_rows_dealt(QUERIES["table_file_ages"](spark, str(tmp_path)))
    assert {r.l_returnflag: (r["items"], r.key_sum, r.expired_items, r.early_items, r.file_items) for r in found} == expected
    # a file's rows come to one row for each flag and task, however many they are
    assert dealt <= 4 * 4 * 4


def test_rows_of_sound_files_are_counted_before_errors_are_looked_up(spark, tmp_path):
    from tierdown.catalog import QUERIES

    spark.range(3000).selectExpr("id AS doc_id", "string(id) AS text").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("nation", "region"):
        spark.range(25).selectExpr("id AS n", "string(id) AS name").write.parquet(f"{tmp_path}/{name}.parquet")
    found, dealt = most_rows_dealt(QUERIES["access_errors"](spark, str(tmp_path)))
    assert {(r.format, r.errors, r.broken, r["items"]) for r in found} == {
        ("gz", 1, "broken.gz", 3000), ("parquet", 1, "broken.parquet", 25)
    }
    assert dealt < 100


def test_object_archive_round_trip(spark, folder, tmp_path):
    root, contents = folder
    outcomes, oversize = plans.archive_objects(
        spark, root, [f"{tmp_path}/v"], "r1", 24, utc_now(), max_bytes=1000
    )
    assert outcomes[0].ok and outcomes[0].items == 3
    assert [r.key for r in oversize.collect()] == ["big.bin"]
    back = plans.restore(spark, f"{tmp_path}/v", "rel_path").collect()
    found = {r.rel_path: hashlib.sha256(r.content).hexdigest() for r in back}
    wanted = ("old.log", "app1/logs/error.log", "app2/logs/error.log")
    assert found == {k: hashlib.sha256(contents[k][1]).hexdigest() for k in wanted}
    with pytest.raises(ValueError):
        plans.archive_objects(spark, root, [root + "/backup"], "r1", 24, utc_now())


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_age_of_files_is_strict(spark, tmp_path, zone):
    moment = datetime(2024, 1, 2, 3, 4, 5, 500_000)
    for name, shift in (("older", -0.001), ("equal", 0), ("newer", 0.001)):
        file = tmp_path / "in" / name
        file.parent.mkdir(exist_ok=True)
        file.write_text(name)
        stamp = moment.replace(tzinfo=timezone.utc).timestamp() + shift
        os.utime(file, (stamp, stamp))
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        found = [r.rel_path for r in file_inventory(spark, f"{tmp_path}/in", moment).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert found == ["older"]


def test_size_filter_reaches_the_object_reader(spark, folder):
    objects, _ = object_reader(spark, folder[0], max_bytes=1000)
    plan = objects._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,1000)" in plan


def test_unreadable_files_are_reported(spark, tmp_path):
    root = f"{tmp_path}/tables"
    spark.range(10).coalesce(1).write.parquet(root)
    (Path(root) / "broken one.parquet").write_bytes(b"this is not parquet at all")
    listed = file_inventory(spark, root)
    schema = "id BIGINT"
    good, errors = read_with_errors(
        listed, lambda s: s.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(root)
    )
    assert good.count() == 10
    row = errors.first()
    assert errors.count() == 1 and row.operation == "access" and "broken" in row.key
    assert tolerant(spark, "text", root).count() > 0


@pytest.mark.parametrize("cut", [3, 200, -1, -4, -9])
def test_cut_off_streams_are_found(spark, tmp_path, cut):
    import gzip

    from tierdown.sources import broken_streams, file_inventory, read_with_errors
    from tierdown.sources.readable import tolerant

    folder = tmp_path / "gz"
    folder.mkdir()
    body = "".join(f"line {n} {n * n}\n" for n in range(3000)).encode()
    whole = gzip.compress(body)
    (folder / "good.gz").write_bytes(whole)
    (folder / "two members.gz").write_bytes(gzip.compress(body[:900]) + gzip.compress(body[900:]) + bytes(5))
    (folder / "empty.gz").write_bytes(b"")
    (folder / "cut.gz").write_bytes(whole[:cut])
    hurt = bytearray(whole)
    hurt[len(hurt) // 2] ^= 255
    (folder / "hurt.gz").write_bytes(bytes(hurt))
    (folder / "members.gz").write_bytes(whole + whole[:cut])
    found = {Path(r.key).name: r.err for r in broken_streams(spark, str(folder)).collect()}
    assert set(found) == {"cut.gz", "hurt.gz", "members.gz"} and "end" in found["cut.gz"]
    read = lambda s: tolerant(s, "text", str(folder), schema="value string")
    _, errors = read_with_errors(file_inventory(spark, str(folder)), read, broken_streams(spark, str(folder)))
    assert sorted(Path(r.key).name for r in errors.collect()) == ["cut.gz", "hurt.gz", "members.gz"]


# ---- prune ---------------------------------------------------------------------------


def test_generation_is_checked(spark, items, tmp_path):
    keep, go = plans.split_for_prune(items, "ts", 240, AS_OF)
    assert set(ids(go)) == OLD and keep.count() == 12
    assert plans.prune_generation(keep, 12, f"{tmp_path}/g1") == 12
    plans.point_view(spark, "current_items", f"{tmp_path}/g1")
    assert spark.table("current_items").count() == 12
    with pytest.raises(plans.PruneMismatch):
        plans.prune_generation(keep, 13, f"{tmp_path}/g2")
    assert not Path(f"{tmp_path}/g2").exists() and plans.prune_generation(keep, 12, f"{tmp_path}/g2") == 12


def test_a_generation_replaces_nothing(spark, items, tmp_path):
    source = f"{tmp_path}/src"
    items.write.parquet(source)
    df = spark.read.parquet(source)
    other = f"{tmp_path}/other"
    items.write.parquet(other)
    with pytest.raises(ValueError, match="source"):
        plans.backup_then_prune(df, "ts", 240, AS_OF, source, [f"{tmp_path}/a"], key="id")
    with pytest.raises(FileExistsError):
        plans.backup_then_prune(df, "ts", 240, AS_OF, other, [f"{tmp_path}/a"], key="id")
    assert spark.read.parquet(other).count() == 41
    assert not Path(f"{tmp_path}/a").exists()
    with pytest.raises(Exception, match="(?i)already exists"):
        plans.prune_generation(df, 41, source)
    assert spark.read.parquet(source).count() == 41


def file_table(spark, items, root, files=8):
    items.repartitionByRange(files, "ts").write.parquet(root)
    return {p.name: (p.stat().st_mtime_ns, p.stat().st_size) for p in Path(root).glob("*.parquet")}


def test_alive_files_are_left_alone(spark, items, tmp_path):
    root = f"{tmp_path}/table"
    before = file_table(spark, items, root)
    report = plans.prune_files(spark, root, "ts", 240, AS_OF)
    assert report["pruned"] == len(OLD) and report["kept"] == 12
    assert report["dead_files"] >= 4 and report["mixed_files"] <= 2 and report["alive_files"] >= 1
    after = {p.name: (p.stat().st_mtime_ns, p.stat().st_size) for p in Path(root).glob("*.parquet")}
    assert len(after) == report["alive_files"] and after.items() <= before.items()
    assert ids(plans.read_snapshot(spark, root, "ts")) == sorted({*range(11), 100})
    # nothing more expires: no file is written, no snapshot made
    again = plans.prune_files(spark, root, "ts", 240, AS_OF)
    assert again["bytes_written"] == again["pruned"] == 0 and again["snapshot"] == report["snapshot"]
    assert ids(plans.read_snapshot(spark, root, "ts")) == sorted({*range(11), 100})


def test_bytes_written_grow_with_what_expires(spark, tmp_path):
    rows = spark.range(20_000).selectExpr("id", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, int(id)) AS ts", "sha2(string(id), 256) AS text")
    written = []
    for hours in (1, 60, 120):  # the same cutoff within one file, whatever is alive beside it
        root = f"{tmp_path}/t{hours}"
        rows.where(f"id < {hours * 160}").repartitionByRange(hours, "id").write.parquet(root)
        report = plans.prune_files(spark, root, "ts", 24, datetime(2024, 1, 2, 1))
        assert report["pruned"] == 60 and report["alive_files"] == hours - 1
        written.append(report["bytes_written"])
    assert max(written) < 2 * min(written)


def test_new_files_and_folders_join_the_table(spark, items, tmp_path):
    root = f"{tmp_path}/a table"
    dated = items.selectExpr("*", "cast(ts as date) AS day")
    dated.where("id < 30").write.partitionBy("day").parquet(root)
    assert plans.prune_files(spark, root, "ts", 240, AS_OF)["pruned"] == 19
    dated.where("id >= 30").write.partitionBy("day").mode("append").parquet(root)
    dated.where("id < 0").drop("day").write.mode("append").parquet(f"{root}/day=2020-01-01")
    report = plans.prune_files(spark, root, "ts", 240, AS_OF)
    assert report["pruned"] == 10 and report["kept"] == 12
    left = plans.read_snapshot(spark, root, "ts", dated.schema)
    assert ids(left) == sorted({*range(11), 100}) and left.where("day <> cast(ts as date)").count() == 0
    later = plans.prune_files(spark, root, "ts", 12, AS_OF + timedelta(days=1), dated.schema)
    assert later["kept"] == 1 and ids(plans.read_snapshot(spark, root, "ts", dated.schema)) == [100]


@pytest.mark.parametrize("broken", ["after the copy", "staged", "removal"])
def test_an_interrupted_run_goes_on(spark, items, tmp_path, monkeypatch, broken):
    from tierdown.plans import snapshots

    root, copies = f"{tmp_path}/table", [f"{tmp_path}/a", f"{tmp_path}/b"]
    file_table(spark, items, root)
    made = []
    plain_backup, plain_remove = snapshots.backup, snapshots.folders.remove
    monkeypatch.setattr(snapshots, "backup", lambda *a, **k: made.append(1) or plain_backup(*a, **k))

    def stop(*_):
        raise RuntimeError("lost")

    def half(spark, paths):
        plain_remove(spark, paths[: len(paths) // 2])
        stop()

    with monkeypatch.context() as patch:
        if broken == "removal":
            patch.setattr(snapshots.folders, "remove", half)
        else:
            patch.setattr(snapshots, "_stage" if broken == "after the copy" else "_switch", stop)
        with pytest.raises(RuntimeError, match="lost"):
            plans.backup_then_prune_files(spark, root, "ts", 240, AS_OF, copies, run_id="r1")
    if broken != "removal":
        assert ids(plans.read_snapshot(spark, root, "ts")) == sorted({*range(40), 100})
    result = plans.backup_then_prune_files(spark, root, "ts", 240, AS_OF, copies, run_id="r1")
    assert len(made) == 1 and result.metrics["pruned"] == result.metrics["backed_up"] == len(OLD) and result.metrics["kept"] == 12
    assert ids(plans.read_snapshot(spark, root, "ts")) == sorted({*range(11), 100})
    assert all(set(ids(spark.read.parquet(c))) == OLD for c in copies)
    assert len(list(Path(root).glob("*.parquet"))) <= 3


def test_files_keep_rows_without_a_proven_copy(spark, items, tmp_path, blocked, monkeypatch):
    from tierdown.plans import snapshots

    root = f"{tmp_path}/table"
    file_table(spark, items, root)
    with pytest.raises(plans.BackupFailed):
        plans.backup_then_prune_files(spark, root, "ts", 240, AS_OF, [blocked], run_id="r")
    plain = snapshots.backup

    def partly(rows, destinations, run_id, algorithm):
        plain(rows.where("id <> 20"), destinations, run_id, algorithm)
        return [plans.CopyOutcome(d, f"{d}/run_id={run_id}", False, "cut off", 0, 0, 0.0) for d in destinations]

    monkeypatch.setattr(snapshots, "backup", partly)
    with pytest.raises(plans.ThresholdExceeded):
        plans.backup_then_prune_files(spark, root, "ts", 240, AS_OF, [f"{tmp_path}/a"], run_id="r", error_threshold_percent=1.0)
    result = plans.backup_then_prune_files(spark, root, "ts", 240, AS_OF, [f"{tmp_path}/a"], run_id="r")
    assert result.metrics["pruned"] == len(OLD) - 1 and result.metrics["failed"] == 1
    assert ids(plans.read_snapshot(spark, root, "ts")) == sorted({*range(11), 20, 100})


def test_only_backed_up_rows_may_go(spark, items):
    held = items.where("id in (5, 20, 21, 22)").withColumn("destination", F.lit("a"))
    held = held.withColumn("text", F.when(F.col("id") == 22, "another text").otherwise(F.col("text")))  # the key alone is there
    keep, go = plans.split_for_prune(items, "ts", 240, AS_OF, held)
    assert ids(go) == [20, 21]
    assert len(ids(keep)) == 39 and keep.where("ts is null").count() == 1


def test_a_proof_is_written_once(spark, items, tmp_path):
    held = items.where("id in (5, 20, 21, 22)").withColumn("destination", F.lit("a"))
    held = held.withColumn("text", F.when(F.col("id") == 22, "another text").otherwise(F.col("text")))
    at = f"{tmp_path}/proven"
    sizes = {r.id: r.size for r in items.where("id in (20, 21)").collect()}
    assert plans.write_proven(items, "ts", 240, AS_OF, held, at, "size") == (2, sum(sizes.values()))
    kept = plans.keep_unproven(items, "ts", 240, AS_OF, spark.read.parquet(at))
    assert ids(kept) == ids(plans.split_for_prune(items, "ts", 240, AS_OF, held)[0])
    assert "a" not in {c for c in kept.columns} and kept.columns == items.columns
    # nothing held proves nothing, and an earlier proof is replaced
    assert plans.write_proven(items, "ts", 240, AS_OF, held.limit(0), at) == (0, 0)
    assert plans.keep_unproven(items, "ts", 240, AS_OF, spark.read.parquet(at)).count() == items.count()


def partitioned(spark, items, name):
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    df = items.withColumn("month", F.date_format("ts", "yyyy-MM"))
    df.write.partitionBy("month").saveAsTable(name)
    return name


def test_prune_by_partition(spark, items):
    table = partitioned(spark, items, "by_month")
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    report = plans.prune_partitions(spark, table, "ts", "month", 240, AS_OF)
    assert report == {"dropped_partitions": 1, "rewritten_partitions": 1, "pruned": 29}
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before
    left = spark.table(table)
    assert set(ids(left)) == set(range(11)) | {100}
    assert left.where("month is null").count() == 1
    again = plans.prune_partitions(spark, table, "ts", "month", 240, AS_OF)
    assert again["pruned"] == 0


def test_prune_by_partition_keeps_what_has_no_copy(spark, items, tmp_path):
    table = partitioned(spark, items, "by_month_safe")
    held = spark.table(table).where("id <> 35").withColumn("destination", F.lit("a"))
    held = held.withColumn("text", F.when(F.col("id") == 36, "another text").otherwise(F.col("text")))
    at = f"{tmp_path}/held"
    held.write.parquet(at)
    report = plans.prune_partitions(spark, table, "ts", "month", 240, AS_OF, spark.read.parquet(at))
    assert report == {"dropped_partitions": 0, "rewritten_partitions": 2, "pruned": 27}
    assert set(ids(spark.table(table))) == set(range(11)) | {35, 36, 100}


# ---- whole runs ----------------------------------------------------------------------


def test_full_run(spark, items, tmp_path):
    result = plans.backup_then_prune(
        items, "ts", 240, AS_OF, f"{tmp_path}/kept", [f"{tmp_path}/a", f"{tmp_path}/b"],
        key="id", size="size", run_id="r1",
    )
    m = result.metrics
    assert (m["backed_up"], m["pruned"], m["failed"], m["skipped"], m["kept"]) == (29, 29, 0, 12, 12)
    assert m["total_bytes"] == sum(10 + n for n in OLD)
    for target in "ab":
        assert set(ids(spark.read.parquet(f"{tmp_path}/{target}"))) == OLD
    assert set(ids(spark.read.parquet(result.kept_path))).isdisjoint(OLD)
    assert result.to_df(spark).first().run_id == "r1"


def test_one_good_destination_is_enough(spark, items, tmp_path, blocked):
    result = plans.backup_then_prune(
        items, "ts", 240, AS_OF, f"{tmp_path}/kept", [blocked, f"{tmp_path}/b"], key="id"
    )
    assert (result.metrics["copies"], result.metrics["pruned"]) == (1, 29)


@pytest.mark.parametrize("group_by", [None, "weekly"])
def test_nothing_is_pruned_without_a_copy(spark, items, tmp_path, blocked, group_by):
    kept = f"{tmp_path}/kept"
    with pytest.raises(plans.BackupFailed):
        plans.backup_then_prune(items, "ts", 240, AS_OF, kept, [blocked], key="id", group_by=group_by)
    assert not Path(kept).exists()
    result = plans.backup_then_prune(
        items, "ts", 240, AS_OF, kept, [blocked], key="id", group_by=group_by, prune_unbacked=True
    )
    assert (result.metrics["failed"], result.metrics["pruned"]) == (29, 29)


def incomplete(monkeypatch, lost):
    """Copies that miss some items, as after a crash half-way."""
    real = cycles.backup

    def lossy(df, destinations, run_id, *args, **kwargs):
        outcomes = real(df.where(~F.col("id").isin(lost)), destinations, run_id, *args, **kwargs)
        return [o.__class__(**{**o.__dict__, "ok": False, "err": "incomplete"}) for o in outcomes]

    monkeypatch.setattr(cycles, "backup", lossy)


def test_incomplete_copies_are_matched_by_key(spark, items, tmp_path, monkeypatch):
    incomplete(monkeypatch, [20, 30])
    result = plans.backup_then_prune(
        items, "ts", 240, AS_OF, f"{tmp_path}/kept", [f"{tmp_path}/a"], key="id", size="size"
    )
    m = result.metrics
    assert (m["backed_up"], m["failed"], m["pruned"], m["kept"]) == (27, 2, 27, 14)
    assert m["total_bytes"] == sum(10 + n for n in OLD - {20, 30})
    assert {20, 30} < set(ids(spark.read.parquet(result.kept_path)))


def copies_of(monkeypatch, change):
    """One copy that is not good and holds ``change(rows)``."""
    real = cycles.backup

    def altered(df, destinations, run_id, *args, **kwargs):
        outcomes = real(change(df), destinations, run_id, *args, **kwargs)
        return [o.__class__(**{**o.__dict__, "ok": False, "err": "differs"}) for o in outcomes]

    monkeypatch.setattr(cycles, "backup", altered)


def test_an_altered_copy_proves_nothing(spark, items, tmp_path, monkeypatch):
    copies_of(monkeypatch, lambda df: df.withColumn("text", F.concat("text", F.lit("!"))))
    with pytest.raises(plans.BackupFailed):
        plans.backup_then_prune(items, "ts", 240, AS_OF, f"{tmp_path}/kept", [f"{tmp_path}/a"], key="id")
    monkeypatch.undo()
    copies_of(monkeypatch, lambda df: df.withColumn("text", F.when(F.col("id") == 20, "other").otherwise(F.col("text"))))
    result = plans.backup_then_prune(items, "ts", 240, AS_OF, f"{tmp_path}/kept", [f"{tmp_path}/a"], key="id")
    assert (result.metrics["pruned"], result.metrics["failed"]) == (28, 1)
    assert 20 in ids(spark.read.parquet(result.kept_path))


def test_a_repeated_key_needs_as_many_copies(spark, items, tmp_path, monkeypatch):
    twice = items.unionByName(items.where("id in (20, 21)")).unionByName(items.where("id = 22").withColumn("text", F.lit("other")))
    copies_of(monkeypatch, lambda df: df.dropDuplicates(["id"]).where("id <> 22").unionByName(items.where("id in (21, 22)")))
    result = plans.backup_then_prune(twice, "ts", 240, AS_OF, f"{tmp_path}/kept", [f"{tmp_path}/a"], key="id")
    kept = Counter((r.id, r.text) for r in spark.read.parquet(result.kept_path).where("id between 20 and 22").collect())
    assert kept == {(20, "log line 20"): 2, (22, "other"): 1}


def test_names_of_archive_folders_are_refused(spark, items, tmp_path):
    for name in ("bucket", "Run_ID"):
        with pytest.raises(ValueError):
            plans.archive_table(items.withColumn(name, F.lit("mine")), "ts", [f"{tmp_path}/a"], "r1")
    with pytest.raises(ValueError):
        plans.backup(items.withColumn("run_id", F.lit(1)), [f"{tmp_path}/a"], "r1")


def test_fingerprints_tell_nulls_and_maps_apart(spark):
    from tierdown.plans.copying import fingerprint

    kind = "a string, b string, m map<string,int>, l array<string>"
    rows = [
        (None, "a", None, None), ("a", None, None, None), (None, None, {"k": 1}, None), (None, None, {"k": 2}, None),
        (None, None, None, [None, "a"]), (None, None, None, ["a", None]), (None, None, None, None),
    ]
    prints = {str(fingerprint(spark.createDataFrame([row], kind))) for row in rows}
    assert len(prints) == len(rows)


def test_overlap_is_seen_in_any_spelling(spark, items, tmp_path):
    from tierdown.plans.copying import refuse_overlap

    for source, target in (
        ("/a/b", "/a/b"), ("/a/b", "/a/c/../b/x"), ("/a//b/", "file:///a/b/x"), ("s3a://l/t", "s3://l/t/copy"), ("/a/b/c", "/a/b"),
    ):
        with pytest.raises(ValueError):
            refuse_overlap(source, [target])
    refuse_overlap("/a/b", ["/a/bc", "s3://a/b/c"])
    items.write.parquet(f"{tmp_path}/src")
    with pytest.raises(ValueError):
        plans.backup_then_prune(
            spark.read.parquet(f"{tmp_path}/src"), "ts", 240, AS_OF, f"{tmp_path}/kept", [f"{tmp_path}/src/../src/copy"], key="id"
        )


def test_default_run_ids_sort_by_time():
    made = [cycles.new_run_id() for _ in range(50)]
    assert [m[:21] for m in made] == sorted(m[:21] for m in made) and len(set(made)) == 50


def test_threshold_stops_before_the_prune(spark, items, tmp_path, monkeypatch):
    incomplete(monkeypatch, [20, 30])
    options = dict(destinations=[f"{tmp_path}/a"], key="id")
    with pytest.raises(plans.ThresholdExceeded) as stop:
        plans.backup_then_prune(
            items, "ts", 240, AS_OF, f"{tmp_path}/kept", error_threshold_percent=5.0, **options
        )
    assert "6.9%" in str(stop.value) and not Path(f"{tmp_path}/kept").exists()
    result = plans.backup_then_prune(
        items, "ts", 240, AS_OF, f"{tmp_path}/kept", error_threshold_percent=7.0, **options
    )
    assert result.metrics["pruned"] == 27


def test_prune_only(spark, items, tmp_path):
    result = plans.backup_then_prune(
        items, "ts", 240, AS_OF, f"{tmp_path}/kept", enable_backup=False
    )
    assert (result.metrics["backed_up"], result.metrics["pruned"]) == (0, 29)
    with pytest.raises(ValueError):
        plans.backup_then_prune(items, "ts", 240, AS_OF, f"{tmp_path}/k2")


def test_nothing_expired(spark, items, tmp_path):
    result = plans.backup_then_prune(
        items, "ts", 24000, AS_OF, f"{tmp_path}/kept", [f"{tmp_path}/a"], key="id"
    )
    assert (result.metrics["pruned"], result.metrics["kept"]) == (0, 41)


def test_dry_run_changes_nothing(spark, items, tmp_path):
    targets = [f"{tmp_path}/a", f"{tmp_path}/b"]
    for group_by in (None, "monthly"):
        plan = cycles.plan_cycle(items, "ts", 240, AS_OF, targets, "text", "size", group_by).collect()
        assert sum(r.planned_items for r in plan) == 2 * 29
        assert sum(r.planned_bytes for r in plan) == 2 * sum(10 + n for n in OLD)
    assert list(tmp_path.iterdir()) == []


def test_run_once_refuses_a_target_in_its_source(spark, items, tmp_path):
    source = f"{tmp_path}/src"
    items.write.parquet(source)
    for kept, target in ((f"{tmp_path}/k", source), (f"{tmp_path}/k", source + "/b"), (source, f"{tmp_path}/b")):
        with pytest.raises(ValueError):
            plans.run_once(spark, source, kept, "ts", 240, AS_OF, destinations=[target])
    result = plans.run_once(
        spark, source, f"{tmp_path}/src-kept", "ts", 240, AS_OF, destinations=[f"{tmp_path}/b"]
    )
    assert result.metrics["pruned"] == 29


def test_a_json_policy_is_all_a_run_needs(spark, items, tmp_path):
    source, policy = f"{tmp_path}/src", tmp_path / "policy.json"
    items.write.parquet(source)
    text = {
        "prune_after_hours": 240, "target_folder": source, "run_interval": 3600,
        "backup_path": f"{tmp_path}/a", "backup_paths": [f"{tmp_path}/b", f"{tmp_path}/a"],
        "remote_backup": "", "enable_backup": True, "unknown_key": 1,
        "archive": {"enabled": True, "format": "", "group_by": "Monthly"},
    }
    policy.write_text(json.dumps(text, indent=2))
    policies = read_policies(spark, str(policy))
    (result,) = plans.run_policies(policies, "ts", AS_OF, f"{tmp_path}/kept")
    assert (result.metrics["copies"], result.metrics["pruned"]) == (2, 29)
    for target in "ab":
        months = {r.bucket for r in plans.open_archive(spark, f"{tmp_path}/{target}").collect()}
        assert months == {"2023-12", "2024-01"}
    sizes = plans.stored_sizes(spark, result.copies).collect()
    assert len(sizes) == 2 and all(r.files > 0 and r.stored_bytes > 0 for r in sizes)
    policy.write_text(json.dumps({**text, "prune_after_hours": -1}))
    with pytest.raises(plans.PolicyError, match="prune_after_hours"):
        plans.run_policies(read_policies(spark, str(policy)), "ts", AS_OF, f"{tmp_path}/kept")


def test_a_hot_bucket_is_spread_over_many_tasks(spark, tmp_path):
    """One bucket holds two thirds of the rows; buckets that hash elsewhere get one file."""
    hot = F.col("id") % 3 < 2
    day = F.when(hot, 5).otherwise(F.col("id") % 300 / 10).cast("int")
    rows = spark.range(0, 60_000, 1, 16).select(
        "id", F.expr("TIMESTAMP_NTZ '2024-01-01'") + F.make_dt_interval(day), F.sha2(F.col("id").cast("string"), 512).alias("pad")
    ).toDF("id", "ts", "pad")
    setting = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "500k")
    try:
        (outcome,) = plans.archive_table(rows, "ts", [f"{tmp_path}/v"], "r1")
    finally:
        spark.conf.set(setting, before)
    assert outcome.ok
    sizes = {r.bucket: r.files for r in plans.archive_sizes(plans.open_archive(spark, f"{tmp_path}/v")).collect()}
    assert sizes.pop("2024-01-06") >= 8
    assert sorted(sizes.values())[len(sizes) // 2] == 1


def test_restored_keys_may_not_leave_the_folder(spark, tmp_path):
    rows = [("a/b.log", AS_OF), ("../evil", AS_OF), ("/etc/passwd", AS_OF)]
    df = spark.createDataFrame(rows, "rel_path STRING, ts TIMESTAMP_NTZ")
    plans.archive_table(df, "ts", [f"{tmp_path}/v"], "r1")
    safe, errors = plans.restore_objects(spark, f"{tmp_path}/v")
    assert [r.rel_path for r in safe.collect()] == ["a/b.log"]
    assert sorted(r.key for r in errors.collect()) == ["../evil", "/etc/passwd"]


def test_compact_copies(spark, items, tmp_path):
    scattered = items.repartition(20)
    for compact, most in ((False, 20), (True, 1)):
        (o,) = plans.backup(scattered, [f"{tmp_path}/{compact}"], "r1", compact=compact)
        assert o.ok and len(list(Path(o.path).glob("*.parquet"))) <= most


def test_a_cancelled_run_changes_nothing(spark, items, tmp_path):
    options = dict(destinations=[f"{tmp_path}/a"], key="id")
    with pytest.raises(plans.RunCancelled, match="backup"):
        plans.backup_then_prune(
            items, "ts", 240, AS_OF, f"{tmp_path}/kept", should_stop=lambda: True, **options
        )
    assert list(tmp_path.iterdir()) == []
    answers = iter([False, True])
    with pytest.raises(plans.RunCancelled, match="prune"):
        plans.backup_then_prune(
            items, "ts", 240, AS_OF, f"{tmp_path}/kept", should_stop=lambda: next(answers), **options
        )
    assert not Path(f"{tmp_path}/kept").exists()


def test_restoring_undoes_a_run(spark, items, tmp_path):
    result = plans.backup_then_prune(
        items, "ts", 240, AS_OF, f"{tmp_path}/kept", [f"{tmp_path}/a"], key="id", group_by="daily"
    )
    restored = plans.restore(spark, f"{tmp_path}/a", "id")
    whole = restore_over(spark.read.parquet(result.kept_path), restored, "id")
    assert whole.count() == 41 and whole.exceptAll(items).count() == 0


def test_history_of_runs(spark, items, tmp_path, blocked):
    for n, run in enumerate(("r1", "r2", "r2")):
        result = plans.backup_then_prune(
            items, "ts", 240, AS_OF, f"{tmp_path}/kept-{n}", [blocked, f"{tmp_path}/a"],
            key="id", size="size", run_id=run,
        )
        plans.record_run(spark, result, f"{tmp_path}/history")
    runs = spark.read.parquet(f"{tmp_path}/history/run_metrics")
    merged = merge_results(runs.withColumn("archive_path", F.lit(""))).first()
    assert (merged.pruned, merged.skipped) == (2 * 29, 2 * 12)
    copies = spark.read.parquet(f"{tmp_path}/history/copies")
    assert copies.where("ok").count() == 2 and copies.where("not ok and err is not null").count() == 2


# ---- objects of any size -----------------------------------------------------------------


@pytest.fixture
def tree(tmp_path):
    """Hidden names, odd names, an empty file, a large one, a young one, a link in a circle."""
    root = tmp_path / "tree"
    contents = {
        ".x/_y/z.bin": os.urandom(10_000),
        "_hidden": b"hidden",
        ".dot": b"dot",
        "a b/100%/é=1.log": b"odd name",
        "empty": b"",
        "exact": os.urandom(2048),
        "big": os.urandom(1_500_000),
        "young": b"young",
    }
    for name, data in contents.items():
        file = root / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(data)
        stamp = time.time() - (1 if name == "young" else 48) * 3600
        os.utime(file, (stamp, stamp))
    (root / "no files" / "here").mkdir(parents=True)
    (root / "a b" / "up").symlink_to(root)
    return str(root), contents


def test_a_walk_takes_every_name(spark, tree):
    from tierdown.sources import walk_objects

    root, contents = tree
    for spelling in (root, root + "/", "file:" + root, "file://" + root):
        files, errors = walk_objects(spark, spelling)
        assert {r.rel_path: r["size"] for r in files.collect()} == {k: len(d) for k, d in contents.items()}
        assert [(r.key, r.err) for r in errors.collect()] == [("a b/up", "a link to a folder is not followed")]
    stamps = {r.rel_path: r.us for r in files.select("rel_path", F.unix_micros("mtime").alias("us")).collect()}
    assert stamps == {k: os.stat(f"{root}/{k}").st_mtime_ns // 1000 for k in contents}
    files, errors = walk_objects(spark, root + "/not there")
    assert files.count() == 0 and [(r.key, r.operation) for r in errors.collect()] == [("", "access")]


def _files(root):
    return {str(p.relative_to(root)): p.read_bytes() for p in Path(root).rglob("*") if p.is_file()}


@pytest.mark.parametrize("format", ["tar", "tar.gz"])
def test_objects_go_through_chunks(spark, tree, tmp_path, blocked, format):
    root, contents = tree
    options = dict(hours=24, as_of=utc_now(), chunk_bytes=1024, format=format)
    destinations = [blocked, f"{tmp_path}/v", f"{tmp_path}/w"]
    outcomes, errors = plans.archive_chunks(spark, root, destinations, "r1", **options)
    old = {k: d for k, d in contents.items() if k != "young"}
    assert [o.ok for o in outcomes] == [False, True, True]
    assert outcomes[1].bytes == outcomes[2].bytes == sum(map(len, old.values()))
    assert outcomes[1].items == sum(max(1, -(-len(d) // 1024)) for d in old.values())
    assert [r.key for r in errors.collect()] == ["a b/up"]

    def digest(data):
        return plans.composed_digest([hashlib.sha256(data[n : n + 1024]).hexdigest() for n in range(0, max(1, len(data)), 1024)])

    manifest = plans.open_manifest(spark, f"{tmp_path}/w").collect()
    assert {r.rel_path: (r.digest, r.whole) for r in manifest} == {k: (digest(d), True) for k, d in old.items()}
    written, failed = plans.restore_chunks(spark, f"{tmp_path}/w", f"{tmp_path}/back")
    assert {r.rel_path: r.digest for r in written.collect()} == {k: digest(d) for k, d in old.items()}
    assert failed.count() == 0 and _files(f"{tmp_path}/back") == old
    with pytest.raises(ValueError):
        plans.archive_chunks(spark, root, [root + "/v"], "r1", **options)


def test_the_newest_whole_copy_is_put_back(spark, tree, tmp_path, monkeypatch):
    root, contents = tree
    vault, options = f"{tmp_path}/v", dict(hours=24, as_of=utc_now(), chunk_bytes=1024)
    plans.archive_chunks(spark, root, [vault], "r1", **options)
    stamp = time.time() - 48 * 3600
    for name in ("exact", "big"):
        Path(root, name).write_bytes(contents[name][::-1])
        os.utime(Path(root, name), (stamp, stamp))
    # the second run lists the large object, but cannot read all of it
    from tierdown.plans import objects

    listed = objects.walk_objects

    def shrinks(spark, path):
        found = listed(spark, path)
        Path(root, "big").write_bytes(b"cut" * 5000)
        return found

    monkeypatch.setattr(objects, "walk_objects", shrinks)
    _, errors = plans.archive_chunks(spark, root, [vault], "r2", **options)
    assert "big" in [r.key for r in errors.collect()]
    assert {r.run_id: r.whole for r in plans.open_manifest(spark, vault).where("rel_path = 'big'").collect()} == {"r1": True, "r2": False}
    plans.restore_chunks(spark, vault, f"{tmp_path}/back")
    back = _files(f"{tmp_path}/back")
    assert back["big"] == contents["big"] and back["exact"] == contents["exact"][::-1]
    plans.restore_chunks(spark, vault, f"{tmp_path}/first", as_of_run="r1")
    assert _files(f"{tmp_path}/first")["exact"] == contents["exact"]


def test_altered_chunks_are_not_put_back(spark, tree, tmp_path):
    root, contents = tree
    plans.archive_chunks(spark, root, [f"{tmp_path}/v"], "r1", 24, utc_now(), chunk_bytes=1024)
    held = spark.read.parquet(f"{tmp_path}/v/chunks/run_id=r1")
    hit = (F.col("rel_path") == "big") & (F.col("chunk") == 7)
    other = held.withColumn("content", F.when(hit, F.reverse(F.hex("content")).cast("binary")).otherwise(F.col("content")))
    other.write.partitionBy("bucket").parquet(f"{tmp_path}/x/chunks/run_id=r1")
    spark.read.parquet(f"{tmp_path}/v/manifest/run_id=r1").write.parquet(f"{tmp_path}/x/manifest/run_id=r1")
    _, failed = plans.restore_chunks(spark, f"{tmp_path}/x", f"{tmp_path}/back")
    assert [(r.key, r.err) for r in failed.collect()] == [("big", "chunk 7 differs from its digest")]
    back = _files(f"{tmp_path}/back")
    assert "big" not in back and len(back) == len(contents) - 2 and not [k for k in back if k.endswith(".part")]


def test_no_objects(spark, tmp_path):
    (tmp_path / "in").mkdir()
    outcomes, errors = plans.archive_chunks(spark, f"{tmp_path}/in", [f"{tmp_path}/v"], "r1", 24, utc_now())
    assert outcomes[0].ok and outcomes[0].items == 0 and errors.count() == 0


# ---- restoring a few keys ----------------------------------------------------------------


@pytest.fixture
def indexed(spark, tmp_path):
    """Keys scattered over the files, so that ranges alone exclude none of them."""
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 500 != 3, F.concat(F.lit("k"), F.md5(F.col("id").cast("string")))).alias("k"),
        F.col("id").alias("v"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 40 * 86_400).cast("timestamp_ntz").alias("ts"),
    )
    plans.archive_table(rows, "ts", [f"{tmp_path}/v"], "r1")
    plans.index_keys(spark, f"{tmp_path}/v", "k", "r1")
    return rows, f"{tmp_path}/v"


def test_only_files_that_can_hold_a_key_are_opened(spark, indexed):
    rows, vault = indexed
    wanted = rows.where("v IN (7, 47, 9000)").select("k").unionByName(spark.sql("SELECT * FROM VALUES ('kx'), (NULL), ('kx') AS t(k)"))
    everything = plans.open_archive(spark, vault).inputFiles()
    opened = plans.files_for_keys(spark, vault, "k", wanted).collect()
    assert len(everything) >= 40 and 2 <= len(opened) <= 3
    back = plans.restore_keys(spark, vault, "k", wanted)
    assert sorted(r.v for r in back.collect()) == [7, 47, 9000]
    assert len(back.inputFiles()) == len(opened)
    assert back.columns == plans.restore(spark, vault, "k").columns


def test_no_key_is_lost(spark, indexed):
    rows, vault = indexed
    # the whole table is wanted: too many keys for literals
    back = plans.restore_keys(spark, vault, "k", rows.select("k"))
    whole = plans.restore(spark, vault, "k").where("k IS NOT NULL")
    assert back.count() == whole.count() == 19_960 and back.exceptAll(whole).count() == 0
    assert plans.restore_keys(spark, vault, "k", spark.sql("SELECT 'none of them' AS k")).count() == 0
    assert plans.restore_keys(spark, vault, "k", rows.limit(0).select("k")).count() == 0


def test_runs_without_an_index_are_opened(spark, indexed):
    rows, vault = indexed
    again = rows.where("v < 100").withColumn("v", -F.col("v"))
    plans.archive_table(again, "ts", [vault], "r2")
    wanted = rows.where("v IN (7, 9000)").select("k")
    assert sorted((r.v, r.run_id) for r in plans.restore_keys(spark, vault, "k", wanted).collect()) == [(-7, "r2"), (9000, "r1")]
    assert sorted(r.v for r in plans.restore_keys(spark, vault, "k", wanted, as_of_run="r1").collect()) == [7, 9000]
    # the first run is written again, with other rows, and its index is of files that are gone
    plans.archive_table(rows.withColumn("v", F.col("v") + 1), "ts", [vault], "r1")
    assert sorted(r.v for r in plans.restore_keys(spark, vault, "k", wanted, as_of_run="r1").collect()) == [8, 9001]


def test_keys_without_any_index(spark, items, tmp_path):
    plans.archive_table(items, "ts", [f"{tmp_path}/v"], "r1")
    assert ids(plans.restore_keys(spark, f"{tmp_path}/v", "id", spark.sql("SELECT 5 AS id"))) == [5]


# ---- mending a copy ----------------------------------------------------------------------


@pytest.fixture(params=[True, False], ids=["containers", "plain"])
def copies(request, spark, tmp_path):
    """Two equal copies with nulls and repeated rows, and the rows they hold."""
    rows = spark.range(4000).select(
        F.when(F.col("id") % 50 != 0, F.col("id") % 1900).alias("id"),
        F.when(F.col("id") % 7 != 0, F.concat(F.lit("text "), F.col("id") % 1900)).alias("text"),
        (F.lit(AS_OF) - F.make_interval(days=F.col("id") % 10)).cast("timestamp_ntz").alias("ts"),
    )
    if request.param:
        plans.archive_table(rows, "ts", [f"{tmp_path}/a", f"{tmp_path}/b"], "r1")
    else:
        plans.backup(rows.repartition(8, "id"), [f"{tmp_path}/a", f"{tmp_path}/b"], "r1")
    return rows, f"{tmp_path}/a/run_id=r1", f"{tmp_path}/b/run_id=r1"


def _stamps(path):
    return {str(p): (p.stat().st_mtime_ns, p.stat().st_size) for p in Path(path).rglob("*.parquet")}


def _holds(spark, path, rows):
    held = spark.read.parquet(path).select("id", "text", "ts")
    return held.count() == rows.count() and held.exceptAll(rows).count() == 0


def test_an_equal_copy_is_left_alone(spark, copies):
    rows, good, bad = copies
    before = _stamps(bad)
    done = plans.repair_copy(spark, good, bad, rows.schema)
    assert (done.differing, done.added, done.dropped) == (0, 0, 0) and _stamps(bad) == before


def test_only_what_differs_is_mended(spark, copies):
    rows, good, bad = copies
    ranges = plans.record_tree(spark, good, rows.schema)
    one, other = sorted(_stamps(bad))[:2]
    held = spark.read.parquet(one)
    altered = held.withColumn("text", F.when(F.col("id") == held.where("id is not null").first().id, "altered").otherwise(F.col("text")))
    altered.unionByName(altered.limit(3)).coalesce(1).write.parquet(f"{bad}-other")
    (written,) = Path(f"{bad}-other").glob("*.parquet")
    Path(one).write_bytes(written.read_bytes())
    Path(one).with_name(f".{Path(one).name}.crc").unlink(missing_ok=True)
    Path(other).unlink()
    before = _stamps(bad)
    spark.catalog.refreshByPath(bad)
    done = plans.repair_copy(spark, good, bad, rows.schema)
    assert 0 < done.differing and ranges == done.ranges
    assert [Path(f).name for f in done.rewritten] == [Path(one).name] and done.unreadable == ()
    after = _stamps(bad)
    assert all(after[f] == before[f] for f in before if f != one) and one not in after
    assert _holds(spark, bad, rows)
    assert plans.repair_copy(spark, good, bad, rows.schema).differing == 0


def test_files_that_cannot_be_read_are_replaced(spark, copies):
    rows, good, bad = copies
    one, other = sorted(_stamps(bad))[:2]
    for file, content in ((one, b"no parquet at all"), (other, Path(other).read_bytes()[:-30])):
        Path(file).write_bytes(content)
        Path(file).with_name(f".{Path(file).name}.crc").unlink(missing_ok=True)
    done = plans.repair_copy(spark, good, bad, rows.schema)
    assert len(done.unreadable) == 2 and done.added > 0 and done.dropped == 0
    assert one not in _stamps(bad) and _holds(spark, bad, rows)


def test_a_repair_cut_off_before_the_removal_is_mended(spark, copies, monkeypatch):
    rows, good, bad = copies
    spark.read.parquet(sorted(_stamps(bad))[0]).withColumn("text", F.lit("new")).coalesce(1).write.parquet(f"{bad}-other")
    (written,) = Path(f"{bad}-other").glob("*.parquet")
    file = Path(sorted(_stamps(bad))[0])
    file.write_bytes(written.read_bytes())
    file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
    from tierdown.plans import repair

    def stops(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patched:
        patched.setattr(repair.folders, "remove", stops)
        with pytest.raises(KeyboardInterrupt):
            plans.repair_copy(spark, good, bad, rows.schema)
    spark.catalog.refreshByPath(bad)
    assert spark.read.parquet(bad).count() > rows.count()
    plans.repair_copy(spark, good, bad, rows.schema)
    assert _holds(spark, bad, rows)


def test_only_archived_objects_are_removed(spark, tree, tmp_path):
    root, contents = tree
    vault, now = f"{tmp_path}/v", utc_now()
    with pytest.raises(ValueError):
        plans.prune_objects(spark, root, [], 24, now)
    plans.archive_chunks(spark, root, [vault], "r1", 24, now, chunk_bytes=1024)
    stamp = time.time() - 30 * 3600
    for name, data in (("late", b"not archived"), ("exact", b"x" * 2048)):
        Path(root, name).write_bytes(data)
        os.utime(Path(root, name), (stamp, stamp))
    removed, unproven, errors = plans.prune_objects(spark, root, [vault], 24, now)
    assert {r.rel_path: r["size"] for r in removed.collect()} == {k: len(d) for k, d in contents.items() if k not in ("young", "exact")}
    assert set(_files(root)) == {"young", "late", "exact"} and errors.count() == 0
    assert plans.prune_objects(spark, root, [vault], 24, now)[0].count() == 0
    assert sorted(r.rel_path for r in unproven.collect()) == ["exact", "late"]
