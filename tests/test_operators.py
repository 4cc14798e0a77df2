import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tierdown import operators as op
from tierdown.operators import joins
from tierdown.sources import POLICY_SCHEMA

AS_OF = datetime(2024, 1, 3)


# ---- joins ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key, some have none."""
    chance = random.Random(3)
    rows = [("hot", n) for n in range(1000)]
    rows += [(f"k{chance.randint(0, 900)}", n) for n in range(1000, 2800)]
    rows += [(None, n) for n in range(2800, 3000)]
    return rows, spark.createDataFrame(rows, "k STRING, n INT")


@pytest.mark.parametrize("how", joins.HOWS)
@pytest.mark.parametrize("with_hot", [True, False])
def test_skew_safe_join_equals_the_plain_join(spark, skewed, how, with_hot):
    rows, left = skewed
    keys = [f"k{n}" for n in range(0, 900, 2)] + (["hot"] if with_hot else [])
    right = spark.createDataFrame([(k, len(k)) for k in keys], "k STRING, w INT")
    assert joins.frequent_keys(left, "k", 0.01) == ["hot", None]
    found = op.skew_safe_join(left, right, "k", how, support=0.01)
    plain = left.join(right, "k", how)
    assert found.columns == plain.columns
    assert Counter(map(tuple, found.collect())) == Counter(map(tuple, plain.collect()))


def test_many_rows_without_a_key(spark):
    left = spark.range(1000).select(F.when(F.col("id") < 400, F.col("id")).alias("k"))
    right = spark.range(0, 1000, 2).select(F.col("id").alias("k"))
    assert joins.frequent_keys(left, "k", 0.01) == [None]
    counts = {how: op.skew_safe_join(left, right, "k", how).count() for how in joins.HOWS}
    assert counts == {"inner": 200, "left": 1000, "left_semi": 200, "left_anti": 800}


def test_hot_keys_do_not_enter_the_shuffle(spark, skewed):
    _, left = skewed
    right = spark.createDataFrame([("hot",), ("k1",)], "k STRING")
    plan = op.skew_safe_join(left, right, "k", "left_semi")._jdf.queryExecution().optimizedPlan()
    assert "Union" in plan.toString()


def test_frequent_keys_is_empty_for_unique_keys(spark):
    assert joins.frequent_keys(spark.range(10_000), "id") == []


def test_lookup_join_beyond_the_broadcast_bound(spark, skewed):
    _, left = skewed
    right = spark.createDataFrame([(f"k{n}", n) for n in range(500)] + [("hot", -1)], "k STRING, w INT")
    small = joins.lookup_join(left, right, "k", "left", max_broadcast_rows=1000)
    large = joins.lookup_join(left, right, "k", "left", max_broadcast_rows=10)
    assert Counter(map(tuple, small.collect())) == Counter(map(tuple, large.collect()))


# ---- linking -------------------------------------------------------------------------


def test_prune_safe_and_unbacked_split_the_expired_rows(spark, skewed):
    rows, left = skewed
    held = spark.createDataFrame([("hot",)] * 5 + [(f"k{n}",) for n in range(300)] + [(None,)], "k STRING")
    names = {"hot", *(f"k{n}" for n in range(300))}
    safe = sorted(r.n for r in op.prune_safe(left, held, "k").collect())
    kept = sorted(r.n for r in op.unbacked(left, held, "k").collect())
    assert safe == sorted(n for k, n in rows if k in names)
    assert kept == sorted(n for k, n in rows if k not in names)


def test_overlap_guard_respects_folder_borders(spark):
    sources = spark.createDataFrame([("/data/a",), ("/data/a/",), ("/logs",)], "source STRING")
    targets = spark.createDataFrame(
        [("/data/a",), ("/data/a/backup/",), ("/data/ab",), ("/backup",), ("/logs/",), ("/data",)],
        "destination STRING",
    )
    found = {tuple(r) for r in op.overlap_guard(sources, targets).collect()}
    assert found == {("/data/a", "/data/a"), ("/data/a", "/data/a/backup/"), ("/logs", "/logs/")}


# ---- policies ------------------------------------------------------------------------


def test_policies_by_class_with_fractions(spark):
    rows = [
        ("a", AS_OF - timedelta(minutes=31)),
        ("a", AS_OF - timedelta(minutes=30)),
        ("b", AS_OF - timedelta(hours=100)),
        ("c", AS_OF - timedelta(hours=100)),
        (None, AS_OF - timedelta(hours=100)),
        ("a", None),
    ]
    df = spark.createDataFrame(rows, "c STRING, t TIMESTAMP_NTZ")
    policies = spark.createDataFrame([("a", 0.5), ("b", 200.0)], "c STRING, prune_after_hours DOUBLE")
    judged = op.apply_policies(df, policies, "c", "t", AS_OF)
    flags = Counter((r.c, r.expired) for r in judged.collect())
    assert flags == Counter({("a", True): 1, ("a", False): 2, ("b", False): 1, ("c", False): 1, (None, False): 1})
    old = op.expired_by_policy(df, policies, "c", "t", AS_OF).collect()
    assert [(r.c, r.t) for r in old] == [rows[0]]
    assert old[0].asDict().keys() == {"c", "t"}


def test_policies_on_a_date_column(spark):
    df = spark.createDataFrame([("a", "2024-01-01"), ("a", "2024-01-02")], "c STRING, t STRING")
    df = df.withColumn("t", F.col("t").cast("date"))
    policies = spark.createDataFrame([("a", 24.0)], "c STRING, prune_after_hours DOUBLE")
    flags = [r.expired for r in op.apply_policies(df, policies, "c", "t", AS_OF).orderBy("t").collect()]
    assert flags == [True, False]


def test_of_two_policies_for_a_class_the_strictest_decides(spark):
    df = spark.createDataFrame([("a", AS_OF - timedelta(hours=30))], "c STRING, t TIMESTAMP_NTZ")
    policies = spark.createDataFrame([("a", 48.0), ("a", 24.0)], "c STRING, prune_after_hours DOUBLE")
    judged = op.apply_policies(df, policies, "c", "t", AS_OF).collect()
    assert [r.expired for r in judged] == [True]
    assert op.expired_by_policy(df, policies, "c", "t", AS_OF).count() == 1


def test_no_policy_means_nothing_expires(spark):
    df = spark.createDataFrame([("a", AS_OF)], "c STRING, t TIMESTAMP_NTZ")
    none = spark.createDataFrame([], "c STRING, prune_after_hours DOUBLE")
    assert op.expired_by_policy(df, none, "c", "t", AS_OF + timedelta(days=9)).count() == 0


GOOD = {
    "prune_after_hours": 24.0, "target_folder": "/data", "run_interval": 3600,
    "backup_path": "/backup", "enable_backup": True,
}
LINT = [
    ({}, None),
    ({"prune_after_hours": 0.5}, None),
    ({"prune_after_hours": 0.0}, "prune_after_hours"),
    ({"prune_after_hours": -1.0}, "prune_after_hours"),
    ({"prune_after_hours": None}, "prune_after_hours"),
    ({"run_interval": 1}, None),
    ({"run_interval": 0}, "run_interval"),
    ({"run_interval": -1}, "run_interval"),
    ({"target_folder": ""}, "target_folder"),
    ({"backup_path": ""}, "destination"),
    ({"backup_path": "", "enable_backup": False}, None),
    ({"backup_path": "", "backup_paths": ["", "/b"]}, None),
    ({"remote_backup": "user@host.example.com:/backup"}, None),
    ({"remote_backup": "host.example.com:/backup"}, None),
    ({"remote_backup": "user_name@host-name.example.com:/path/to/backup"}, None),
    ({"remote_backup": ""}, None),
    ({"remote_backup": "user@host/path"}, "remote"),
    ({"remote_backup": "user@host:"}, "remote"),
    ({"remote_backup": "/local/path"}, "remote"),
    ({"remote_backups": ["", "host:/a", "bad"]}, "remote"),
    ({"error_threshold_percent": 100.0}, None),
    ({"error_threshold_percent": 100.5}, "error_threshold_percent"),
    ({"error_threshold_percent": -1.0}, "error_threshold_percent"),
    ({"compression": (False, "unknown", 99)}, None),
    ({"compression": (True, "gzip", -1)}, None),
    ({"compression": (True, "GZIP", 1)}, None),
    ({"compression": (True, "", 0)}, None),
    ({"compression": (True, "gzip", 9)}, None),
    ({"compression": (True, "none", 0)}, None),
    ({"compression": (True, "gzip", 10)}, "level"),
    ({"compression": (True, "unknown", 1)}, "algorithm"),
    ({"archive": (True, "tar.gz", "daily")}, None),
    ({"archive": (True, "TAR", "Weekly")}, None),
    ({"archive": (True, "zip", "monthly")}, None),
    ({"archive": (True, "", "")}, None),
    ({"archive": (True, "rar", "daily")}, "format"),
    ({"archive": (True, "tar.gz", "yearly")}, "grouping"),
    ({"archive": (True, "zip", "daily"), "compression": (True, "gzip", 6)}, "exclude"),
]


def test_policy_rules(spark):
    rows = []
    for change, _ in LINT:
        values = {**GOOD, **change}
        rows.append(tuple(values.get(name) for name in POLICY_SCHEMA.names))
    df = spark.createDataFrame(rows, POLICY_SCHEMA).coalesce(1)
    linted = op.policy_lint(df).select("violations").collect()
    for (change, word), row in zip(LINT, linted):
        if word is None:
            assert row.violations == [], change
        else:
            assert len(row.violations) == 1 and word in row.violations[0], (change, row.violations)


def test_violations_come_in_rule_order_and_defaults_are_filled(spark):
    row = tuple({**GOOD, "prune_after_hours": 0.0, "run_interval": 0, "target_folder": None}.get(n) for n in POLICY_SCHEMA.names)
    linted = op.policy_lint(spark.createDataFrame([row], POLICY_SCHEMA)).first()
    assert [v.split()[0] for v in linted.violations] == ["prune_after_hours", "run_interval", "target_folder"]
    assert tuple(linted.compression) == (False, "gzip", 6)
    assert tuple(linted.archive) == (False, "tar.gz", "daily")
    assert linted.destinations == ["/backup"]


# ---- accounting ----------------------------------------------------------------------

OUTCOMES = "run_id STRING, phase STRING, key STRING, ok BOOLEAN, operation STRING, err STRING, bytes BIGINT"


def test_run_summary_counts_phases_and_items(spark):
    rows = [
        ("r", "backup", "a", True, "backup", None, 10),
        ("r", "backup", "b", False, "backup", "full", 20),
        ("r", "prune", "a", True, "prune", None, 10),
        ("r", "prune", "b", False, "prune", "locked", 20),
        ("r", "skip", "c", True, "skip", None, 30),
    ]
    outcomes = spark.createDataFrame(rows, OUTCOMES)
    s = op.run_summary(outcomes).first()
    assert (s.succeeded, s.failed, s.skipped, s.backed_up, s.pruned, s.total_bytes) == (1, 2, 1, 1, 1, 10)
    assert s.failed_items == 1 and round(s.failure_rate, 3) == 66.667
    report = {r.message for r in op.error_report(outcomes).collect()}
    assert report == {"backup failed for b: full", "prune failed for b: locked"}
    assert {tuple(r) for r in op.error_counts(outcomes).collect()} == {("backup", 1), ("prune", 1)}


def test_run_summary_of_nothing(spark):
    s = op.run_summary(spark.createDataFrame([], OUTCOMES)).first()
    assert (s.succeeded, s.failed, s.total_bytes, s.failure_rate) == (0, 0, 0, 0.0)


def test_any_destination_is_enough(spark):
    rows = [("a", 0, False, "x0"), ("a", 1, True, None), ("b", 1, False, "x1"), ("b", 0, False, "x0")]
    df = spark.createDataFrame(rows, "key STRING, dest_order INT, ok BOOLEAN, err STRING")
    found = {tuple(r) for r in op.any_destination_ok(df).collect()}
    assert found == {("a", True, 1, None), ("b", False, 0, "x0")}


def test_gate(spark):
    rows = [(f"k{n}", n >= 1) for n in range(10)]
    df = spark.createDataFrame(rows, "key STRING, ok BOOLEAN")
    assert op.threshold_gate(df, 9.9).first().stop is True
    assert op.threshold_gate(df, 10.0).first().stop is False
    assert op.threshold_gate(df, 0.0).first().stop is False


def test_merge_keeps_the_first_path_and_adds_up(spark):
    rows = [("2", 1, 2, "p2"), ("1", 3, 4, ""), ("3", 5, 6, "p3"), ("0", 1, 1, None)]
    df = spark.createDataFrame(rows, "run_id STRING, succeeded BIGINT, pruned BIGINT, archive_path STRING")
    assert tuple(op.merge_results(df).first()) == (10, 13, "p2")


def test_merged_errors_are_in_order_of_runs(spark):
    rows = [(run, "backup", key, ok, "backup", "full", 1) for run in ("2", "1", None) for key, ok in (("b", False), ("a", False), ("c", True), ("d", None))]
    merged = op.merge_errors(spark.createDataFrame(rows, OUTCOMES).repartition(3)).orderBy("position").collect()
    assert [(r.position, r.run_id, r.path) for r in merged] == list(
        (n, run, key) for n, (run, key) in enumerate((run, key) for run in (None, "1", "2") for key in "abd")
    )
    assert merged[3].message == "backup failed for a: full"
    assert op.merge_errors(spark.createDataFrame([], OUTCOMES)).count() == 0


# ---- breaker -------------------------------------------------------------------------


def brute_force(rows, percent):
    """rows of (part, order, failed) -> running counts, and the rows a stopped run sees."""
    parts = {}
    for part, order, failed in rows:
        parts.setdefault(part, []).append((order, failed))
    running, seen = {}, set()
    for part, items in parts.items():
        ok = bad = 0
        stopped = False
        for order, failed in sorted(items, key=lambda i: (i[0] is not None, 0 if i[0] is None else i[0])):
            ok, bad = ok + (not failed), bad + failed
            running[part, order] = (ok, bad, bad / (ok + bad) * 100)
            if not stopped:
                seen.add((part, order))
            stopped = stopped or (failed and bad / (ok + bad) * 100 > percent)
    return running, seen


@pytest.mark.parametrize("slices", [1, 2, 7, 64])
def test_breaker_against_brute_force(spark, slices):
    chance = random.Random(slices)
    rows = [("hot", f"path/{n:05d}", chance.random() < 0.2) for n in range(700)]
    rows += [(f"p{chance.randint(0, 40)}", f"file{n}", chance.random() < 0.2) for n in range(1200)]
    rows += [(None, f"x{n}", chance.random() < 0.2) for n in range(300)]
    rows += [("hot", None, True)]
    # the first items of the hot part are fine, so that it trips late
    rows = [(p, o, f and not (p == "hot" and (o or "~") < "path/00040")) for p, o, f in rows]
    df = spark.createDataFrame(rows, "part STRING, o STRING, failed BOOLEAN").repartition(5)
    running, seen = brute_force(rows, 22.0)
    got = op.running_failure_rate(df, ["part"], ["o"], "failed", slices)
    assert got.columns[:3] == df.columns
    assert {(r.part, r.o): (r.running_succeeded, r.running_failed, r.running_rate) for r in got.collect()} == running
    kept = op.stop_at_breach(df, ["part"], ["o"], "failed", 22.0, slices).collect()
    assert {(r.part, r.o) for r in kept} == seen and len(kept) == len(seen)
    assert all(r.failed and r.running_rate > 22.0 for r in kept if r.tripped)


@pytest.mark.parametrize(("slices", "fanout"), [(40, 3), (40, 40), (2100, 16)])
def test_totals_go_up_in_levels(spark, slices, fanout):
    from tierdown.operators import scans

    chance = random.Random(slices)
    rows = [("a" if n % 9 else None, n, chance.randrange(1 << 40)) for n in range(2600)]
    df = spark.createDataFrame(rows, "p STRING, n INT, v BIGINT").repartition(3)
    cut = scans.sliced(df, ["p"], ["n"], slices)
    assert cut.select("_slice").distinct().count() > min(slices, 2048) * 0.9
    values = {"total": ("sum", F.col("v")), "most": ("max", F.col("v")), "mixed": ("xor", F.col("v"))}
    got = {(r.p, r.n): (r.total, r.most, r.mixed) for r in scans.running(cut, values, fanout).collect()}
    state, expected = {}, {}
    for p, n, v in rows:
        total, most, mixed = state.get(p, (0, 0, 0))
        state[p] = expected[p, n] = (total + v, max(most, v), mixed ^ v)
    assert got == expected


def test_only_the_slice_that_trips_is_opened(spark):
    from tierdown.operators import breaker, scans

    rows = [(n, n > 1500) for n in range(3000)]
    cut = scans.sliced(spark.createDataFrame(rows, "o INT, failed BOOLEAN"), [], ["o"], 30)
    found = breaker.slice_breaches(cut, "failed", 25.0, 4).collect()
    first = min(found, key=lambda r: r._slice)
    here = {r.o for r in cut.where(F.col("_slice") == first._slice).collect()}
    stop = next(n for n in range(3000) if n > 1500 and (n - 1500) / (n + 1) * 100 > 25)
    assert stop in here and first._n == min(here) and 0 < first._f < first._n
    kept = op.stop_at_breach(cut.select("o", "failed"), [], ["o"], "failed", 25.0, 30, 4)
    assert kept.count() == stop + 1 and [r.o for r in kept.where("tripped").collect()] == [stop]


def test_breaker_ordered_by_two_columns_with_ties(spark):
    chance = random.Random(9)
    rows = [("same" if n % 3 else f"d{n}", None if n == 7 else n, chance.random() < 0.3) for n in range(900)]
    ranked = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0))
    flat = [("p", place, failed) for place, (_, _, failed) in enumerate(ranked)]
    running, seen = brute_force(flat, 33.0)
    places = {(d, n): place for place, (d, n, _) in enumerate(ranked)}
    df = spark.createDataFrame([("p", *r) for r in rows], "part STRING, day STRING, n INT, failed BOOLEAN").repartition(6)
    got = op.running_failure_rate(df, ["part"], ["day", "n"], "failed", 16).collect()
    assert {("p", places[r.day, r.n]): (r.running_succeeded, r.running_failed, r.running_rate) for r in got} == running
    kept = op.stop_at_breach(df, ["part"], ["day", "n"], "failed", 33.0, 16).collect()
    assert {("p", places[r.day, r.n]) for r in kept} == seen


def test_breaker_over_one_run_and_switched_off(spark):
    chance = random.Random(1)
    rows = [(n, chance.random() < 0.3) for n in range(2000)]
    df = spark.createDataFrame(rows, "o INT, failed BOOLEAN").repartition(7)
    running, seen = brute_force([(None, o, f) for o, f in rows], 35.0)
    got = op.running_failure_rate(df, [], ["o"], "failed").collect()
    assert {(None, r.o): (r.running_succeeded, r.running_failed, r.running_rate) for r in got} == running
    kept = op.stop_at_breach(df, [], ["o"], "failed", 35.0).collect()
    assert {(None, r.o) for r in kept} == seen
    assert op.stop_at_breach(df, [], ["o"], "failed", 0.0).count() == len(rows)


def test_nothing_is_frequent_among_no_rows(spark):
    from tierdown.operators.joins import frequent_keys, skew_safe_join

    empty = spark.createDataFrame([], "k STRING, v INT")
    assert frequent_keys(empty, "k") == []
    assert skew_safe_join(empty, empty.select("k"), "k", "left").count() == 0
    assert op.running_failure_rate(empty.selectExpr("k", "v", "v > 1 AS failed"), ["k"], ["v"], "failed").count() == 0
    assert op.stop_at_breach(empty.selectExpr("v", "v > 1 AS failed"), [], ["v"], "failed", 5.0).count() == 0


# ---- restore -------------------------------------------------------------------------


def test_latest_copies(spark):
    rows = [("hot", "1", n) for n in range(300)] + [("hot", "2", n) for n in range(200)]
    rows += [(f"k{n}", "1", n) for n in range(400)] + [(f"k{n}", "2", -n) for n in range(0, 400, 3)]
    rows += [(None, "1", 1), (None, "2", 2)]
    df = spark.createDataFrame(rows, "k STRING, run_id STRING, v INT")
    newest = {}
    for k, run, _ in rows:
        newest[k] = max(newest.get(k, ""), run)
    expected = Counter(r for r in rows if r[0] is None or r[1] == newest[r[0]])
    assert Counter(map(tuple, op.latest_copies(df, "k").collect())) == expected
    one = df.where("run_id = '1'")
    assert op.latest_copies(one, "k").count() == one.count()


def test_unsafe_keys_become_errors(spark):
    keys = ["a/b", "..a/b", "../x", "a/../../x", "/etc/passwd", "a/..", "c:\\..\\x", None, "a..b"]
    df = spark.createDataFrame([(k,) for k in keys], "k STRING")
    safe, errors = op.split_unsafe_keys(df, "k")
    assert {r.k for r in safe.collect()} == {"a/b", "..a/b", "a..b"}
    assert errors.count() == 6
