"""Run results: counters, rates, gates and errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierdown.catalog.registry import (
    EVENTS_AS_OF,
    EVENTS_CUTOFF,
    HOURS,
    ORDERS_CUTOFF,
    query,
    table,
)
from tierdown.catalog.selection import old_orders
from tierdown.functions import (
    archive_bucket,
    archive_name,
    prune_summary_line,
    summary_line,
)
from tierdown.operators import (
    any_destination_ok,
    archive_stats,
    classify,
    compression_stats,
    error_counts,
    error_report,
    merge_errors,
    merge_results,
    phase_rates,
    run_summary,
    running_failure_rate,
    stop_at_breach,
    threshold_gate,
    union_outcomes,
)


def event_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table read as the outcome rows of daily runs."""
    judged = classify(table(spark, sf_dir, "events"), "ts", HOURS, EVENTS_AS_OF)
    phase = (
        F.when(~F.col("expired"), "skip")
        .when(F.col("event_type") == "signup", "prune")
        .when((F.col("event_type") == "error") & (F.col("value") < 5), "prune")
        .otherwise("backup")
    )
    failed = F.col("event_type") == "error"
    return judged.select(
        archive_bucket("ts", "daily").alias("run_id"),
        phase.alias("phase"),
        F.concat(F.lit("user-"), F.col("user_id"), F.lit("/"), F.col("event_id")).alias("key"),
        (~failed).alias("ok"),
        phase.alias("operation"),
        F.when(failed, F.concat(F.lit("cannot write "), F.col("props"))).alias("err"),
        F.octet_length("props").cast("bigint").alias("bytes"),
    )


EVENT_OUTCOMES_SQL = f"""
    outcomes AS (
        SELECT strftime(ts, '%Y-%m-%d') AS run_id,
               CASE WHEN NOT ts < {EVENTS_CUTOFF} THEN 'skip' WHEN event_type = 'signup' THEN 'prune'
                    WHEN event_type = 'error' AND value < 5 THEN 'prune' ELSE 'backup' END AS phase,
               'user-' || user_id || '/' || event_id AS key,
               event_type <> 'error' AS ok, phase AS operation,
               CASE WHEN event_type = 'error' THEN 'cannot write ' || props END AS err,
               strlen(props) AS bytes
        FROM events)
"""

_RATE_SQL = "CASE WHEN {s} + {f} = 0 THEN 0.0 ELSE CAST({f} AS DOUBLE) / ({s} + {f}) * 100 END"

_SUMMARY_SQL = """
    count(*) FILTER (phase = 'backup' AND ok) AS succeeded,
    count(*) FILTER (phase IN ('backup', 'prune') AND NOT ok) AS failed,
    count(*) FILTER (phase = 'skip') AS skipped,
    count(*) FILTER (phase = 'backup' AND ok) AS backed_up,
    count(*) FILTER (phase = 'prune' AND ok) AS pruned,
    CAST(coalesce(sum(bytes) FILTER (phase = 'backup' AND ok), 0) AS BIGINT) AS total_bytes,
    count(DISTINCT key) FILTER (phase IN ('backup', 'prune') AND NOT ok) AS failed_items
"""


@query(
    "run_summary",
    f"""
    WITH {EVENT_OUTCOMES_SQL}, s AS (SELECT {_SUMMARY_SQL} FROM outcomes)
    SELECT *, CAST({_RATE_SQL.format(s="succeeded", f="failed")} AS DOUBLE) AS failure_rate FROM s
    """,
)
def one_summary(spark, sf_dir):
    return run_summary(event_outcomes(spark, sf_dir))


@query(
    "run_summary_by_run",
    f"""
    WITH {EVENT_OUTCOMES_SQL}, s AS (SELECT run_id, {_SUMMARY_SQL} FROM outcomes GROUP BY run_id)
    SELECT *, CAST({_RATE_SQL.format(s="succeeded", f="failed")} AS DOUBLE) AS failure_rate FROM s
    """,
)
def summary_by_run(spark, sf_dir):
    return run_summary(event_outcomes(spark, sf_dir), ["run_id"])


@query(
    "failure_rate",
    f"""
    WITH {EVENT_OUTCOMES_SQL}, c AS (
        SELECT run_id, phase, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed
        FROM outcomes WHERE phase <> 'skip' GROUP BY ALL)
    SELECT *, CAST({_RATE_SQL.format(s="succeeded", f="failed")} AS DOUBLE) AS failure_rate FROM c
    """,
)
def rates_by_phase(spark, sf_dir):
    tried = event_outcomes(spark, sf_dir).where("phase <> 'skip'")
    return phase_rates(tried, ["run_id", "phase"])


@query(
    "compression_stats",
    """
    WITH s AS (
        SELECT source,
               CAST(sum(CASE WHEN source = 'src0' THEN 0 ELSE strlen(text) END) AS BIGINT)
                   AS original_bytes,
               CAST(sum(CASE WHEN source = 'src0' THEN 0 ELSE n_chars END) AS BIGINT)
                   AS compressed_bytes
        FROM documents GROUP BY source)
    SELECT *, CASE WHEN original_bytes = 0 THEN 100.0
                   ELSE CAST(compressed_bytes AS DOUBLE) / original_bytes * 100 END::DOUBLE
                   AS compression_ratio,
           100.0::DOUBLE - compression_ratio AS space_saved
    FROM s
    """,
)
def text_compression(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    empty = F.col("source") == "src0"
    original = F.when(empty, 0).otherwise(F.octet_length("text")).cast("bigint")
    compressed = F.when(empty, 0).otherwise(F.col("n_chars"))
    return compression_stats(docs, original, compressed, ["source"])


@query(
    "archive_stats",
    f"""
    SELECT strftime(o_orderdate, '%Y-%m') AS bucket, count(*) AS items,
           CAST(sum(strlen(o_orderpriority)) AS BIGINT) AS total_bytes
    FROM orders WHERE o_orderdate < {ORDERS_CUTOFF} GROUP BY 1
    """,
)
def order_containers(spark, sf_dir):
    items = old_orders(spark, sf_dir).select(
        archive_bucket("o_orderdate", "monthly").alias("bucket"),
        F.octet_length("o_orderpriority").alias("size"),
    )
    return archive_stats(items, "bucket", "size")


@query(
    "threshold_gate",
    f"""
    WITH {EVENT_OUTCOMES_SQL}, c AS (
        SELECT run_id, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed
        FROM outcomes WHERE phase = 'backup' GROUP BY run_id)
    SELECT *, CAST({_RATE_SQL.format(s="succeeded", f="failed")} AS DOUBLE) AS failure_rate,
           {_RATE_SQL.format(s="succeeded", f="failed")} > 20 AS stop FROM c
    """,
)
def daily_gate(spark, sf_dir):
    copies = event_outcomes(spark, sf_dir).where("phase = 'backup'")
    return threshold_gate(copies, 20.0, ["run_id"])


def order_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three copies of every expired order, failing by status and priority."""
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    urgent = priority.isin("1-URGENT", "2-HIGH")
    attempts = F.array(
        F.struct(F.lit(0).alias("dest_order"), (status != "F").alias("ok")),
        F.struct(F.lit(1).alias("dest_order"), (~urgent).alias("ok")),
        F.struct(F.lit(2).alias("dest_order"), (status == "O").alias("ok")),
    )
    orders = old_orders(spark, sf_dir).select(
        F.col("o_orderkey").alias("key"), F.explode(attempts).alias("a")
    )
    failed = ~F.col("a.ok")
    return orders.select(
        "key",
        "a.dest_order",
        "a.ok",
        F.when(failed, F.concat(F.lit("destination "), F.col("a.dest_order"), F.lit(" is full"))).alias("err"),
    )


ORDER_COPIES_SQL = f"""
    copies AS (
        SELECT o_orderkey AS key, d AS dest_order,
               CASE d WHEN 0 THEN o_orderstatus <> 'F'
                      WHEN 1 THEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH')
                      ELSE o_orderstatus = 'O' END AS ok,
               CASE WHEN NOT ok THEN 'destination ' || d || ' is full' END AS err
        FROM orders, (VALUES (0), (1), (2)) AS t(d) WHERE o_orderdate < {ORDERS_CUTOFF}),
    items AS (
        SELECT key, bool_or(ok) AS backed_up, count(*) FILTER (ok) AS copies,
               CASE WHEN NOT bool_or(ok) THEN arg_min(err, dest_order) FILTER (NOT ok) END AS err
        FROM copies GROUP BY key)
"""


@query("any_destination_ok", f"WITH {ORDER_COPIES_SQL} SELECT key, backed_up, copies, err FROM items")
def order_backups(spark, sf_dir):
    return any_destination_ok(order_copies(spark, sf_dir))


@query(
    "union_outcomes",
    f"""
    WITH {ORDER_COPIES_SQL}
    SELECT key, 'backup' AS phase, backed_up AS ok, err FROM items
    UNION ALL
    SELECT l_orderkey, 'prune', l_returnflag <> 'R',
           CASE WHEN l_returnflag = 'R' THEN 'held by a return' END
    FROM lineitem WHERE l_shipdate < {ORDERS_CUTOFF}
    """,
)
def both_phases(spark, sf_dir):
    backup = any_destination_ok(order_copies(spark, sf_dir)).select(
        "key", F.col("backed_up").alias("ok"), "err"
    )
    held = F.col("l_returnflag") == "R"
    lines = table(spark, sf_dir, "lineitem").where(
        F.col("l_shipdate") < F.lit("2000-01-01").cast("timestamp_ntz")
    )
    prune = lines.select(
        F.col("l_orderkey").alias("key"),
        (~held).alias("ok"),
        F.when(held, "held by a return").alias("err"),
    )
    merged = union_outcomes(("backup", backup), ("prune", prune))
    return merged.select("key", "phase", "ok", "err")


@query(
    "merge_results",
    f"""
    WITH {EVENT_OUTCOMES_SQL}, s AS (SELECT run_id, {_SUMMARY_SQL} FROM outcomes GROUP BY run_id),
    r AS (SELECT *, CASE WHEN backed_up > 150 THEN 'backup-' || run_id || '.tar.gz' ELSE '' END
              AS archive_path FROM s)
    SELECT CAST(sum(succeeded) AS BIGINT) AS succeeded, CAST(sum(failed) AS BIGINT) AS failed,
           CAST(sum(skipped) AS BIGINT) AS skipped, CAST(sum(backed_up) AS BIGINT) AS backed_up,
           CAST(sum(pruned) AS BIGINT) AS pruned, CAST(sum(total_bytes) AS BIGINT) AS total_bytes,
           arg_min(archive_path, run_id) FILTER (archive_path <> '') AS archive_path
    FROM r
    """,
)
def merged_runs(spark, sf_dir):
    runs = run_summary(event_outcomes(spark, sf_dir), ["run_id"])
    path = F.when(F.col("backed_up") > 150, archive_name("run_id")).otherwise("")
    return merge_results(runs.withColumn("archive_path", path))


@query(
    "error_report",
    f"""
    WITH {EVENT_OUTCOMES_SQL}
    SELECT key AS path, operation, err, operation || ' failed for ' || key || ': ' || err AS message
    FROM outcomes WHERE NOT ok
    """,
)
def errors(spark, sf_dir):
    return error_report(event_outcomes(spark, sf_dir))


@query(
    "merge_errors",
    f"""
    WITH {EVENT_OUTCOMES_SQL}
    SELECT key AS path, operation, err, operation || ' failed for ' || key || ': ' || err AS message, run_id,
           row_number() OVER (ORDER BY run_id NULLS FIRST, key NULLS FIRST) - 1 AS position
    FROM outcomes WHERE NOT ok
    """,
)
def merged_errors(spark, sf_dir):
    return merge_errors(event_outcomes(spark, sf_dir))


@query(
    "error_counts",
    f"""
    WITH {EVENT_OUTCOMES_SQL}
    SELECT operation, count(*) AS errors FROM outcomes WHERE NOT ok GROUP BY operation
    """,
)
def errors_by_operation(spark, sf_dir):
    return error_counts(event_outcomes(spark, sf_dir))


@query(
    "summary_line",
    f"""
    WITH {EVENT_OUTCOMES_SQL}, s AS (SELECT run_id, {_SUMMARY_SQL} FROM outcomes GROUP BY run_id)
    SELECT run_id,
           CASE WHEN failed = 0 THEN printf('completed: %d files processed, %d backed up, %d pruned',
                                            succeeded, backed_up, pruned)
                ELSE printf('completed with errors: %d succeeded, %d failed (%.1f%% failure rate)',
                            succeeded, failed, {_RATE_SQL.format(s="succeeded", f="failed")}::DOUBLE)
                END AS line,
           CASE WHEN failed = 0 THEN printf('pruned %d files', pruned)
                ELSE printf('pruned %d files, %d failed (%.1f%% failure rate)',
                            pruned, failed, {_RATE_SQL.format(s="pruned", f="failed")}::DOUBLE)
                END AS prune_line
    FROM s
    """,
)
def sentences(spark, sf_dir):
    runs = run_summary(event_outcomes(spark, sf_dir), ["run_id"])
    return runs.select(
        "run_id",
        summary_line("succeeded", "failed", "backed_up", "pruned").alias("line"),
        prune_summary_line("pruned", "failed").alias("prune_line"),
    )


def ordered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "user_id", "event_id", (F.col("event_type") == "error").alias("failed")
    )


_RUNNING_SQL = """
    SELECT user_id, event_id, event_type = 'error' AS failed,
           count(*) FILTER (event_type <> 'error') OVER w AS running_succeeded,
           count(*) FILTER (event_type = 'error') OVER w AS running_failed,
           CAST(count(*) FILTER (event_type = 'error') OVER w AS DOUBLE) / count(*) OVER w * 100
               AS running_rate
    FROM events WINDOW w AS ({part} ORDER BY event_id ROWS UNBOUNDED PRECEDING)
"""


@query("running_failure_rate", _RUNNING_SQL.format(part="PARTITION BY user_id"))
def running_by_user(spark, sf_dir):
    return running_failure_rate(ordered_events(spark, sf_dir), ["user_id"], ["event_id"], "failed")


@query("running_failure_rate_one_run", _RUNNING_SQL.format(part=""))
def running_in_one_run(spark, sf_dir):
    return running_failure_rate(ordered_events(spark, sf_dir), [], ["event_id"], "failed")


@query(
    "stop_at_breach",
    f"""
    WITH r AS ({_RUNNING_SQL.format(part="PARTITION BY user_id")}),
         s AS (SELECT user_id, min(event_id) AS stop FROM r WHERE failed AND running_rate > 25
               GROUP BY user_id)
    SELECT r.*, coalesce(r.event_id = s.stop, false) AS tripped
    FROM r LEFT JOIN s ON r.user_id = s.user_id
    WHERE s.stop IS NULL OR r.event_id <= s.stop
    """,
)
def breaker_by_user(spark, sf_dir):
    return stop_at_breach(
        ordered_events(spark, sf_dir), ["user_id"], ["event_id"], "failed", 25.0
    )


LATE_RATE = 5.0


@query(
    "stop_at_breach_one_run",
    f"""
    WITH late AS (
      SELECT user_id, event_id,
             CASE WHEN event_id * 2 > (SELECT max(event_id) FROM events) THEN event_type ELSE 'fine' END AS event_type
      FROM events),
    r AS ({_RUNNING_SQL.format(part="").replace("FROM events", "FROM late")}),
    s AS (SELECT min(event_id) AS stop FROM r WHERE failed AND running_rate > {LATE_RATE})
    SELECT r.*, coalesce(r.event_id = s.stop, false) AS tripped
    FROM r CROSS JOIN s WHERE s.stop IS NULL OR r.event_id <= s.stop
    """,
)
def breaker_over_one_run(spark, sf_dir):
    """One run over all events whose first half is fine, so that it trips far on."""
    rows = ordered_events(spark, sf_dir)
    last = rows.agg(F.max("event_id")).first()[0]
    late = rows.withColumn("failed", F.col("failed") & (F.col("event_id") * 2 > F.lit(last)))
    return stop_at_breach(late, [], ["event_id"], "failed", LATE_RATE)
