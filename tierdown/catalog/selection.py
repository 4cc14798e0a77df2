"""Who is expired, where it goes, what stays."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierdown.catalog.registry import (
    EVENTS_AS_OF,
    EVENTS_CUTOFF,
    HOURS,
    ORDERS_AS_OF,
    ORDERS_CUTOFF,
    query,
    table,
)
from tierdown.functions import (
    archive_bucket,
    archive_extension,
    archive_name,
    extension_for,
    is_expired,
    merge_destinations,
    relative_key,
)
from tierdown.operators import (
    apply_policies,
    archive_plan,
    archive_stats,
    destination_plan,
    dry_run,
    expired,
    expired_by_policy,
    overlap_guard,
    policy_lint,
    prune_safe,
    retained,
    retention_split,
    unbacked,
    unread_items,
)
from tierdown.plans.folders import write_bytes
from tierdown.scratch import scratch_dir
from tierdown.sources import POLICY_SCHEMA, broken_streams, file_ages, file_inventory, read_with_errors, table_source
from tierdown.sources.readable import tolerant

TWO_DESTINATIONS = ("s3://vault-a/backup", "s3://vault-b/backup/")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    sized = df.withColumn("bytes", F.octet_length("props").cast("bigint"))
    return table_source(sized, "ts", "bytes", "event_id")


def old_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expired(events(spark, sf_dir), "ts", HOURS, EVENTS_AS_OF)


def old_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expired(table(spark, sf_dir, "orders"), "o_orderdate", HOURS, ORDERS_AS_OF)


@query(
    "expired_events",
    f"SELECT event_id, ts, user_id, event_type FROM events WHERE ts < {EVENTS_CUTOFF}",
)
def expired_events(spark, sf_dir):
    return old_events(spark, sf_dir).select("event_id", "ts", "user_id", "event_type")


@query(
    "retained_events",
    f"SELECT event_id, ts, user_id, event_type FROM events WHERE ts IS NULL OR ts >= {EVENTS_CUTOFF}",
)
def retained_events(spark, sf_dir):
    kept = retained(events(spark, sf_dir), "ts", HOURS, EVENTS_AS_OF)
    return kept.select("event_id", "ts", "user_id", "event_type")


@query(
    "retention_split",
    f"""
    SELECT coalesce(ts < {EVENTS_CUTOFF}, false) AS expired, count(*) AS items,
           CAST(sum(strlen(props)) AS BIGINT) AS bytes
    FROM events GROUP BY 1
    """,
)
def split(spark, sf_dir):
    return retention_split(events(spark, sf_dir), "ts", HOURS, EVENTS_AS_OF, "bytes")


@query(
    "bucket_daily",
    f"""
    SELECT strftime(ts, '%Y-%m-%d') AS bucket,
           'backup-' || strftime(ts, '%Y-%m-%d') || '.tar.gz' AS archive_name, count(*) AS items
    FROM events WHERE ts < {EVENTS_CUTOFF} GROUP BY ALL
    """,
)
def bucket_daily(spark, sf_dir):
    return _containers(old_events(spark, sf_dir), "ts", "daily", "tar.gz")


@query(
    "bucket_weekly",
    f"""
    SELECT strftime(o_orderdate, '%G-W%V') AS bucket,
           'backup-' || strftime(o_orderdate, '%G-W%V') || '.tar' AS archive_name, count(*) AS items
    FROM orders WHERE o_orderdate < {ORDERS_CUTOFF} GROUP BY ALL
    """,
)
def bucket_weekly(spark, sf_dir):
    return _containers(old_orders(spark, sf_dir), "o_orderdate", "weekly", "tar")


@query(
    "bucket_monthly",
    f"""
    SELECT strftime(l_shipdate, '%Y-%m') AS bucket,
           'backup-' || strftime(l_shipdate, '%Y-%m') || '.zip' AS archive_name, count(*) AS items
    FROM lineitem WHERE l_shipdate < {ORDERS_CUTOFF} GROUP BY ALL
    """,
)
def bucket_monthly(spark, sf_dir):
    old = expired(table(spark, sf_dir, "lineitem"), "l_shipdate", HOURS, ORDERS_AS_OF)
    return _containers(old, "l_shipdate", "monthly", "zip")


def _containers(df: DataFrame, ts: str, group_by: str, format: str) -> DataFrame:
    bucketed = df.select(archive_bucket(ts, group_by).alias("bucket"))
    named = archive_stats(bucketed).withColumn("archive_name", archive_name("bucket", format))
    return named.select("bucket", "archive_name", "items")


@query(
    "relative_key",
    """
    SELECT page_id, root, substr(url, strlen(root) + 2) AS rel_path FROM (
        SELECT page_id, url, regexp_extract(url, '^(https?://[^/]+)', 1) AS root FROM pages)
    """,
)
def relative_keys(spark, sf_dir):
    root = F.regexp_extract("url", "^(https?://[^/]+)", 1)
    pages = table(spark, sf_dir, "pages").select("page_id", "url", root.alias("root"))
    return pages.select("page_id", "root", relative_key("url", F.col("root")).alias("rel_path"))


@query(
    "extensions",
    """
    SELECT algorithm, CASE algorithm WHEN 'gzip' THEN '.gz' ELSE '' END AS extension,
           format, CASE format WHEN 'tar' THEN '.tar' WHEN 'zip' THEN '.zip' ELSE '.tar.gz' END
               AS archive_extension,
           count(*) AS items
    FROM (
        SELECT CASE o_orderstatus WHEN 'F' THEN 'gzip' WHEN 'O' THEN 'none' ELSE 'lz4' END AS algorithm,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'tar' WHEN '2-HIGH' THEN 'tar.gz'
                    WHEN '3-MEDIUM' THEN 'zip' ELSE 'rar' END AS format
        FROM orders)
    GROUP BY ALL
    """,
)
def extensions(spark, sf_dir):
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    algorithm = F.when(status == "F", "gzip").when(status == "O", "none").otherwise("lz4")
    format = (
        F.when(priority == "1-URGENT", "tar")
        .when(priority == "2-HIGH", "tar.gz")
        .when(priority == "3-MEDIUM", "zip")
        .otherwise("rar")
    )
    combos = (
        table(spark, sf_dir, "orders")
        .groupBy(algorithm.alias("algorithm"), format.alias("format"))
        .agg(F.count(F.lit(1)).alias("items"))
    )
    return combos.select(
        "algorithm",
        extension_for(F.col("algorithm")).alias("extension"),
        "format",
        archive_extension(F.col("format")).alias("archive_extension"),
        "items",
    )


@query(
    "destination_plan",
    f"""
    SELECT o_orderkey, destination,
           rtrim(destination, '/') || '/' || o_orderpriority || '/' || o_orderkey || '.json.gz' AS target_path
    FROM orders,
         (VALUES ('{TWO_DESTINATIONS[0]}'), ('{TWO_DESTINATIONS[1]}')) AS d(destination)
    WHERE o_orderdate < {ORDERS_CUTOFF}
    """,
)
def plan_copies(spark, sf_dir):
    keyed = old_orders(spark, sf_dir).select(
        "o_orderkey",
        F.concat("o_orderpriority", F.lit("/"), F.col("o_orderkey"), F.lit(".json")).alias("key"),
    )
    planned = destination_plan(keyed, TWO_DESTINATIONS, "key", "gzip")
    return planned.select("o_orderkey", "destination", "target_path")


@query(
    "dry_run_plan",
    f"""
    SELECT destination,
           rtrim(destination, '/') || '/backup-' || strftime(ts, '%Y-%m-%d') || '.tar.gz' AS target_path,
           count(*) AS planned_items, CAST(sum(strlen(props)) AS BIGINT) AS planned_bytes
    FROM events,
         (VALUES ('{TWO_DESTINATIONS[0]}'), ('{TWO_DESTINATIONS[1]}')) AS d(destination)
    WHERE ts < {EVENTS_CUTOFF} GROUP BY ALL
    """,
)
def dry_run_plan(spark, sf_dir):
    plan = archive_plan(old_events(spark, sf_dir), TWO_DESTINATIONS, "ts", "daily")
    return dry_run(plan, "bytes", ["destination", "target_path"])


@query(
    "prune_safe",
    f"""
    SELECT o_orderkey, o_orderdate FROM orders
    WHERE o_orderdate < {ORDERS_CUTOFF} AND o_orderkey IN (SELECT l_orderkey FROM lineitem)
    """,
)
def safe_orders(spark, sf_dir):
    held = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    old = old_orders(spark, sf_dir).select("o_orderkey", "o_orderdate")
    return prune_safe(old, held, "o_orderkey")


@query(
    "unbacked",
    f"""
    SELECT o_orderkey, o_orderdate FROM orders
    WHERE o_orderdate < {ORDERS_CUTOFF}
      AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
    """,
)
def unbacked_orders(spark, sf_dir):
    held = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    old = old_orders(spark, sf_dir).select("o_orderkey", "o_orderdate")
    return unbacked(old, held, "o_orderkey")


# one policy per class of rows; purchases have none and are never expired
EVENT_POLICIES = (("view", 240.0), ("click", 100.25), ("signup", 480.0), ("error", 24.0))
_POLICY_VALUES = ", ".join(f"('{name}', {hours})" for name, hours in EVENT_POLICIES)
_POLICY_CUTOFF = "TIMESTAMP '2024-01-31' - to_microseconds(CAST(hours * 3600000000 AS BIGINT))"


def event_policies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EVENT_POLICIES, "event_type STRING, prune_after_hours DOUBLE")


@query(
    "policy_retention",
    f"""
    SELECT e.event_type, coalesce(ts < {_POLICY_CUTOFF}, false) AS expired, count(*) AS items
    FROM events e LEFT JOIN (VALUES {_POLICY_VALUES}) AS p(event_type, hours)
         ON e.event_type = p.event_type
    GROUP BY ALL
    """,
)
def policy_retention(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", "ts")
    judged = apply_policies(rows, event_policies(spark), "event_type", "ts", EVENTS_AS_OF)
    return judged.groupBy("event_type", "expired").agg(F.count(F.lit(1)).alias("items"))


@query(
    "policy_expired",
    f"""
    SELECT event_id, e.event_type, ts
    FROM events e JOIN (VALUES {_POLICY_VALUES}) AS p(event_type, hours)
         ON e.event_type = p.event_type
    WHERE ts < {_POLICY_CUTOFF}
    """,
)
def policy_expired(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    return expired_by_policy(
        rows, event_policies(spark), "event_type", "ts", EVENTS_AS_OF
    ).select("event_id", "event_type", "ts")


@query(
    "overlap_guard",
    """
    WITH s AS (SELECT DISTINCT regexp_extract(url, '^https?://[^/]+/en') AS source
               FROM pages WHERE regexp_matches(url, '^https?://[^/]+/en(/|$)')),
         d AS (SELECT DISTINCT regexp_replace(url, '[?#].*$', '') AS destination FROM pages)
    SELECT source, destination FROM d JOIN s
      ON rtrim(destination, '/') = source OR starts_with(destination, source || '/')
    """,
)
def overlaps(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("url")
    english = pages.where(F.col("url").rlike("^https?://[^/]+/en(/|$)"))
    sources = english.select(F.regexp_extract("url", "^https?://[^/]+/en", 0).alias("source"))
    targets = pages.select(F.regexp_replace("url", "[?#].*$", "").alias("destination"))
    return overlap_guard(sources, targets)


@query(
    "merge_destinations",
    """
    SELECT c_custkey, array_to_string(
        list_filter(both_lists, lambda d, i: d <> '' AND list_position(both_lists, d) = i), '|')
        AS destinations
    FROM (
        SELECT c_custkey, ['s3://' || lower(CASE WHEN c_acctbal < 1000 THEN '' ELSE c_mktsegment END),
                           's3://nation-' || c_nationkey, 's3://',
                           's3://' || lower(c_mktsegment), 's3://nation-' || c_nationkey] AS raw_lists,
               list_transform(raw_lists, lambda d: CASE WHEN d = 's3://' THEN '' ELSE d END) AS both_lists
        FROM customer)
    """,
)
def merged_destinations(spark, sf_dir):
    segment = F.concat(F.lit("s3://"), F.lower("c_mktsegment"))
    nation = F.concat(F.lit("s3://nation-"), F.col("c_nationkey"))
    single = F.when(F.col("c_acctbal") < 1000, F.lit("")).otherwise(segment)
    merged = merge_destinations(single, F.array(nation, F.lit(""), segment, nation))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.array_join(merged, "|").alias("destinations")
    )


def customer_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One policy per customer, good and bad ones, in the policy schema."""
    balance, nation, segment = F.col("c_acctbal"), F.col("c_nationkey"), F.col("c_mktsegment")
    chosen = {
        "prune_after_hours": balance / 100,
        "target_folder": F.when(nation == 3, "").otherwise(F.concat(F.lit("/data/"), segment)),
        "run_interval": nation * 60,
        "backup_path": F.when(nation > 12, "").otherwise(F.concat(F.lit("/backup/"), segment)),
        "backup_paths": F.when(nation > 20, F.array(F.lit("/second"))),
        "remote_backup": F.when(segment == "BUILDING", "user@host/path").otherwise(""),
        "remote_backups": F.when(nation > 5, F.array(F.lit("user@host.example.com:/backup"))),
        "enable_backup": segment != "MACHINERY",
        "error_threshold_percent": balance / 50,
        "compression": F.struct(
            (nation < 10).alias("enabled"),
            F.when(nation == 1, "ZSTD").when(nation == 2, "").otherwise("GZIP").alias("algorithm"),
            (nation * 2 - 4).alias("level"),
        ),
        "archive": F.struct(
            (nation >= 8).alias("enabled"),
            F.when(nation == 9, "rar").when(nation == 10, "ZIP").otherwise("").alias("format"),
            F.when(nation == 11, "yearly").otherwise("Weekly").alias("group_by"),
        ),
    }
    columns = [
        chosen.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in POLICY_SCHEMA
    ]
    return table(spark, sf_dir, "customer").select("c_custkey", *columns)


@query(
    "policy_lint",
    """
    SELECT c_custkey, array_to_string(list_filter([
        CASE WHEN c_acctbal / 100 <= 0 THEN 'prune_after_hours must be positive' END,
        CASE WHEN c_nationkey * 60 <= 0 THEN 'run_interval must be positive' END,
        CASE WHEN c_nationkey = 3 THEN 'target_folder is required' END,
        CASE WHEN c_mktsegment <> 'MACHINERY' AND c_nationkey > 12 AND c_nationkey <= 20
             THEN 'a backup destination is required when backup is on' END,
        CASE WHEN c_mktsegment = 'BUILDING'
             THEN 'a remote must look like user@host:/path or host:/path' END,
        CASE WHEN c_acctbal / 50 < 0 OR c_acctbal / 50 > 100
             THEN 'error_threshold_percent must lie between 0 and 100' END,
        CASE WHEN c_nationkey = 1 THEN 'unknown compression algorithm' END,
        CASE WHEN c_nationkey < 10 AND c_nationkey <> 1 AND c_nationkey * 2 - 4 NOT IN (0, -1)
              AND c_nationkey * 2 - 4 NOT BETWEEN 1 AND 9
             THEN 'compression level must lie between 1 and 9' END,
        CASE WHEN c_nationkey = 9 THEN 'unknown archive format' END,
        CASE WHEN c_nationkey = 11 THEN 'unknown archive grouping' END,
        CASE WHEN c_nationkey IN (8, 9) THEN 'archive and compression exclude each other' END
        ], lambda v: v IS NOT NULL), '; ') AS violations
    FROM customer
    """,
)
def linted_policies(spark, sf_dir):
    linted = policy_lint(customer_policies(spark, sf_dir))
    return linted.select("c_custkey", F.array_join("violations", "; ").alias("violations"))


def _export_with_faults(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """Good files of two formats, and beside them one of each that is cut off or damaged."""
    base = scratch_dir(spark, "faults")
    lines = table(spark, sf_dir, "documents").select(F.translate("text", "\r\n", "  ").alias("value"))
    lines.write.option("compression", "gzip").text(f"{base}/gz/good")
    table(spark, sf_dir, "nation").repartition(2).write.parquet(f"{base}/parquet/good")
    for name, fmt in (("gz", "text"), ("parquet", "parquet")):
        small = table(spark, sf_dir, "region")
        small = small.select(F.to_json(F.struct("*")).alias("value")) if fmt == "text" else small
        small.coalesce(1).write.format(fmt).option("compression", "gzip").save(f"{base}/whole-{name}")
        # a handful of bytes: the file of the smallest table
        files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{name}").load(f"{base}/whole-{name}")
        content = bytes(files.first().content)
        hurt = content[: len(content) // 2] if name == "gz" else content[:4] + bytes(len(content) // 3) + content[4 + len(content) // 3 :]
        write_bytes(spark, f"{base}/{name}/broken.{name}", hurt)
    return {name: f"{base}/{name}" for name in ("gz", "parquet")}


@query(
    "access_errors",
    """
    SELECT 'gz' AS format, CAST(1 AS BIGINT) AS errors, 'broken.gz' AS broken, count(*) AS items FROM documents
    UNION ALL SELECT 'parquet', 1, 'broken.parquet', count(*) FROM nation
    """,
)
def access_errors(spark, sf_dir):
    """Every file of two folders is read, and one of each is reported; the rows counted are
    those of files without an error. They are counted by file before errors are looked up."""
    found = None
    for name, path in _export_with_faults(spark, sf_dir).items():
        fmt = "text" if name == "gz" else "parquet"
        schema = "value string" if name == "gz" else table(spark, sf_dir, "nation").schema
        streams = broken_streams(spark, path) if name == "gz" else None
        read = lambda s, fmt=fmt, schema=schema, path=path: tolerant(s, fmt, path, schema=schema)
        good, errors = read_with_errors(file_inventory(spark, path), read, streams)
        held = good.groupBy(F.col("_metadata.file_path").alias("key")).agg(F.count(F.lit(1)).alias("items"))
        rows = held.join(errors.select("key"), "key", "left_anti").select(F.lit(None).cast("string").alias("broken"), "items")
        both = rows.unionByName(errors.select(F.substring_index("key", "/", -1).alias("broken"), F.lit(0).alias("items")))
        one = both.agg(
            F.lit(name).alias("format"), F.count("broken").alias("errors"), F.max("broken").alias("broken"), F.coalesce(F.sum("items"), F.lit(0)).alias("items")
        )
        found = one if found is None else found.unionByName(one)
    return found


@query(
    "unread_items",
    """
    SELECT doc_id AS key, 'access' AS operation, 'listed but not readable' AS err
    FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    """,
)
def unread(spark, sf_dir):
    listed = table(spark, sf_dir, "documents").select("doc_id")
    return unread_items(listed, table(spark, sf_dir, "labels").select("doc_id"), "doc_id")


@query(
    "table_file_ages",
    """
    SELECT l_returnflag, count(*) AS items, CAST(sum(l_orderkey) AS BIGINT) AS key_sum, count(*) AS expired_items,
           CAST(0 AS BIGINT) AS early_items, (SELECT count(*) FROM lineitem) AS file_items
    FROM lineitem GROUP BY l_returnflag
    """,
)
def table_file_ages(spark, sf_dir):
    """Rows by the age of the file that holds them: all are old in 2100 and none in 1990.

    Rows are summed by file before they meet its age: dealt by file, all rows of a large
    file would be one task's work.
    """
    path = F.col("_metadata.file_path").alias("file_path")
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", path)
    held = rows.groupBy("l_returnflag", "file_path").agg(F.count(F.lit(1)).alias("items"), F.sum("l_orderkey").alias("key_sum"))
    files = file_ages(table(spark, sf_dir, "lineitem")).where("size > 0")
    late, early = (F.when(is_expired(files, "mtime", 24.0, datetime(year, 1, 1)), F.col("items")).otherwise(0) for year in (2100, 1990))
    dated = held.join(files.select("file_path", "mtime"), "file_path")
    known = files.agg(F.sum("items")).first()[0]
    sums = {"items": F.col("items"), "key_sum": F.col("key_sum"), "expired_items": late, "early_items": early}
    return dated.groupBy("l_returnflag").agg(
        *[F.sum(c).cast("bigint").alias(name) for name, c in sums.items()]
    ).withColumn("file_items", F.lit(known).cast("bigint"))
