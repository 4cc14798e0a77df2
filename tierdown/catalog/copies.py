"""Queries that write, and answer from what was written."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tierdown.catalog.registry import (
    EVENTS_AS_OF,
    EVENTS_CUTOFF,
    HOURS,
    ORACLES,
    ORDERS_CUTOFF,
    query,
    table,
)
from tierdown.catalog.selection import events, old_orders
from tierdown.functions import archive_bucket, is_expired
from tierdown.operators import expired, restore_over, retained
from tierdown.plans import (
    archive_chunks,
    archive_objects,
    archive_sizes,
    archive_table,
    backup,
    backup_then_prune,
    backup_then_prune_files,
    index_keys,
    open_archive,
    open_manifest,
    point_view,
    prune_files,
    prune_generation,
    prune_objects,
    prune_partitions,
    read_copies,
    read_snapshot,
    record_tree,
    repair_copy,
    restore,
    restore_chunks,
    restore_keys,
    run_once,
    split_proven,
    stored_sizes,
    write_compressed,
)
from tierdown.scratch import scratch_dir
from tierdown.sources import decompress_read, file_inventory, walk_objects


def export_documents(spark: SparkSession, sf_dir: str) -> str:
    """The documents as an object store: text files, one folder per source."""
    root = scratch_dir(spark, "objects")
    lines = table(spark, sf_dir, "documents").select(
        "source", F.translate("text", "\r\n", "  ").alias("value")
    )
    lines.hint("rebalance", "source").write.partitionBy("source").text(root)
    return root


_EXPORT_SQL = """
    SELECT source, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes
    FROM documents GROUP BY source
"""


def _folder(key: str):
    return F.regexp_extract(key, "^source=([^/]*)/", 1)


_LINES_SQL = """
    SELECT source, md5(translate(text, chr(13) || chr(10), '  ')) AS line_md5, count(*) AS lines
    FROM documents GROUP BY ALL
"""


@query(
    "file_inventory",
    f"""
    SELECT e.source, line_md5, lines, bytes, bytes AS expired_bytes, CAST(0 AS BIGINT) AS early_bytes
    FROM ({_EXPORT_SQL}) e JOIN ({_LINES_SQL}) l ON e.source = l.source
    """,
)
def inventory(spark, sf_dir):
    """Sizes and ages of the files listed, and the lines that are read below the keys listed."""
    root = export_documents(spark, sf_dir)
    files = file_inventory(spark, root).withColumn("source", _folder("rel_path"))
    late, early = (F.when(is_expired(files, "mtime", 24.0, datetime(year, 1, 1)), F.col("size")).otherwise(0) for year in (2100, 1990))
    sizes = files.groupBy("source").agg(
        *[F.sum(c).cast("bigint").alias(name) for name, c in (("bytes", F.col("size")), ("expired_bytes", late), ("early_bytes", early))]
    )
    text = spark.read.schema("value string, source string").text(root)
    key = F.concat_ws("/", F.element_at(F.split("_metadata.file_path", "/"), -2), F.col("_metadata.file_name"))
    listed = text.withColumn("rel_path", key).join(files.select("rel_path"), "rel_path", "left_semi")
    each = listed.groupBy("source", F.md5("value").alias("line_md5")).agg(F.count(F.lit(1)).alias("lines"))
    return each.join(sizes, "source")


@query("object_archive", _LINES_SQL)
def object_archive(spark, sf_dir):
    root, vault = export_documents(spark, sf_dir), scratch_dir(spark, "vault")
    later = datetime(2100, 1, 1)
    archive_objects(spark, root, [vault], "run-1", 24.0, later)
    back = restore(spark, vault, "rel_path")
    # each line ends in a line feed, so the last piece is none
    lines = F.split(F.col("content").cast("string"), "\n")
    each = back.select(_folder("rel_path").alias("source"), F.explode(F.slice(lines, 1, F.size(lines) - 1)).alias("line"))
    return each.groupBy("source", F.md5("line").alias("line_md5")).agg(F.count(F.lit(1)).alias("lines"))


@query(
    "walk_hidden",
    """
    SELECT CASE WHEN doc_id % 2 = 0 THEN '.even' ELSE '_odd' END AS folder, source,
           CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes
    FROM documents GROUP BY ALL
    """,
)
def walk_hidden(spark, sf_dir):
    """A tree whose folders all have hidden names; the marks and checksums that writers leave
    beside their files are found as well, and told apart by name."""
    root = scratch_dir(spark, "objects")
    docs = table(spark, sf_dir, "documents")
    for folder, part in ((".even", 0), ("_odd", 1)):
        lines = docs.where(F.pmod("doc_id", F.lit(2)) == part).select("source", F.translate("text", "\r\n", "  ").alias("value"))
        lines.hint("rebalance", "source").write.partitionBy("source").text(f"{root}/{folder}/_tables")
    files, _ = walk_objects(spark, root)
    parts = files.where(F.col("rel_path").rlike("/part-[^/]*$"))
    source = F.regexp_extract("rel_path", "/source=([^/]*)/", 1)
    return parts.groupBy(F.substring_index("rel_path", "/", 1).alias("folder"), source.alias("source")).agg(
        F.sum("size").cast("bigint").alias("bytes")
    )


@query("object_chunks", _LINES_SQL)
def object_chunks(spark, sf_dir):
    """Files cut into chunks of 64 KiB, archived, removed, put together again elsewhere, and read."""
    root, vault, target = export_documents(spark, sf_dir), scratch_dir(spark, "vault"), scratch_dir(spark, "target")
    later = datetime(2100, 1, 1)
    archive_chunks(spark, root, [vault], "run-1", 24.0, later, chunk_bytes=64 << 10)
    prune_objects(spark, root, [vault], 24.0, later)
    written, _ = restore_chunks(spark, vault, target)
    # what was put back has to be what the manifest says
    proven = written.join(open_manifest(spark, vault), ["rel_path", "size", "digest"], "left_semi").select("rel_path")
    lines = spark.read.schema("value string, source string").text(target)
    key = F.concat_ws("/", F.element_at(F.split("_metadata.file_path", "/"), -2), F.col("_metadata.file_name"))
    proven_lines = lines.withColumn("rel_path", key).join(proven, "rel_path", "left_semi")
    return proven_lines.groupBy("source", F.md5("value").alias("line_md5")).agg(F.count(F.lit(1)).alias("lines"))


@query(
    "gzip_roundtrip",
    "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents",
)
def gzip_roundtrip(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    path = scratch_dir(spark, "gzip")
    write_compressed(docs, path, "gzip", 6, "json")
    back = decompress_read(spark, path, "json", docs.schema)
    return back.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


@query(
    "copy_ratios",
    """
    SELECT source, md5(text) AS text_md5, count(*) AS items, (SELECT CAST(sum(strlen(text)) AS BIGINT) FROM documents) AS original_bytes,
           true AS smaller
    FROM documents GROUP BY ALL
    """,
)
def copy_ratios(spark, sf_dir):
    """The sizes of a compressed copy, beside what the copy holds."""
    docs = table(spark, sf_dir, "documents").select(
        "source", "text", F.octet_length("text").cast("bigint").alias("bytes")
    )
    outcomes = backup(docs, [scratch_dir(spark, "copy")], "run-1", "gzip", 6, "bytes")
    ratio = F.col("stored_bytes") * 100 / F.col("original_bytes")
    smaller = (F.abs(F.col("compression_ratio") - ratio) < 1e-6) & (F.abs(F.col("space_saved") + ratio - 100) < 1e-6) & (ratio < 100)
    sizes = stored_sizes(spark, outcomes).select("destination", "original_bytes", smaller.alias("smaller"))
    held = read_copies(spark, outcomes, docs.schema).groupBy("destination", "source", F.md5("text").alias("text_md5"))
    return held.agg(F.count(F.lit(1)).alias("items")).join(sizes, "destination").drop("destination")


@query(
    "multi_dest_backup",
    f"""
    SELECT destination, o_orderstatus, count(*) AS items,
           CAST(sum(o_orderkey) AS BIGINT) AS key_sum
    FROM orders, (VALUES ('a'), ('b')) AS d(destination)
    WHERE o_orderdate < {ORDERS_CUTOFF} GROUP BY ALL
    """,
)
def multi_dest_backup(spark, sf_dir):
    old = old_orders(spark, sf_dir)
    base = scratch_dir(spark, "copies")
    outcomes = backup(old, [f"{base}/a", f"{base}/b"], "run-1", "gzip", 6)
    held = read_copies(spark, outcomes, old.schema)
    name = F.element_at(F.split("destination", "/"), -1)
    return held.groupBy(name.alias("destination"), "o_orderstatus").agg(
        F.count(F.lit(1)).alias("items"), F.sum("o_orderkey").alias("key_sum")
    )


@query(
    "archive_roundtrip",
    f"""
    SELECT event_id, ts, user_id, event_type, value, props, strftime(ts, '%G-W%V') AS bucket
    FROM events WHERE ts < {EVENTS_CUTOFF}
    """,
)
def archive_roundtrip(spark, sf_dir):
    old = expired(table(spark, sf_dir, "events"), "ts", HOURS, EVENTS_AS_OF)
    vault = scratch_dir(spark, "vault")
    archive_table(old, "ts", [f"{vault}/a", f"{vault}/b"], "run-1", "weekly")
    return restore(spark, f"{vault}/b", "event_id", schema=old.schema).drop("run_id")


@query(
    "archive_sizes",
    f"""
    SELECT strftime(o_orderdate, '%Y-%m') AS bucket, count(*) AS items, true AS stored,
           CAST(sum(o_orderkey) AS BIGINT) AS key_sum, CAST(min(o_orderkey) AS BIGINT) AS first_key, CAST(max(o_orderkey) AS BIGINT) AS last_key,
           CAST(bit_xor(o_orderkey) AS BIGINT) AS keys_xor
    FROM orders WHERE o_orderdate < {ORDERS_CUTOFF} GROUP BY 1
    """,
)
def container_sizes(spark, sf_dir):
    vault = scratch_dir(spark, "vault")
    old = old_orders(spark, sf_dir)
    archive_table(old, "o_orderdate", [vault], "run-1", "monthly", "tar")
    archive = open_archive(spark, vault, old.schema)
    sizes = archive_sizes(archive)
    # what the containers are said to take is what is stored
    on_disk = file_inventory(spark, vault).agg(F.sum("size")).first()[0]
    whole = sizes.agg(F.sum("archive_size")).first()[0] == on_disk
    stored = (F.col("files") > 0) & (F.col("archive_size") > 0) & F.lit(whole)
    key = F.col("o_orderkey").cast("bigint")
    held = archive.groupBy("bucket").agg(
        F.sum(key).alias("key_sum"), F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.bit_xor(key).alias("keys_xor")
    )
    return sizes.select("bucket", "items", stored.alias("stored")).join(held, "bucket")


@query(
    "restore_latest",
    f"""
    SELECT event_id, CASE WHEN event_type = 'error' THEN 'again' ELSE props END AS props,
           CASE WHEN event_type = 'error' THEN '0002' ELSE '0001' END AS run_id,
           strftime(ts, '%Y-%m-%d') AS bucket
    FROM events WHERE ts < {EVENTS_CUTOFF}
    """,
)
def restore_latest(spark, sf_dir):
    old = expired(table(spark, sf_dir, "events"), "ts", HOURS, EVENTS_AS_OF)
    vault = scratch_dir(spark, "vault")
    archive_table(old, "ts", [vault], "0001", "daily")
    again = old.where("event_type = 'error'").withColumn("props", F.lit("again"))
    archive_table(again, "ts", [vault], "0002", "daily")
    newest = restore(spark, vault, "event_id", schema=old.schema)
    return newest.select("event_id", "props", "run_id", "bucket")


@query(
    "restore_keys",
    f"""
    WITH wanted AS (SELECT min(event_id) AS event_id FROM events WHERE event_type <> 'click' GROUP BY user_id)
    SELECT event_id, CASE WHEN event_type = 'error' THEN 'again' ELSE props END AS props,
           CASE WHEN event_type = 'error' THEN '0002' ELSE '0001' END AS run_id,
           strftime(ts, '%Y-%m-%d') AS bucket
    FROM events JOIN wanted USING (event_id) WHERE ts < {EVENTS_CUTOFF}
    """,
)
def restore_some_keys(spark, sf_dir):
    """The first event of each user that is no click, as far as it was archived; the first
    run is indexed, files of the second one are opened since no index knows them."""
    df = table(spark, sf_dir, "events")
    old = expired(df, "ts", HOURS, EVENTS_AS_OF)
    vault = scratch_dir(spark, "vault")
    archive_table(old, "ts", [vault], "0001", "daily")
    index_keys(spark, vault, "event_id", "0001", old.schema)
    again = old.where("event_type = 'error'").withColumn("props", F.lit("again"))
    archive_table(again, "ts", [vault], "0002", "daily")
    wanted = df.where("event_type <> 'click'").groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    newest = restore_keys(spark, vault, "event_id", wanted, schema=old.schema)
    return newest.select("event_id", "props", "run_id", "bucket")


@query(
    "restore_over",
    """
    SELECT event_id, ts, event_type,
           CASE WHEN event_type = 'error' THEN 'from the archive' ELSE props END AS props
    FROM events
    """,
)
def put_back(spark, sf_dir):
    current = table(spark, sf_dir, "events")
    errors = current.where("event_type = 'error'").withColumn("props", F.lit("from the archive"))
    vault = scratch_dir(spark, "vault")
    archive_table(errors, "ts", [vault], "run-1", "weekly")
    restored = restore(spark, vault, "event_id", schema=current.schema)
    after = restore_over(current, restored, "event_id")
    return after.select("event_id", "ts", "event_type", "props")


@query(
    "repair_copy",
    ORACLES["archive_roundtrip"],
)
def mended_copy(spark, sf_dir):
    """A second copy with altered errors in one week and without the clicks of another is
    mended from the first."""
    old = expired(table(spark, sf_dir, "events"), "ts", HOURS, EVENTS_AS_OF)
    vault, week = scratch_dir(spark, "vault"), archive_bucket("ts", "weekly")
    altered = (week == "2024-W02") & (F.col("event_type") == "error")
    lost = (week == "2024-W01") & (F.col("event_type") == "click")
    hurt = old.withColumn("props", F.when(altered, F.lit("altered")).otherwise(F.col("props"))).where(~lost)
    archive_table(old, "ts", [f"{vault}/a"], "run-1", "weekly")
    archive_table(hurt, "ts", [f"{vault}/b"], "run-1", "weekly")
    record_tree(spark, f"{vault}/a/run_id=run-1", old.schema)
    repair_copy(spark, f"{vault}/a/run_id=run-1", f"{vault}/b/run_id=run-1", old.schema)
    return restore(spark, f"{vault}/b", "event_id", schema=old.schema).drop("run_id")


@query(
    "prune_keep",
    f"SELECT event_id, ts, user_id, event_type, value FROM events WHERE ts IS NULL OR ts >= {EVENTS_CUTOFF}",
)
def prune_keep(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    kept = retained(df, "ts", HOURS, EVENTS_AS_OF)
    path = scratch_dir(spark, "generation")
    prune_generation(kept, kept.count(), path)
    view = f"events_kept_{path[-12:]}"
    point_view(spark, view, path)
    return spark.table(view).select("event_id", "ts", "user_id", "event_type", "value")


@query(
    "prune_partitions",
    """
    SELECT event_id, ts, user_id, CAST(ts AS DATE) AS dt FROM events
    WHERE ts >= TIMESTAMP '2024-01-20 12:00:00'
    """,
)
def prune_by_partition(spark, sf_dir):
    base = scratch_dir(spark, "table")
    name = f"events_{base[-12:]}"
    rows = table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", F.to_date("ts").alias("dt")
    )
    rows.hint("rebalance", "dt").write.partitionBy("dt").option("path", base).saveAsTable(name)
    prune_partitions(spark, name, "ts", "dt", HOURS, datetime(2024, 1, 30, 12))
    # the answer is kept, the example table is not
    spark.table(name).write.parquet(f"{base}-left")
    spark.sql(f"DROP TABLE {name}")
    return spark.read.parquet(f"{base}-left")


@query(
    "prune_proven",
    f"""
    SELECT event_id, event_type, props FROM events
    WHERE ts IS NULL OR ts >= {EVENTS_CUTOFF} OR event_type = 'error' OR event_id % 7 = 0
    """,
)
def prune_proven(spark, sf_dir):
    """Two incomplete copies: one without errors and with altered rows, one with errors
    altered. Only rows that one of them holds as they are may go."""
    df = table(spark, sf_dir, "events")
    old = expired(df, "ts", HOURS, EVENTS_AS_OF)
    other = F.concat(F.coalesce("props", F.lit("")), F.lit("?"))
    first = old.where("event_type <> 'error'").withColumn("props", F.when(F.col("event_id") % 7 == 0, other).otherwise(F.col("props")))
    second = old.where("event_type = 'error'").withColumn("props", other)
    copies = first.withColumn("destination", F.lit("a")).unionByName(second.withColumn("destination", F.lit("b")))
    kept, _ = split_proven(df, "ts", HOURS, EVENTS_AS_OF, copies)
    return kept.select("event_id", "event_type", "props")


_OLD = f"count(*) FILTER (ts < {EVENTS_CUTOFF})"
_YOUNG = f"count(*) FILTER (NOT coalesce(ts < {EVENTS_CUTOFF}, false))"


@query(
    "full_cycle",
    f"""
    SELECT 'run-1' AS run_id, {_OLD} AS succeeded, CAST(0 AS BIGINT) AS failed, {_YOUNG} AS skipped,
           {_OLD} AS backed_up, {_OLD} AS pruned, {_YOUNG} AS kept, CAST(2 AS BIGINT) AS copies,
           CAST(sum(strlen(props)) FILTER (ts < {EVENTS_CUTOFF}) AS BIGINT) AS total_bytes,
           CAST(0 AS DOUBLE) AS failure_rate
    FROM events
    """,
)
def full_cycle(spark, sf_dir):
    base = scratch_dir(spark, "cycle")
    result = backup_then_prune(
        events(spark, sf_dir),
        "ts",
        HOURS,
        EVENTS_AS_OF,
        f"{base}/kept",
        [f"{base}/a", f"{base}/b"],
        key="event_id",
        size="bytes",
        run_id="run-1",
        error_threshold_percent=10.0,
    )
    return result.to_df(spark)


def _event_files(spark: SparkSession, sf_dir: str) -> str:
    """The events as a folder of files that each hold a span of time."""
    root = f"{scratch_dir(spark, 'files')}/events"
    table(spark, sf_dir, "events").repartitionByRange(16, "ts").write.parquet(root)
    return root


@query(
    "prune_files",
    f"SELECT event_id, ts, user_id, event_type, value, props FROM events WHERE ts IS NULL OR ts >= {EVENTS_CUTOFF}",
)
def prune_by_file(spark, sf_dir):
    """File by file, in two prunes, the second over the snapshot of the first."""
    root = _event_files(spark, sf_dir)
    for as_of in (datetime(2024, 1, 25), EVENTS_AS_OF):
        prune_files(spark, root, "ts", HOURS, as_of)
    return read_snapshot(spark, root, "ts").select("event_id", "ts", "user_id", "event_type", "value", "props")


@query("full_cycle_files", ORACLES["full_cycle"])
def full_cycle_by_file(spark, sf_dir):
    root = _event_files(spark, sf_dir)
    base = scratch_dir(spark, "cycle")
    result = backup_then_prune_files(
        spark,
        root,
        "ts",
        HOURS,
        EVENTS_AS_OF,
        [f"{base}/a", f"{base}/b"],
        size=F.octet_length("props"),
        run_id="run-1",
        error_threshold_percent=10.0,
    )
    return result.to_df(spark)


@query(
    "run_once",
    f"""
    SELECT 'kept' AS place, strftime(ts, '%Y-%m-%d') AS bucket, count(*) AS items FROM events
    WHERE ts >= {EVENTS_CUTOFF} GROUP BY ALL
    UNION ALL
    SELECT 'archive', strftime(ts, '%Y-%m-%d'), count(*) FROM events
    WHERE ts < {EVENTS_CUTOFF} GROUP BY ALL
    """,
)
def one_run(spark, sf_dir):
    base = scratch_dir(spark, "once")
    result = run_once(
        spark,
        f"{sf_dir.rstrip('/')}/events.parquet",
        f"{base}/kept",
        "ts",
        HOURS,
        EVENTS_AS_OF,
        destinations=[f"{base}/vault"],
        key="event_id",
        group_by="daily",
    )
    kept = spark.read.parquet(result.kept_path).select(
        F.lit("kept").alias("place"), archive_bucket("ts").alias("bucket")
    )
    archived = open_archive(spark, f"{base}/vault").select(
        F.lit("archive").alias("place"), "bucket"
    )
    return (
        kept.unionByName(archived)
        .groupBy("place", "bucket")
        .agg(F.count(F.lit(1)).alias("items"))
    )
