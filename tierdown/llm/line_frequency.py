"""Line deduplication by how usual a line is within its site.

For each host, the pages that hold a line are counted (a page counts once, however
often it repeats the line) and divided by the pages of the host. Lines above the
boilerplate ratio are dropped from every page of that host.

Only hashes of lines are shuffled, summed up before they are. What is left per host is
a short list: with ratio r a host of n-line pages has at most n / r such lines.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierdown.scratch import scratch_dir

RATIO = 0.1
LEAST_PAGES = 5


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def drop_boilerplate_lines(
    pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES
) -> DataFrame:
    """``pages`` with ``text`` cleaned, and ``n_lines``, ``n_dropped`` (replaced if there).

    A line goes if more than ``ratio`` of the host's pages, and at least ``least_pages``
    of them, hold it; so a host with fewer pages loses nothing. Lines are compared as
    they are (by 64-bit hash); blank ones are never dropped. A null text stays null with
    no lines and still counts as a page; a page that loses all its lines has an empty
    text. Pages without a host are left alone. Repeated rows count as pages of their own.
    All other columns stay as they are.
    """
    spark = pages.sparkSession
    site, line, seen = (f"__{name}_{uuid.uuid4().hex[:8]}" for name in ("site", "line", "seen"))
    worded = F.filter(_lines(F.col(text)), lambda x: x.rlike(r"\S"))
    hashes = F.array_distinct(F.transform(worded, lambda x: F.xxhash64(x)))
    sited = pages.where(F.col(host).isNotNull())
    totals = sited.groupBy(F.col(host).alias(site)).agg(F.count(F.lit(1)).alias("pages"))
    usual = (
        sited.select(F.col(host).alias(site), F.explode(hashes).alias(line))
        .groupBy(site, line)
        .agg(F.count(F.lit(1)).alias("held"))
        .where(F.col("held") >= least_pages)
        .join(totals, site)
        .where(F.col("held") > F.lit(float(ratio)) * F.col("pages"))
        .groupBy(site)
        .agg(F.collect_list(line).alias(seen))
    )
    # written first, so that Spark knows its size: a small table is broadcast, a large
    # one is joined by host, where adaptive execution splits hot hosts
    at = scratch_dir(spark, "usual-lines")
    usual.write.parquet(at)
    usual = spark.read.parquet(at)

    joined = pages.join(usual, F.col(host) == F.col(site), "left").drop(site)
    lines = _lines(F.col(text))
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col(seen), F.xxhash64(x)) | ~x.rlike(r"\S"))
    kept = F.when(F.col(seen).isNull(), lines).otherwise(kept)
    cleaned = joined.withColumns(
        {
            "n_lines": F.coalesce(F.size(lines), F.lit(0)).cast("long"),
            "n_dropped": F.coalesce(F.size(lines) - F.size(kept), F.lit(0)).cast("long"),
        }
    )
    return cleaned.withColumn(text, F.when(F.col(seen).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))).drop(seen)


SQL = rf"""
WITH lines AS (
  SELECT source, unnest(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S')))) AS line
  FROM documents WHERE source IS NOT NULL
), totals AS (
  SELECT source, count(*) AS pages FROM documents WHERE source IS NOT NULL GROUP BY source
), usual AS (
  SELECT source, list(line) AS seen FROM (
    SELECT l.source, l.line FROM lines l JOIN totals t ON l.source = t.source
    GROUP BY l.source, l.line, t.pages
    HAVING count(*) >= {LEAST_PAGES} AND count(*) > {RATIO}::DOUBLE * t.pages
  ) GROUP BY source
), cut AS (
  SELECT d.doc_id, d.source, string_split(d.text, chr(10)) AS lines,
         list_filter(string_split(d.text, chr(10)), lambda x: NOT list_contains(coalesce(u.seen, []), x)) AS kept
  FROM documents d LEFT JOIN usual u ON d.source = u.source
)
SELECT doc_id, source, array_to_string(kept, chr(10)) AS text,
       coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(len(lines) - len(kept), 0)::BIGINT AS n_dropped
FROM cut
"""
