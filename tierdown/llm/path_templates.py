"""URL filters by a tree of path templates for each host.

A path is a walk through the tree of its host, one segment a level.

1. *Generalise.* Runs of digits become ``{n}``. A level whose children are many and
   mostly unlike each other (``LEAST_CHILDREN`` of them, fewer than ``PAGES_A_CHILD`` pages
   each) becomes the wildcard ``*``.
2. *Merge.* Branches beside each other become one wildcard if they are statistically the
   same as all their siblings together: what hangs below them overlaps by half or more,
   and their share of blocked pages lies within a 95 % test of the siblings' share. Labels
   are few, so that share is taken from all hosts that have the branch; a branch without
   labels is judged by its shape alone.
3. *Reject.* Pages that a rule decides are the labels. A template's block share is smoothed
   towards the share of that template on all hosts, and that one towards the share of all
   labelled pages; templates above ``REJECT`` are blocked.

All of it is grouping and joining. The tree is built from distinct generalised paths with
their page counts, never from pages, and a level of a path is known by a hash of what
leads to it. The judged paths are written, so that Spark knows their size: few are
broadcast, many are joined by host and path, where adaptive execution splits a hot one.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierdown.scratch import scratch_dir

# fixed values: the rules of the contract
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
LEAST_CHILDREN = 16
PAGES_A_CHILD = 4
CHI_SQUARE = 3.84
PRIOR = 4.0
REJECT = 0.5

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    host = F.translate(F.regexp_extract(url, _URL, 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _fits(rule: str, host: str = "host", path: str = "path") -> Column:
    name, _, below = rule.partition("/")
    here = (F.col(host) == name) | F.endswith(F.col(host), F.lit(f".{name}"))
    return here & F.startswith(F.col(path), F.lit(f"/{below}"))


def ruled(urls: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """Adds ``rule`` and ``by_rule`` (allow, block or null) for ``host`` and ``path``: the
    longest rule that fits, the host of a rule standing for its subdomains too."""
    longest_first = sorted(rules, key=lambda r: -len(r[1]))
    chosen = [F.when(_fits(rule), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("by_rule"))) for verdict, rule in longest_first]
    none = F.lit(None).cast("struct<rule:string,by_rule:string>")
    return urls.withColumn("_r", F.coalesce(*chosen, none)).select("*", "_r.rule", "_r.by_rule").drop("_r")


def _levels(paths: DataFrame, path: str) -> DataFrame:
    """One row per segment, with hashes of the segments before (``above``) and behind it
    (``below``). A window holds the segments of one path."""
    split = paths.select("*", F.posexplode(F.split(path, "/", -1)).alias("level", "segment"))
    ordered = Window.partitionBy("host", path).orderBy("level")
    code = F.xxhash64("level", "segment")
    before = F.bit_xor(code).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    behind = F.bit_xor(code).over(ordered.rowsBetween(1, Window.unboundedFollowing))
    return split.select("*", F.coalesce(before, F.lit(0)).alias("above"), F.coalesce(behind, F.lit(0)).alias("below"))


def _rejoined(levels: DataFrame, path: str, name: str) -> DataFrame:
    """``host, <path>, <name>``: the segments of each path put together again."""
    segments = F.transform(F.array_sort(F.collect_list(F.struct("level", "segment"))), lambda s: s["segment"])
    return levels.groupBy("host", path).agg(F.array_join(segments, "/").alias(name))


def _written(df: DataFrame, label: str) -> DataFrame:
    at = scratch_dir(df.sparkSession, label)
    df.write.parquet(at)
    return df.sparkSession.read.parquet(at)


_COUNTS = ("n", "blocked", "labelled")


def _summed(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in _COUNTS])


def generalised(paths: DataFrame) -> DataFrame:
    """``host, shape, template`` for ``host, shape, n``: levels of many unlike children
    become ``*``."""
    levels = _levels(paths, "shape")
    children = levels.groupBy("host", "level", "above", "segment").agg(F.sum("n").alias("n"))
    variable = (
        children.groupBy("host", "level", "above")
        .agg(F.count(F.lit(1)).alias("children"), F.sum("n").alias("pages"))
        .where((F.col("children") >= LEAST_CHILDREN) & (F.col("pages") < PAGES_A_CHILD * F.col("children")))
        .select("host", "level", "above", F.lit(True).alias("variable"))
    )
    marked = levels.join(variable, ["host", "level", "above"], "left")
    return _rejoined(marked.withColumn("segment", F.when(F.col("variable"), "*").otherwise(F.col("segment"))), "shape", "template")


def merged(templates: DataFrame) -> DataFrame:
    """``host, template, merged`` for ``host, template, n, blocked, labelled``: branches
    that are like their siblings become ``*``."""
    levels = _written(_levels(templates, "template"), "levels")
    at, exact = ["host", "level", "above"], "decimal(19,0)"
    branches = levels.groupBy(*at, "segment", "below").agg(F.sum("n").alias("n"))
    whole = branches.groupBy(*at, "segment").agg(F.sum("n").alias("n_branch"))
    beside = branches.groupBy(*at, "below").agg(F.sum("n").alias("n_below"))
    siblings = branches.groupBy(*at).agg(F.sum("n").alias("n_all"))
    # what both have below, as shares n / n_branch and n_below / n_all, over one denominator
    shared = F.sum(F.least(F.col("n").cast(exact) * F.col("n_all").cast(exact), F.col("n_below").cast(exact) * F.col("n_branch").cast(exact)))
    alike = (
        branches.join(beside, [*at, "below"])
        .join(whole, [*at, "segment"])
        .join(siblings, at)
        .groupBy(*at, "segment")
        .agg((shared * 2 >= F.first(F.col("n_all").cast(exact) * F.col("n_branch").cast(exact))).alias("alike"))
    )
    # shares of blocked pages over all hosts
    branch = levels.groupBy("level", "above", "segment").agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l"))
    pool = levels.groupBy("level", "above").agg(F.sum("blocked").alias("pb"), F.sum("labelled").alias("pl"))
    share, pooled = F.col("b") / F.col("l"), F.col("pb") / F.col("pl")
    far = (share - pooled) * (share - pooled) * F.col("l") > F.lit(CHI_SQUARE) * (pooled * (F.lit(1.0) - pooled))
    unlike = branch.join(pool, ["level", "above"]).where("l > 0").where(far).select("level", "above", "segment", F.lit(True).alias("far"))
    like = alike.where("alike").drop("alike").join(unlike, ["level", "above", "segment"], "left_anti")
    groups = like.groupBy(*at).agg(F.count(F.lit(1)).alias("likes")).where("likes > 1").drop("likes")
    joined = like.join(groups, at).select(*at, "segment", F.lit(True).alias("one"))
    marked = levels.join(joined, [*at, "segment"], "left")
    return _rejoined(marked.withColumn("segment", F.when(F.col("one"), "*").otherwise(F.col("segment"))), "template", "merged")


def _smoothed(blocked: str, labelled: str, prior: str) -> Column:
    return (F.col(blocked) + F.lit(PRIOR) * F.col(prior)) / (F.col(labelled) + F.lit(PRIOR))


def path_verdicts(urls: DataFrame) -> DataFrame:
    """``host, shape, template, share, verdict`` for ``host, shape, by_rule`` of each page."""
    blocked, known = F.count_if(F.col("by_rule") == "block"), F.count("by_rule")
    paths = _written(urls.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), blocked.alias("blocked"), known.alias("labelled")), "paths")
    first = _written(paths.join(generalised(paths), ["host", "shape"]), "templates")
    second = merged(_summed(first, "host", "template"))
    final = _written(first.join(second, ["host", "template"]).drop("template"), "merged")
    prior = final.agg((F.coalesce(F.sum("blocked"), F.lit(0)) + F.lit(1.0)) / (F.coalesce(F.sum("labelled"), F.lit(0)) + F.lit(2.0))).first()[0]
    anywhere = _summed(final, "merged").withColumn("prior", F.lit(prior))
    anywhere = anywhere.select("merged", _smoothed("blocked", "labelled", "prior").alias("share_anywhere"))
    here = _summed(final, "host", "merged").join(anywhere, "merged")
    judged = here.select("host", "merged", _smoothed("blocked", "labelled", "share_anywhere").alias("share"))
    verdict = F.when(F.col("share") > REJECT, "block").otherwise("allow").alias("by_template")
    return final.select("host", "shape", "merged").join(judged, ["host", "merged"]).select("host", "shape", F.col("merged").alias("template"), "share", verdict)


def judged_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """One row per row of ``pages``: ``page_id, host, path, rule, verdict, template, share``.

    A null ``url``, or one without ``://``, has an empty host and path, and is judged by the
    template of the empty path. Repeated rows are rows of their own and count as pages of
    their own. Other columns are ignored. If no rule decides a page, all shares are equal
    and every page is allowed, the prior being one half.
    """
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = ruled(urls, rules).withColumn("shape", F.regexp_replace("path", "[0-9]+", "{n}"))
    verdicts = _written(path_verdicts(urls.select("host", "shape", "by_rule")), "verdicts")
    found = urls.join(verdicts, ["host", "shape"], "left")
    return found.select("page_id", "host", "path", "rule", F.coalesce("by_rule", "by_template").alias("verdict"), "template", "share")


def _rule_sql(rules: Sequence[tuple[str, str]], verdict: bool) -> str:
    cases = []
    for says, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, _, below = rule.partition("/")
        then = says if verdict else rule
        cases.append(f"WHEN (host = '{name}' OR suffix(host, '.{name}')) AND prefix(path, '/{below}') THEN '{then}'")
    return f"CASE {' '.join(cases)} END"


def _rejoined_sql(rows: str, path: str, name: str) -> str:
    return f"SELECT host, {path}, array_to_string(list(segment ORDER BY level), '/') AS {name} FROM {rows} GROUP BY host, {path}"


def _levels_sql(rows: str, path: str) -> str:
    return f"""SELECT *, segments[level + 1] AS segment, segments[1:level] AS above, segments[level + 2:] AS below FROM (
      SELECT *, unnest(range(len(segments))) AS level FROM (SELECT *, string_split({path}, '/') AS segments FROM {rows}))"""


SQL = rf"""
WITH cut AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '{_URL}', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '') AS host,
         coalesce(regexp_extract(url, '{_URL}', 2), '') AS path
  FROM pages
), urls AS (
  SELECT *, {_rule_sql(RULES, False)} AS rule, {_rule_sql(RULES, True)} AS by_rule, regexp_replace(path, '[0-9]+', '{{n}}', 'g') AS shape FROM cut
), paths AS (
  SELECT host, shape, count(*) AS n, count(*) FILTER (by_rule = 'block') AS blocked, count(by_rule) AS labelled FROM urls GROUP BY ALL
), levels AS ({_levels_sql("paths", "shape")}
), variable AS (
  SELECT host, level, above FROM (SELECT host, level, above, segment, sum(n) AS n FROM levels GROUP BY ALL)
  GROUP BY ALL HAVING count(*) >= {LEAST_CHILDREN} AND sum(n) < {PAGES_A_CHILD} * count(*)
), marked AS (
  SELECT l.* REPLACE (CASE WHEN v.host IS NULL THEN segment ELSE '*' END AS segment) FROM levels l LEFT JOIN variable v USING (host, level, above)
), first AS (SELECT * FROM paths JOIN ({_rejoined_sql("marked", "shape", "template")}) USING (host, shape)
), templates AS (SELECT host, template, sum(n) AS n, sum(blocked) AS blocked, sum(labelled) AS labelled FROM first GROUP BY ALL
), levels2 AS ({_levels_sql("templates", "template")}
), branches AS (SELECT host, level, above, segment, below, sum(n)::HUGEINT AS n FROM levels2 GROUP BY ALL
), compared AS (
  SELECT *, sum(n) OVER (PARTITION BY host, level, above, segment)::HUGEINT AS n_branch,
         sum(n) OVER (PARTITION BY host, level, above, below)::HUGEINT AS n_below, sum(n) OVER (PARTITION BY host, level, above)::HUGEINT AS n_all
  FROM branches
), alike AS (
  SELECT host, level, above, segment FROM compared GROUP BY ALL
  HAVING sum(least(n * n_all, n_below * n_branch)) * 2 >= any_value(n_all * n_branch)
), branch AS (SELECT level, above, segment, sum(blocked)::DOUBLE AS b, sum(labelled)::DOUBLE AS l FROM levels2 GROUP BY ALL
), pool AS (SELECT level, above, sum(blocked)::DOUBLE AS pb, sum(labelled)::DOUBLE AS pl FROM levels2 GROUP BY ALL
), unlike AS (
  SELECT level, above, segment FROM (SELECT *, b / l AS s, pb / pl AS p FROM branch JOIN pool USING (level, above) WHERE l > 0)
  WHERE (s - p) * (s - p) * l > {CHI_SQUARE}::DOUBLE * (p * (1.0::DOUBLE - p))
), likes AS (SELECT *, count(*) OVER (PARTITION BY host, level, above) AS likes FROM (SELECT * FROM alike ANTI JOIN unlike USING (level, above, segment))
), marked2 AS (
  SELECT l.* REPLACE (CASE WHEN k.host IS NULL THEN segment ELSE '*' END AS segment)
  FROM levels2 l LEFT JOIN (SELECT * FROM likes WHERE likes > 1) k USING (host, level, above, segment)
), final AS (SELECT * FROM first JOIN ({_rejoined_sql("marked2", "template", "merged")}) USING (host, template)
), prior AS (SELECT (coalesce(sum(blocked), 0)::DOUBLE + 1.0::DOUBLE) / (coalesce(sum(labelled), 0)::DOUBLE + 2.0::DOUBLE) AS prior FROM final
), anywhere AS (
  SELECT merged, (sum(blocked)::DOUBLE + {PRIOR}::DOUBLE * any_value(prior)) / (sum(labelled)::DOUBLE + {PRIOR}::DOUBLE) AS share_anywhere
  FROM final, prior GROUP BY merged
), judged AS (
  SELECT host, merged, (sum(blocked)::DOUBLE + {PRIOR}::DOUBLE * any_value(share_anywhere)) / (sum(labelled)::DOUBLE + {PRIOR}::DOUBLE) AS share
  FROM final JOIN anywhere USING (merged) GROUP BY host, merged
)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN share > {REJECT}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict,
       merged AS template, share
FROM urls LEFT JOIN (SELECT host, shape, merged FROM final) f USING (host, shape) LEFT JOIN judged USING (host, merged)
"""
