"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask over consecutive words: the words under its ones are hashed,
those under its zeros may differ. Seeds of test items and of documents are joined; a
meeting gives a diagonal (the shift between item and document), and along it the words
are compared one by one. An item counts as leaked where enough words of a long enough
run agree, so a few substituted words do not hide it. The four masks meet every run of
13 words with up to two substitutions, so each run that passes (11 of 13) is found. Of
items below 13 words, which pass at the same share, those of 9 and 12 words are always
found; missed are 2 of 67 patterns at 11 words, 6 of 56 at 10, 2 of 9 at 8, 5 of 8 at 7.

Built of DataFrame functions only. Positions of documents are not shuffled while the
item seeds are few enough to be broadcast, which is checked; beyond that the same join
shuffles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierdown.scratch import scratch_dir

MASKS = ("11011011", "1110111", "1111011", "11001011")
RUN = 13
AGREEMENT = 0.8
MOST_BROADCAST_SEEDS = 1_000_000  # about 50 MB


def _words(text: Column) -> Column:
    """Lower-case runs of letters, marks and digits. Of a text without any: no words."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def _shared_positions(masks: tuple[str, ...]) -> list[int]:
    """Positions that every mask looks at: the key all seeds are first met by."""
    shared = set.intersection(*({i for i, bit in enumerate(mask) if bit == "1"} for mask in masks))
    if not shared:
        raise ValueError("masks need a position in common")
    return sorted(shared)


def _positions(rows: DataFrame, keys: list[str], masks: tuple[str, ...]) -> DataFrame:
    """One row per word with the hashes of it and the words after it, ``w0`` and so on;
    beyond the end they are null."""
    span = max(map(len, masks))
    hashed = rows.select(*keys, F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    shifted = [F.col("h") if k == 0 else F.slice("h", k + 1, F.greatest(F.size("h"), F.lit(1))) for k in range(span)]
    zipped = F.arrays_zip(*(c.alias(f"w{k}") for k, c in enumerate(shifted)))
    return hashed.select(*keys, F.posexplode(zipped).alias("pos", "w")).select(
        *keys, "pos", *(F.col("w").getField(f"w{k}").alias(f"w{k}") for k in range(span))
    )


def leaked_items(
    documents: DataFrame,
    benchmark: DataFrame,
    masks: tuple[str, ...] = MASKS,
    run: int = RUN,
    agreement: float = AGREEMENT,
    most_broadcast_seeds: int = MOST_BROADCAST_SEEDS,
) -> DataFrame:
    """One row per document and item it leaks: ``doc_id, item_id, item_words,
    matched_words`` (words of the item that agree along the best diagonal) and
    ``best_run`` (most agreeing words within a run).

    Leaked: a seed meets, and on its diagonal at least ``agreement`` of some ``run``
    consecutive words agree (of all words, if the item is shorter). Items shorter than
    the masks cannot be found and are no evidence. Case and punctuation do not count. Null
    and empty texts leak nothing. Rows with the same ``doc_id`` and item are reported
    once, with their best figures; a null ``doc_id`` or ``item_id`` is kept as a value.
    Other columns are ignored.
    """
    leaks = _leaks(documents, benchmark, masks, run, agreement, most_broadcast_seeds)
    return leaks.groupBy("doc_id", "item_id").agg(
        F.max("item_words").alias("item_words"), F.max("matched_words").alias("matched_words"), F.max("best_run").alias("best_run")
    )


def clean_documents(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents`` that leak no item, with all their columns."""
    found = _leaks(documents, benchmark, MASKS, RUN, AGREEMENT, MOST_BROADCAST_SEEDS).select(
        F.col("doc_id").alias("__leaking"), F.col("copy").alias("__same")
    )
    at = scratch_dir(documents.sparkSession, "leaks")
    found.distinct().write.parquet(at)
    found = documents.sparkSession.read.parquet(at)
    same = (F.xxhash64(documents["text"]) == found["__same"]) & documents["doc_id"].cast("long").eqNullSafe(found["__leaking"])
    return documents.join(found, same, "left_anti")


def _leaks(
    documents: DataFrame, benchmark: DataFrame, masks: tuple[str, ...], run: int, agreement: float, most_broadcast_seeds: int
) -> DataFrame:
    """Leaks by row (``doc_id`` and ``copy``, a hash of the text), item and diagonal."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("copy"), _words(F.col("text")).alias("words"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), _words(F.col("text")).alias("words")).distinct()
    items = items.withColumn("item", F.xxhash64("item_id", "words"))

    shared = _shared_positions(masks)
    seed = lambda mask: [F.col(f"w{i}") for i, bit in enumerate(mask) if bit == "1"]
    whole = lambda mask: reduce(lambda x, y: x & y, (c.isNotNull() for c in seed(mask)))
    first_met = F.xxhash64(*(F.col(f"w{i}") for i in shared))
    of_items = _positions(items, ["item"], masks)
    seeds = reduce(
        DataFrame.unionByName,
        (
            of_items.where(whole(mask)).select(
                first_met.alias("met"), F.lit(n).alias("mask"), F.xxhash64(*seed(mask)).alias("seed"), "item", F.col("pos").alias("at")
            )
            for n, mask in enumerate(masks)
        ),
    ).distinct()
    if seeds.count() <= most_broadcast_seeds:
        seeds = F.broadcast(seeds)

    of_docs = _positions(docs, ["doc_id", "copy"], masks).where(F.col(f"w{shared[-1]}").isNotNull())
    here = reduce(
        lambda chain, n: chain.when((F.col("mask") == n) & whole(masks[n]), F.xxhash64(*seed(masks[n]))),
        range(1, len(masks)),
        F.when((F.col("mask") == 0) & whole(masks[0]), F.xxhash64(*seed(masks[0]))),
    )
    hits = (
        of_docs.withColumn("met", first_met)
        .join(seeds, "met")
        .where(F.col("seed") == here)
        .select("doc_id", "copy", "item", (F.col("pos") - F.col("at")).alias("shift"))
        .distinct()
    )
    # written, so that Spark knows whether the joins below can do without a shuffle
    at = scratch_dir(spark, "seed-hits")
    hits.write.parquet(at)
    hits = spark.read.parquet(at)

    sources = documents.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("same"), "text")
    # a text is taken apart once, however many hits it has; each hit goes on with the words
    # beside the item only, which are no more than the longest item has
    by_text = hits.groupBy("doc_id", "copy").agg(F.collect_list(F.struct("item", "shift")).alias("hits"))
    texts = sources.join(by_text, F.col("doc").eqNullSafe(F.col("doc_id")) & (F.col("same") == F.col("copy"))).select(
        "doc_id", "copy", "hits", _words(F.col("text")).alias("words")
    )
    longest = items.agg(F.coalesce(F.max(F.size("words")), F.lit(0))).first()[0]
    begin = F.greatest(F.lit(0), -F.col("shift"))
    near = F.slice("words", F.col("shift") + begin + 1, F.lit(longest) - begin)
    met = texts.select("doc_id", "copy", "words", F.explode("hits").alias("hit")).select("doc_id", "copy", "words", "hit.*")
    met = met.select("doc_id", "copy", "item", "shift", near.alias("near")).join(items.withColumnRenamed("words", "item_text"), "item")
    length = F.least(F.size("item_text") - begin, F.size("near"))
    equal = F.zip_with(
        F.slice("item_text", begin + 1, length), F.slice("near", F.lit(1), length), lambda a, b: F.when(a == b, 1).otherwise(0)
    )
    total = lambda values: F.aggregate(values, F.lit(0), lambda x, y: x + y)
    size = F.least(F.lit(run), F.size("item_text"))
    compared = met.select("doc_id", "copy", "item_id", F.size("item_text").cast("long").alias("item_words"), size.alias("size"), equal.alias("equal"))
    runs = F.transform(
        F.sequence(F.lit(0), F.size("equal") - F.col("size")), lambda s: total(F.slice("equal", s + 1, F.col("size")))
    )
    return (
        compared.where(F.size("equal") >= F.col("size"))
        .withColumns({"best_run": F.array_max(runs).cast("long"), "matched_words": total(F.col("equal")).cast("long")})
        .where(F.col("best_run") >= F.ceil(F.lit(agreement) * F.col("size")))
        .select("doc_id", "copy", "item_id", "item_words", "matched_words", "best_run")
    )
