"""Similarity join on word n-grams: MinHash banding, checked on the full n-gram sets.

1. One pass takes from each text the fingerprint of its n-gram set and its bands.
   Texts with the same set form a class; from here on a class is one node, however
   many copies it has. Bands and rows are chosen for the wanted recall.
2. Class and band hashes are shuffled; classes that meet in a band are linked to the
   smallest class there, a star and not all pairs, and stars that touch are put together.
3. Within such a candidate group every pair of classes is checked on full sets. Large
   groups are cut into blocks, so that a task never holds more than two blocks; what
   leaves a task is one row per class (its number of links, and its root among the
   links), not a row per pair.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierdown.llm.components import components
from tierdown.llm.words import Block, blocks, mixed, window_hashes, window_starts
from tierdown.operators.joins import skew_safe_join
from tierdown.operators.scans import written
from tierdown.scratch import scratch_dir

NGRAM = 5
SIMILARITY = 0.8
RECALL = 0.999
MOST_HASHES = 96
BLOCK_CLASSES = 256
BLOCK_NGRAMS = 1 << 20
_COLUMNS = 1 << 13  # n-grams compared at a time


def banding(similarity: float = SIMILARITY, recall: float = RECALL, most_hashes: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows that find a pair of this similarity with this probability at
    least: the most rows (fewest false meetings) that ``most_hashes`` allow."""
    best = None
    for rows in range(1, most_hashes + 1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-(similarity**rows)))) if similarity < 1 else 1
        if bands * rows <= most_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError(f"no banding of {most_hashes} hashes reaches {recall} at {similarity}")
    return best


def ngram_sets(block: Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-gram hashes of each text, sorted, and the bounds between texts.
    A text with fewer words than ``size`` has one n-gram, all its words; without words,
    none."""
    words = block.hashes()
    at = window_starts(block, size)
    grams, owner = window_hashes(words, size)[at], block.owner[at]
    short = np.flatnonzero((block.counts > 0) & (block.counts < size))
    if len(short):
        whole = [int(window_hashes(words[block.first[i] : block.first[i + 1]], int(block.counts[i]))[0]) for i in short]
        grams = np.concatenate((grams, np.array(whole, np.uint64)))
        owner = np.concatenate((owner, short))
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    if len(grams):
        new = np.concatenate(([True], (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])))
        grams, owner = grams[new], owner[new]
    return grams, np.searchsorted(owner, np.arange(len(block) + 1))


def _fingerprint(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def _signatures(ngram: int, bands: int, rows: int):
    factors = mixed(np.arange(1, bands * rows + 1, dtype=np.uint64)) | np.uint64(1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                grams, bounds = ngram_sets(block, ngram)
                full = np.flatnonzero(np.diff(bounds))
                band = np.zeros((len(full), bands), np.uint64)
                scratch = np.empty_like(grams)
                for k, factor in enumerate(factors if len(full) else ()):
                    np.multiply(grams, factor, out=scratch)
                    least = np.minimum.reduceat(scratch, bounds[full])
                    band[:, k // rows] = mixed(band[:, k // rows] ^ least)
                band = mixed(band ^ mixed(np.arange(1, bands + 1, dtype=np.uint64))).view(np.int64)
                prints = np.full(len(block), None, object)
                listed = np.full(len(block), None, object)
                for i, row in zip(full, band):
                    prints[i] = _fingerprint(grams[bounds[i] : bounds[i + 1]])
                    listed[i] = row
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(block.lo, len(block)),
                        batch.column(2).slice(block.lo, len(block)),
                        pa.array(prints, pa.binary()),
                        pa.array(np.diff(bounds).astype(np.int64)),
                        pa.array(listed, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "copy", "fp", "n_grams", "bands"],
                )

    return sign


def near_duplicates(
    documents: DataFrame,
    ngram: int = NGRAM,
    similarity: float = SIMILARITY,
    recall: float = RECALL,
    most_hashes: int = MOST_HASHES,
    block_classes: int = BLOCK_CLASSES,
    block_ngrams: int = BLOCK_NGRAMS,
) -> DataFrame:
    """One row per row of ``documents``: ``doc_id, class_id, n_links, n_grams`` and, to go
    on with, ``fp, root, copy``.

    ``n_links`` is the number of other rows whose n-gram sets have a Jaccard similarity
    of at least ``similarity``, copies included. Linked rows, also over several links,
    share ``class_id``, the smallest ``doc_id`` among them; a row without links has its
    own. ``fp`` tells rows with the same n-gram set, ``root`` those of a class (null without
    n-grams), ``copy`` is a hash of the text.

    A null text or one without words has no n-grams: no links, ``fp`` null. A text of
    fewer than ``ngram`` words counts as one n-gram. Rows with the same or a null
    ``doc_id`` are separate rows. Other columns are ignored.
    """
    spark = documents.sparkSession
    bands, rows = banding(similarity, recall, most_hashes)
    keyed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("copy"))
    at = scratch_dir(spark, "ngram-signatures")
    keyed.mapInArrow(
        _signatures(ngram, bands, rows), "doc_id long, copy long, fp binary, n_grams long, bands array<long>"
    ).write.parquet(at)
    signed = spark.read.parquet(at)
    classes = (
        signed.where("fp is not null")
        .groupBy("fp")
        .agg(
            F.count(F.lit(1)).alias("size"),
            F.min("doc_id").alias("least_id"),
            # some row that holds the set, to fetch its text by
            F.min(F.struct("doc_id", "copy")).alias("held"),
            F.first("n_grams").alias("n_grams"),
            F.first("bands").alias("bands"),
        )
    )
    at = scratch_dir(spark, "ngram-classes")
    classes.write.parquet(at)
    classes = spark.read.parquet(at)

    met = classes.select("fp", F.explode("bands").alias("band"))
    centre = met.groupBy("band").agg(F.min("fp").alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = met.join(centre, "band").where("fp <> centre").select(F.col("fp").alias("a"), F.col("centre").alias("b"))
    groups = components(stars)

    candidates = groups.withColumnRenamed("node", "fp").join(classes.drop("bands"), "fp")
    sizes = candidates.groupBy("component").agg(F.count(F.lit(1)).alias("members"), F.sum("n_grams").alias("grams"))
    parts = F.greatest(F.ceil(F.col("members") / block_classes), F.ceil(F.col("grams") / block_ngrams))
    dealt = candidates.join(sizes.select("component", parts.alias("parts")), "component").select(
        "component", "fp", "size", "parts", F.col("held.doc_id").alias("doc_id"), F.col("held.copy").alias("copy"),
        F.pmod(F.xxhash64("fp"), F.col("parts")).alias("part"),
    )
    at = scratch_dir(spark, "ngram-candidates")
    dealt.write.parquet(at)
    dealt = spark.read.parquet(at)
    # rows that repeat an id and a text become one before they are shuffled, so that each
    # print has one text from here on; ids are put so that nulls match as well
    named_by = ["copy", F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id")]
    stored = keyed.select(*named_by, "text").groupBy("copy", "id", "no_id").agg(F.first("text").alias("text"))
    # the hint gives the same plan at every size: texts are shuffled, never the table sent
    texts = stored.join(
        dealt.select(*named_by, "component", "fp", "size", "parts", "part").hint("merge"), ["copy", "id", "no_id"]
    ).select("component", "fp", "size", "parts", "part", "text")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    paired = texts.withColumn("other", other).select(
        "component", "fp", "size", "text", "parts", "part",
        F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"),
    )
    at = scratch_dir(spark, "ngram-links")
    paired.groupBy("component", "i", "j").applyInArrow(
        _linked(ngram, similarity), "fp binary, links long, root binary, alone boolean"
    ).write.parquet(at)
    linked = spark.read.parquet(at)

    # roots of groups in one block are final; those of several blocks are put together
    merged = components(linked.where("not alone").select(F.col("fp").alias("a"), F.col("root").alias("b")))
    tallied = linked.groupBy("fp").agg(F.sum("links").alias("links"), F.min("root").alias("root"))
    tallied = tallied.join(merged.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "links", F.coalesce("component", "root").alias("root")
    )
    known = classes.select("fp", "size", "least_id").join(tallied, "fp", "left")
    known = known.select("fp", "least_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("root", "fp").alias("root"))
    known = written(known.withColumn("class", F.hex("root")), "ngram-known")
    named = known.groupBy("class").agg(F.min("least_id").alias("class_id"))
    # one class may hold very many prints
    verdicts = skew_safe_join(known, named, "class").select("fp", "root", "class_id", "n_links")
    return signed.join(verdicts, "fp", "left").select(
        "doc_id",
        F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        "n_grams", "fp", "root", "copy",
    )


def one_of_each(documents: DataFrame) -> DataFrame:
    """``documents`` with one row of each class of linked rows: the one with the smallest
    ``doc_id`` (a null counts as the largest, of rows with the same id the text with the
    smallest hash, and of rows with the same text too the one whose columns, written out,
    have the smallest hash). Rows without n-grams belong to no class and all stay."""
    spark = documents.sparkSession
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "copy")
    at = scratch_dir(spark, "ngram-rows")
    # a class appears here once per id and text, with the number of such rows
    classed = near_duplicates(documents).where("root is not null").withColumn("class", F.hex("root"))
    classed.groupBy("class", "doc_id", "copy").agg(F.count(F.lit(1)).alias("n")).write.parquet(at)
    rows = spark.read.parquet(at)
    first = rows.groupBy("class").agg(F.min(rank).alias("first"), F.sum("n").alias("all")).where("all > 1")
    judged = skew_safe_join(rows, first, "class").select("doc_id", "copy", "n", (rank != F.col("first")).alias("goes"))
    at = scratch_dir(spark, "ngram-dropped")
    judged.where("goes or n > 1").select(F.col("doc_id").alias("__doc"), F.col("copy").alias("__copy"), "goes").write.parquet(at)
    judged = spark.read.parquet(at)

    def by_row(marked: DataFrame, how: str, kept: DataFrame) -> DataFrame:
        same = (F.xxhash64(kept["text"]) == marked["__copy"]) & kept["doc_id"].cast("long").eqNullSafe(marked["__doc"])
        return kept.join(marked.hint("merge"), same, how)

    dropped, repeated = judged.where("goes"), judged.where("not goes")
    kept = by_row(dropped, "left_anti", documents)
    if repeated.isEmpty():
        return kept
    # of rows alike in id and text the one that is written out with the smallest hash
    whole = F.struct(*[F.col(f"`{c}`") for c in documents.columns])
    alike = by_row(repeated, "left_semi", kept).select(
        F.col("doc_id").alias("__doc"), F.xxhash64("text").alias("__copy"), whole.alias("__row"), F.xxhash64(F.to_json(whole)).alias("__rank")
    )
    one = alike.groupBy("__doc", "__copy").agg(F.min_by("__row", "__rank").alias("__row")).select("__row.*")
    return by_row(repeated, "left_anti", kept).unionByName(one)


def _linked(ngram: int, similarity: float):
    def link(table: pa.Table) -> pa.Table:
        prints = table.column("fp").to_pylist()
        rows = list({fp: i for i, fp in reversed(list(enumerate(prints)))}.values())  # one row per class
        table = table.take(pa.array(sorted(rows)))
        prints = table.column("fp").to_pylist()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        size, part = table.column("size").to_numpy(), table.column("part").to_numpy()
        sets = []
        for block in blocks(table.column("text")):
            grams, bounds = ngram_sets(block, ngram)
            sets += [grams[s:e] for s, e in zip(bounds[:-1], bounds[1:])]
        counts = np.array([len(s) for s in sets])
        shared = _intersections(sets)
        union = counts[:, None] + counts[None, :] - shared
        near = shared >= similarity * union - 1e-9
        np.fill_diagonal(near, False)
        if i != j:  # pairs within a part are checked where i == j
            near &= part[:, None] != part[None, :]
        links = near @ size
        return pa.table(
            [
                pa.array(prints, pa.binary()),
                pa.array(links.astype(np.int64)),
                pa.array([prints[r] for r in _roots(near, prints)], pa.binary()),
                pa.array(np.full(len(prints), table.column("parts")[0].as_py() == 1)),
            ],
            names=["fp", "links", "root", "alone"],
        )

    return link


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets share. Elements of one set only are left out."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = times > 1
    number = np.cumsum(often) - 1
    wanted = often[column]
    owner, column = owner[wanted], number[column[wanted]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    together = np.zeros((n, n), np.float32)
    for begin in range(0, int(often.sum()), _COLUMNS):
        lo, hi = np.searchsorted(column, (begin, begin + _COLUMNS))
        held = np.zeros((n, _COLUMNS), np.float32)
        held[owner[lo:hi], column[lo:hi] - begin] = 1
        together += held @ held.T
    return np.rint(together).astype(np.int64)


def _roots(near: np.ndarray, prints: list[bytes]) -> np.ndarray:
    """For each node, the node with the smallest print that its links lead to."""
    order = sorted(range(len(prints)), key=prints.__getitem__)
    root, seen = np.arange(len(prints)), np.zeros(len(prints), bool)
    for start in order:
        if seen[start]:
            continue
        front = np.zeros(len(prints), bool)
        front[start] = True
        while front.any():
            seen |= front
            root[front] = start
            front = near[front].any(axis=0) & ~seen
    return root
