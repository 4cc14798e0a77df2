"""Repeated word passages, found through difference-cover anchors.

Two texts that share a run of ``window`` words share, for some shift of less than
``period`` words, a position that lies on the cover in *both* of them, since every
residue is a difference of two members of the cover. So it is enough to hash the
``window - period + 1`` words at cover positions (3 of every 7): whatever shares a
whole window shares such an anchor. Anchors that only one document has rule out every
window around them; where an anchor is shared, the match is extended to full windows,
which are compared as such.

Everything stays on the cluster. Texts are dealt once into chunks of bounded size;
anchors and windows are grouped by their hash with one row per hash and chunk, so that
a passage in a third of all documents is a few rows and not a third of all rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierdown.llm.words import blocks, covered, window_hashes, window_starts

WINDOW = 13
PERIOD = 7
COVER = (1, 2, 4)  # the differences of these give every residue modulo 7
CHUNK_BYTES = 16 << 20


def removed_passages(
    documents: DataFrame,
    window: int = WINDOW,
    period: int = PERIOD,
    cover: tuple[int, ...] = COVER,
    chunk_bytes: int = CHUNK_BYTES,
    with_text: bool = False,
) -> DataFrame:
    """Removes every word covered by a run of ``window`` words that also begins in a
    document with a smaller ``doc_id``. Decisions are taken on the input as it is.

    Returns one row per row of ``documents``: ``doc_id, n_words, n_removed,
    kept_sha256`` and, if asked for, ``kept_text`` (kept words joined by one space).

    A null or empty text has no words; a text shorter than the window loses none. A
    null ``doc_id`` is neither smaller nor larger than anything: such a row keeps all
    its words and takes none from others. Rows with the same ``doc_id`` do not take
    from each other. Other columns are ignored; an empty table gives no rows.
    """
    uncovered = [d for d in range(period) if not any((a - b) % period == d for a in cover for b in cover)]
    if uncovered or not 0 < period <= window:
        raise ValueError(f"not a difference cover of {period} for runs of {window}: {cover}")
    anchor = window - period + 1
    on_cover = np.zeros(period, bool)
    on_cover[list(cover)] = True

    texts = _chunked(documents, chunk_bytes)
    anchor_row, window_row = "h long, held long", "h long, held long, lo long"

    def anchors(table: pa.Table) -> pa.Table:
        found = []
        for block, ids in _numbered(table):
            h, at = _anchor_hashes(block, anchor, on_cover)
            found.append((h, ids[block.owner[at]]))
        return _held(table, found).drop_columns(["lo"])

    def windows(table: pa.Table, shared: pa.Table) -> pa.Table:
        wanted = np.sort(shared.column("h").to_numpy().view(np.uint64))
        found = []
        for block, ids in _numbered(table):
            if not len(wanted):
                break
            h, at = _anchor_hashes(block, anchor, on_cover)
            hits = np.zeros(len(block.starts) + period, np.int64)
            hits[at[_among(h, wanted)]] = 1
            near = np.concatenate(([0], np.cumsum(hits)))
            begins = window_starts(block, window)
            begins = begins[near[begins + period] > near[begins]]
            full = window_hashes(block.hashes(), window)
            found.append((full[begins], ids[block.owner[begins]]))
        return _held(table, found)

    def kept(table: pa.Table, repeated: pa.Table) -> pa.Table:
        order = np.argsort(repeated.column("h").to_numpy().view(np.uint64))
        wanted = repeated.column("h").to_numpy().view(np.uint64)[order]
        owner = repeated.column("lo").to_numpy()[order]
        ids = table.column("doc_id").combine_chunks()
        known, numbers = _ids(ids)
        rows = []
        for block in blocks(table.column("text")):
            words = len(block.starts)
            gone = np.zeros(words, bool)
            begins = window_starts(block, window)
            if len(wanted) and len(begins):
                full = window_hashes(block.hashes(), window)[begins]
                place = np.minimum(np.searchsorted(wanted, full), len(wanted) - 1)
                text = block.lo + block.owner[begins]
                again = (wanted[place] == full) & known[text] & (owner[place] < numbers[text])
                gone = covered(begins[again], window, words)
            rows.append((block.counts, block.per_text(gone), list(_joined(block, ~gone))))
        count = lambda i: pa.array(np.concatenate([r[i] for r in rows]) if rows else [], pa.int64())
        whole = [text for r in rows for text in r[2]]
        digests = [hashlib.sha256(text).hexdigest() for text in whole]
        columns = [ids, count(0), count(1), pa.array(digests, pa.string())]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if with_text:
            columns.append(pa.array([text.decode("utf-8", "replace") for text in whole], pa.string()))
            names.append("kept_text")
        return pa.table(columns, names=names)

    by_chunk = texts.groupBy("chunk")
    # a hash has at most one row per chunk here, however many documents hold it
    of_hash = Window.partitionBy("h")
    several = (F.count(F.lit(1)).over(of_hash) > 1) | (F.col("held") % 2 == 1)
    chunk = F.shiftright("held", 1).alias("chunk")
    shared = by_chunk.applyInArrow(anchors, anchor_row).withColumn("several", several).where("several").select(chunk, "h")
    repeated = (
        by_chunk.cogroup(shared.groupBy("chunk")).applyInArrow(windows, window_row)
        .withColumns({"least": F.min("lo").over(of_hash), "several": several})
        # the chunk that only has the first holder has nothing to remove
        .where("several and (held % 2 = 1 or least < lo)")
        .select(chunk, "h", F.col("least").alias("lo"))
    )
    result = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return by_chunk.cogroup(repeated.groupBy("chunk")).applyInArrow(kept, result)


def _chunked(documents: DataFrame, chunk_bytes: int) -> DataFrame:
    """Deals the texts into chunks of about ``chunk_bytes``; their number follows the data."""
    total = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = max(2 * partitions, total // chunk_bytes)
    doc_id, text = F.col("doc_id").cast("long"), F.col("text")
    # rows that repeat an id and a text go different ways by the task that reads them, so
    # that no number of them makes a chunk large; a task that is tried again has its number
    place = F.xxhash64(doc_id, text, F.spark_partition_id())
    return documents.select(F.pmod(place, F.lit(chunks)).alias("chunk"), doc_id.alias("doc_id"), "text")


def _ids(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    known = np.asarray(ids.is_valid())
    return known, ids.fill_null(0).to_numpy(zero_copy_only=False)


def _numbered(table: pa.Table) -> Iterator:
    """Blocks of the rows that have a ``doc_id``, with these ids."""
    table = table.filter(table.column("doc_id").is_valid())
    numbers = table.column("doc_id").to_numpy()
    for block in blocks(table.column("text")):
        yield block, numbers[block.lo : block.hi]


def _anchor_hashes(block, size: int, on_cover: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words at cover positions, and where they begin.
    Positions count from the start of each text."""
    at = window_starts(block, size)
    at = at[on_cover[(at - block.first[block.owner[at]]) % len(on_cover)]]
    return window_hashes(block.hashes(), size)[at], at


def _among(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(wanted):
        return np.zeros(len(values), bool)
    return wanted[np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)] == values


def _held(table: pa.Table, found: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    """One row per hash: the chunk with, in the lowest bit, whether more than one
    ``doc_id`` of it holds the hash, and the smallest of them."""
    h = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.uint64)
    ids = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
    order = np.lexsort((ids, h))
    h, ids = h[order], ids[order]
    new = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    last = np.concatenate((new[1:], [len(h)])) - 1 if len(h) else new
    h, lo, several = h[new], ids[new], ids[new] < ids[last]
    # in document order, where neighbouring rows compress well
    order = np.argsort(lo, kind="stable")
    chunk = table.column("chunk")[0].as_py() if len(table) else 0
    return pa.table([h[order].view(np.int64), 2 * chunk + several[order].astype(np.int64), lo[order]], names=["h", "held", "lo"])


def _joined(block, keep: np.ndarray) -> Iterator[bytes]:
    """For each text, its kept words with one space between."""
    data = block.data.copy()
    inside = np.zeros(len(data) + 1, np.int32)
    stop = np.minimum(block.ends + 1, np.repeat(block.bounds[1:], block.counts))
    data[block.ends[block.ends < stop]] = 0x20
    inside[block.starts[keep]] += 1
    np.subtract.at(inside, stop[keep], 1)
    inside = np.cumsum(inside[:-1]) > 0
    out = data[inside]
    cut = np.concatenate(([0], np.cumsum(inside)))[block.bounds]
    for begin, end in zip(cut[:-1], cut[1:]):
        text = out[begin:end].tobytes()
        yield text[:-1] if text.endswith(b" ") else text
