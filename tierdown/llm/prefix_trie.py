"""The trie of conversation prefixes, as node tables under minimal perfect hashes.

Every prefix of a conversation has a 128-bit digest: the exclusive or of hashes of
(depth, role, text), so it comes out of a running scan that no long conversation can
overload. Distinct digests are the nodes, found by grouping; a third hash of the last
turn must be the same in all rows of a node, which proves by induction over the depth
that no two sequences share a digest.

Totals over subtrees need each node's ancestors. These are the prefixes of its smallest
member, so whole conversations are dealt to shards. A shard puts its distinct digests
into a ``SlotTable``, scatters what the nodes own into flat arrays by slot, and adds each
slot to its parent's, deepest first. A node that several shards hold gets the sum of
theirs: whatever is owned is owned in one shard, so it does not matter how conversations
are dealt, and a first turn that a third of them share is summed up in every shard before
it meets itself. Conversations of more than ``BLOCK`` turns are cut; what lies below a cut is
put on the last turn before it.

The conversations that end in a node are written into pieces by range-partitioned tasks;
only the SHA-256 over the pieces, sequential by nature, is one stream per node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierdown.llm.slot_table import SlotTable, distinct
from tierdown.operators.joins import skew_safe_join
from tierdown.operators.scans import PART, ROW, SLICE, running, sliced, totals_before, written

BLOCK = 4096
SHARD_ROWS = 200_000
FAMILY = 20
MOST_SHARED = 3
WORD = r"[^\x20\x09-\x0D]++"


class DigestCollision(RuntimeError):
    """Two different prefixes have one digest."""


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, at, code, words``: the turns of each conversation, numbered from 1."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text")
    )
    code = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    kept = ["conv_id", code.alias("code"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words")]
    cut = sliced(rows, ["conv_id"], ["turn", "role", "text"], kept=kept)
    return running(cut, {"at": ("sum", F.lit(1).cast("long"))}).select("conv_id", "at", "code", "words")


def rebuilt(numbered: DataFrame) -> DataFrame:
    """``conv_id, depth, code, words``: the first turns taken from the head of the family.

    ``h`` turns, as the contract's checksum says, come from conversation ``c - c % 20``, and
    the first ``h`` of its own are left out.
    """
    conv = F.col("conv_id")
    base, shared = conv - conv % FAMILY, F.crc32(conv.cast("string")) % (MOST_SHARED + 1)
    heads = numbered.where((conv % FAMILY == 0) & (F.col("at") <= MOST_SHARED)).withColumnRenamed("conv_id", "base")
    lengths = heads.groupBy("base").agg(F.count(F.lit(1)).alias("length"))
    own = numbered.withColumns({"base": base, "h": shared}).where("at > h").join(lengths, "base", "left")
    own = own.withColumn("depth", F.col("at") - F.col("h") + F.least("h", F.coalesce("length", F.lit(0))))
    every = numbered.select("conv_id").distinct().withColumns({"base": base, "h": shared})
    taken = every.join(heads, "base").where("at <= h").withColumn("depth", F.col("at"))
    columns = ["conv_id", "depth", "code", "words"]
    return own.select(*columns).unionByName(taken.select(*columns))


def _hashes(depth: Column, code: Column) -> list[Column]:
    return [F.xxhash64(F.lit(lane), depth.cast("long"), code) for lane in range(3)]


def prefixes(turns_: DataFrame, every: DataFrame, block: int = BLOCK) -> DataFrame:
    """``conv_id, depth, hi, lo, parent_hi, parent_lo, witness, words`` for each conversation
    of ``every`` and each of its prefixes, the root (depth 0, digest 0) first."""
    hi, lo, witness = _hashes(F.col("depth"), F.col("code"))
    rows = turns_.select(
        "conv_id", "depth", "words", hi.alias("one_hi"), lo.alias("one_lo"), witness.alias("witness"),
        F.struct("conv_id").alias(PART), F.floor(F.col("depth") / block).cast("int").alias(SLICE), F.col("depth").alias(ROW),
    )
    summed = running(rows, {"hi": ("xor", F.col("one_hi")), "lo": ("xor", F.col("one_lo"))})
    found = summed.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "hi", "lo",
        F.col("hi").bitwiseXOR(F.col("one_hi")).alias("parent_hi"), F.col("lo").bitwiseXOR(F.col("one_lo")).alias("parent_lo"), "witness", "words",
    )
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    values = (zero.alias("depth"), zero.alias("hi"), zero.alias("lo"), none.alias("parent_hi"), none.alias("parent_lo"), zero.alias("witness"), zero.alias("words"))
    return found.unionByName(every.select("conv_id", *values))


def nodes_of(paths: DataFrame) -> DataFrame:
    """One row per distinct digest, with the number of its conversations and children."""
    same = [F.min(c).alias(c) for c in ("depth", "parent_hi", "parent_lo", "words", "witness")]
    grouped = paths.groupBy("hi", "lo").agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), *same, F.max("witness").alias("other_witness"), F.max("depth").alias("other_depth")
    )
    nodes = written(grouped, "nodes")
    if not nodes.where("witness <> other_witness or depth <> other_depth").isEmpty():
        raise DigestCollision("two different prefixes have one digest")
    children = nodes.where("depth > 0").groupBy(F.col("parent_hi").alias("hi"), F.col("parent_lo").alias("lo")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.drop("witness", "other_witness", "other_depth").join(children, ["hi", "lo"], "left")
    return nodes.withColumn("n_children", F.coalesce("n_children", F.lit(0)))


_SUMS = ("leaves", "saved")
_SHARD_COLUMNS = ("hi", "lo", "parent_hi", "parent_lo", "depth", *_SUMS)


def accumulated(block: int, hi, lo, parent_hi, parent_lo, depth, *owned) -> tuple[SlotTable, list[np.ndarray]]:
    """Totals over the subtrees of one shard: arrays of its rows in, arrays by slot out.

    Rows of one digest are of one depth and one parent. A row whose parent is not in the
    shard, as before a cut or at the root, passes nothing on.
    """
    table = SlotTable(*distinct(hi, lo))
    slot = table.slots(hi, lo)
    parent = np.full(len(table), -1, np.int64)
    parent[slot] = np.where(depth % block == 0, -1, table.slots(parent_hi, parent_lo))
    level = np.zeros(len(table), np.int64)
    level[slot] = depth
    totals = [np.zeros(len(table), np.int64) for _ in owned]
    for total, values in zip(totals, owned):
        np.add.at(total, slot, values)
    order = np.argsort(-level, kind="stable")
    bounds = np.flatnonzero(np.diff(level[order])) + 1
    for here in np.split(order, bounds):  # deepest first
        up = here[parent[here] >= 0]
        for total in totals:
            np.add.at(total, parent[up], total[up])
    return table, totals


def _shards(batches: Iterator[pa.RecordBatch], block: int, shard_rows: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and block: cut into shards of about ``shard_rows`` between
    two of them, so that memory follows the shard."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= shard_rows:
            table = pa.Table.from_batches(held).combine_chunks()
            unit = [table.column(n).to_numpy() for n in (0, 1)]
            last = int(np.flatnonzero((unit[0] != unit[0][-1]) | (unit[1] != unit[1][-1]))[-1] + 1) if _several(unit) else 0
            if last:
                yield _totals(table.slice(0, last), block)
            held = table.slice(last).to_batches()
            rows = table.num_rows - last
    if held:
        yield _totals(pa.Table.from_batches(held), block)


def _several(unit: list[np.ndarray]) -> bool:
    return bool((unit[0] != unit[0][-1]).any() or (unit[1] != unit[1][-1]).any())


def _totals(table: pa.Table, block: int) -> pa.RecordBatch:
    columns = [table.column(n).fill_null(0).to_numpy() for n in range(2, 2 + len(_SHARD_COLUMNS))]
    digests = [np.ascontiguousarray(c).view(np.uint64) for c in columns[:4]]
    slots, totals = accumulated(block, *digests, *columns[4:])
    arrays = [pa.array(a.view(np.int64)) for a in (slots.hi, slots.lo)] + [pa.array(t) for t in totals]
    return pa.RecordBatch.from_arrays(arrays, names=["hi", "lo", *_SUMS])


def subtree_totals(paths: DataFrame, nodes: DataFrame, block: int = BLOCK, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``hi, lo, leaves, saved``: what each node's subtree owns."""
    saved = (F.col("n_convs") - 1) * F.col("words")
    owned = nodes.select("conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("leaves"), saved.alias("saved"))
    owners = owned.select("conv_id").distinct()
    number = F.floor(F.col("depth") / block).cast("int")
    rows = paths.select("conv_id", "depth", "hi", "lo", "parent_hi", "parent_lo").join(owners, "conv_id", "left_semi")
    rows = rows.join(owned, ["conv_id", "depth"], "left").fillna(0, list(_SUMS)).withColumn("block", number)

    # blocks behind a cut, added up from the last one, go to the row before the cut
    per_block = owned.groupBy(F.struct("conv_id").alias(PART), (-number).alias(SLICE)).agg(*[F.sum(c).alias(c) for c in _SUMS])
    behind = totals_before(written(per_block, "blocks"), dict.fromkeys(_SUMS, "sum"))
    behind = behind.select(F.col(f"{PART}.conv_id").alias("conv_id"), (-F.col(SLICE)).alias("block"), *_SUMS).where("leaves > 0 or saved > 0")
    ends = rows.where(F.col("depth") % block == block - 1).drop(*_SUMS)
    rows = rows.unionByName(ends.join(behind, ["conv_id", "block"]))

    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    dealt = rows.withColumn("family", family).repartition("family", "block").sortWithinPartitions("family", "conv_id", "block")
    schema = f"hi long, lo long, {', '.join(f'{c} long' for c in _SUMS)}"
    partial = dealt.select("conv_id", "block", *_SHARD_COLUMNS).mapInArrow(lambda batches: _shards(batches, block, shard_rows), schema)
    return partial.groupBy("hi", "lo").agg(*[F.sum(c).alias(c) for c in _SUMS])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ``hi, lo, conv_id`` to ``hi, lo, first, ids``: the ids of one node in a batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        hi, lo, conv = (c.to_numpy() for c in batch.columns)
        starts = np.concatenate(([0], np.flatnonzero((hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])) + 1))
        ends = [*starts[1:], len(hi)]
        ids = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(starts, ends)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(hi[starts]), pa.array(lo[starts]), pa.array(conv[starts]), pa.array(ids, pa.string())], names=["hi", "lo", "first", "ids"]
        )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to one hash per node, piece by piece."""
    node, digest = None, None

    def out(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in enumerate(types)], names=["hi", "lo", "ends_sha256"])

    for batch in batches:
        done = []
        for hi, lo, _, ids in zip(*[c.to_pylist() for c in batch.columns]):
            if node == (hi, lo):
                digest.update(f",{ids}".encode())
                continue
            if node is not None:
                done.append((*node, digest.hexdigest()))
            node, digest = (hi, lo), hashlib.sha256(ids.encode())
        yield out(done)
    if node is not None:
        yield out([(*node, digest.hexdigest())])


def end_digests(paths: DataFrame) -> DataFrame:
    """``hi, lo, ends_sha256`` of nodes that are the whole of some conversation."""
    last = paths.groupBy("conv_id").agg(F.max_by(F.struct("hi", "lo"), "depth").alias("end")).select("end.*", "conv_id")
    ordered = last.repartitionByRange("hi", "lo", "conv_id").sortWithinPartitions("hi", "lo", "conv_id")
    pieces = ordered.mapInArrow(_pieces, "hi long, lo long, first long, ids string")
    return pieces.repartition("hi", "lo").sortWithinPartitions("hi", "lo", "first").mapInArrow(_digests, "hi long, lo long, ends_sha256 string")


def prefix_nodes(conversations: DataFrame, block: int = BLOCK, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens`` (long) and ``ends_sha256``.

    Rows with a null ``conv_id`` belong to no conversation and are left out. Rows of one turn
    are in the order of role and text; repeated rows are turns of their own. A null role or
    text is empty. Other columns are ignored. An empty table has no conversation and no node,
    not even the root.
    """
    numbered = written(turns(conversations), "turns")
    every = numbered.select("conv_id").distinct()
    paths = written(prefixes(rebuilt(numbered), every, block), "paths")
    nodes = written(nodes_of(paths), "trie")
    found = nodes.join(subtree_totals(paths, nodes, block, shard_rows), ["hi", "lo"]).join(end_digests(paths), ["hi", "lo"], "left")
    # the root and common first turns are the parent of very many
    key = lambda hi, lo: F.concat_ws(":", F.col(hi).cast("string"), F.col(lo).cast("string"))
    parents = nodes.where("n_children > 0").select(key("hi", "lo").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    found = written(found.withColumn("parent", F.when(F.col("depth") > 0, key("parent_hi", "parent_lo"))), "totals")
    found = skew_safe_join(found, parents, "parent", "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
