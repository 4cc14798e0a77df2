"""Restoring a few keys without opening the whole archive.

Beside its containers an archive can keep an index of one key: for each file the range of
its keys and a Bloom filter over them, in blocks. It is built in one pass over the key
column, without a shuffle of the keys. A lookup joins the wanted keys with the blocks
they would fall into, and only files whose block has all their bits are opened.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierdown.operators.joins import small_enough
from tierdown.operators.restoring import latest_copies
from tierdown.plans.containers import RUN, open_archive
from tierdown.plans.folders import exists
from tierdown.sources.inventory import file_inventory

#: a block has 2^15 bits; a filter has a power of two of blocks, with 12 to 24 bits a key
_BLOCK_BITS = 1 << 15
_BITS_PER_KEY = 12
_HASHES = 6
#: filters of fewer than 2^_LEVELS blocks, which is 5 * 10^9 keys in one part of a file
_LEVELS = 21
#: up to so many wanted keys go to every task as literals of the scan
_MOST_LITERALS = 1_000
#: keys of one part of a file that are held before they become a filter of their own
_MOST_KEYS = 1 << 20


def _index_path(root: str, key: str) -> str:
    # Spark passes over folders like this one when it lists the archive
    return f"{root.rstrip('/')}/_index/of-{key}"


def _index_schema(key_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("file_uri", T.StringType()),
            T.StructField("least", key_type),
            T.StructField("most", key_type),
            T.StructField("slot", T.LongType()),
            T.StructField("bits", T.BinaryType()),
        ]
    )


def _blocks(place: np.ndarray, code: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(slot, bits) of each block that is not empty. Slots number the blocks of filters of
    2^n blocks from 2^n on, so that one number says both."""
    blocks = 1
    while blocks * _BLOCK_BITS < _BITS_PER_KEY * len(place):
        blocks *= 2
    block = place & (blocks - 1)
    first, step = code & (_BLOCK_BITS - 1), (code >> 15) & (_BLOCK_BITS - 1) | 1
    at = (first[:, None] + step[:, None] * np.arange(_HASHES)) & (_BLOCK_BITS - 1)
    order = np.argsort(block, kind="stable")
    block, at = block[order], at[order]
    begins = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    for begin, end in zip(begins, [*begins[1:], len(block)]):
        bits = np.zeros(_BLOCK_BITS, np.uint8)
        bits[at[begin:end].ravel()] = 1
        yield blocks + int(block[begin]), np.packbits(bits, bitorder="little").tobytes()


def index_keys(spark: SparkSession, root: str, key: str, run_id: str, schema: T.StructType | None = None) -> None:
    """Index the containers of one run by ``key``; called again, it replaces that index.

    A file that several tasks read has several filters. Rows without a key are not
    indexed, since no key finds them.
    """
    archive = open_archive(spark, root, schema).where(F.col(RUN) == run_id)
    out = _index_schema(archive.schema[key].dataType)
    keyed = archive.where(F.col(key).isNotNull()).select(
        F.col("_metadata.file_path").alias("file_uri"), F.col(key).alias("key"),
        F.xxhash64(key).alias("place"), F.xxhash64(key, F.lit(1)).alias("code"),
    )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def filters() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            span = pc.min_max(rows.column("key"))
            found = list(_blocks(*(rows.column(n).to_numpy() for n in ("place", "code"))))
            names, n = out.names, len(found)
            same = [pa.array([rows.column("file_uri")[0].as_py()] * n, pa.string())]
            same += [pa.array([span[end].as_py()] * n, rows.schema.field("key").type) for end in ("min", "max")]
            blocks = [pa.array([slot for slot, _ in found], pa.int64()), pa.array([bits for _, bits in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([*same, *blocks], names=names)

        for batch in batches:
            uris = batch.column(0)
            # rows of a file come together: a batch is cut where the file changes
            changes = pc.not_equal(uris[1:], uris[:-1]).to_numpy(zero_copy_only=False) if len(uris) > 1 else np.zeros(0, bool)
            cuts = [0, *(np.flatnonzero(changes) + 1), len(uris)]
            for begin, end in zip(cuts[:-1], cuts[1:]):
                if begin == end:
                    continue
                part = batch.slice(begin, end - begin)
                if held and (held[0].column(0)[0] != part.column(0)[0] or sum(len(b) for b in held) >= _MOST_KEYS):
                    yield from filters()
                    held = []
                held.append(part)
        if held:
            yield from filters()

    # in order of slots, so that a lookup passes over the row groups of other blocks
    filters = keyed.mapInArrow(build, out)
    filters.repartitionByRange("slot").sortWithinPartitions("slot").write.mode("overwrite").parquet(f"{_index_path(root, key)}/{RUN}={run_id}")


def _bits_set(bits: str, code: str) -> Column:
    first = F.col(code).bitwiseAND(_BLOCK_BITS - 1)
    step = F.shiftright(code, 15).bitwiseAND(_BLOCK_BITS - 1).bitwiseOR(1)
    test = F.lit(True)
    for n in range(_HASHES):
        at = (first + step * n).bitwiseAND(_BLOCK_BITS - 1)
        byte = F.conv(F.hex(F.substring(bits, F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        test = test & (F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1)
    return test


def files_for_keys(
    spark: SparkSession, root: str, key: str, wanted: DataFrame, schema: T.StructType | None = None
) -> DataFrame:
    """``file_uri`` of the files below ``root`` that can hold one of the keys ``wanted``.

    Files that no index knows, because their run was never indexed or was written again
    since, are among them; a file that surely holds none of the keys is not, but for
    about one of a thousand tests.
    """
    files = file_inventory(spark, root).select("file_uri")
    path = _index_path(root, key)
    if not exists(spark, path):
        return files
    key_type = open_archive(spark, root, schema).schema[key].dataType
    index = spark.read.schema(T.StructType([*_index_schema(key_type).fields, T.StructField(RUN, T.StringType())])).parquet(path)
    keys = wanted.select(F.col(key).cast(key_type).alias("key")).where("key IS NOT NULL").distinct()
    place = F.xxhash64("key")
    slots = F.array(*[F.lit(1 << n).cast("long") + place.bitwiseAND((1 << n) - 1) for n in range(_LEVELS)])
    probes = keys.select("key", F.xxhash64("key", F.lit(1)).alias("code"), F.explode(slots).alias("slot"))
    if small_enough(keys, _MOST_LITERALS):
        # a bounded number of literals, which the scan of the index compares with its row groups
        at = sorted({row["slot"] for row in probes.select("slot").distinct().collect()})
        index, probes = index.where(F.col("slot").isin(at)), F.broadcast(probes)
    met = index.join(probes, "slot").where(F.col("key").between(F.col("least"), F.col("most")) & _bits_set("bits", "code"))
    known = spark.read.schema("file_uri string").parquet(path).distinct()
    unknown = files.join(known, "file_uri", "left_anti")
    return files.join(met.select("file_uri").distinct(), "file_uri", "left_semi").unionByName(unknown)


def restore_keys(
    spark: SparkSession,
    root: str,
    key: str,
    wanted: DataFrame,
    as_of_run: str | None = None,
    schema: T.StructType | None = None,
) -> DataFrame:
    """The newest copy of the keys in ``wanted``, as ``restore`` would give it, from the
    files that can hold them.

    Names of files come to the driver, never more than Spark's own listing of the archive
    holds there. Keys may repeat or be unknown; null is no key.
    """
    archive = open_archive(spark, root, schema)
    found = [row.file_uri for row in files_for_keys(spark, root, key, wanted, archive.schema).collect()]
    if not found:
        return archive.where(F.lit(False))
    held = spark.read.schema(archive.schema).option("basePath", root).parquet(*found)
    if as_of_run is not None:
        held = held.where(F.col(RUN) <= as_of_run)
    keys = wanted.select(F.col(key).cast(archive.schema[key].dataType).alias(key)).where(F.col(key).isNotNull()).distinct()
    keys = F.broadcast(keys) if small_enough(keys, _MOST_LITERALS) else keys
    return latest_copies(held.join(keys, key, "left_semi"), key, RUN).select(*archive.columns)
