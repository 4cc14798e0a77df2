"""Objects of any size in containers: ranged chunks, a manifest, and reassembly.

An object becomes rows of at most ``chunk_bytes``. The ranges are planned as rows without
content and dealt over the tasks by container, so that the bytes are read in the task
that writes them and never shuffled. The manifest states for each object how many
chunks it has and a digest composed of theirs; only what is whole by it is put back.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierdown.functions.age import cutoff
from tierdown.functions.naming import DEFAULT_FORMAT, archive_bucket
from tierdown.operators.restoring import latest_copies, split_unsafe_keys
from tierdown.plans.containers import BUCKET, RUN, codec
from tierdown.plans.copying import DEFAULT_LEVEL, ZLIB_LEVELS, CopyOutcome, checked_copy, refuse_overlap
from tierdown.scratch import scratch_dir
from tierdown.sources.walk import below, open_root, walk_objects

CHUNK_BYTES = 8 << 20
#: bytes and rows that one task of the archive reads and writes
_TASK_BYTES, _TASK_ROWS = 512 << 20, 20_000
#: bytes that go to the JVM at once
_BATCH_BYTES = 16 << 20
#: chunk digests that are composed at once; a group of so many groups is composed again
_FAN_IN = 1024

_STORED = T.StructType(
    [
        T.StructField("rel_path", T.StringType()),
        T.StructField("mtime", T.TimestampType()),
        T.StructField("size", T.LongType()),
        T.StructField("chunks", T.LongType()),
        T.StructField("chunk", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
        T.StructField("digest", T.StringType()),
        T.StructField("err", T.StringType()),
        T.StructField(BUCKET, T.StringType()),
    ]
)


def _piece(store, path: str, offset: int, length: int) -> tuple[bytes | None, str | None]:
    try:
        with store.open_input_file(path) as file:
            file.seek(offset)
            content = file.read(length)
    except OSError as problem:
        return None, str(problem).splitlines()[0]
    if len(content) != length:
        return None, f"{len(content)} of {length} bytes were readable"
    return content, None


def _chunk_rows(root: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_root(root)
        for batch in batches:
            ranges = [batch.column(n).to_pylist() for n in ("rel_path", "offset", "length")]
            begin, held, found = 0, 0, []
            for at, (key, offset, length) in enumerate(zip(*ranges), 1):
                content, err = _piece(store, below(base, key), offset, length)
                found.append((content, None if content is None else hashlib.sha256(content).hexdigest(), err))
                held += length
                if held >= _BATCH_BYTES or at == batch.num_rows:
                    columns = zip((pa.binary(), pa.string(), pa.string()), zip(*found))
                    kept = batch.slice(begin, at - begin)
                    given = [kept.column(n) for n in ("rel_path", "mtime", "size", "chunks", "chunk", "length")]
                    arrays = [*given, *(pa.array(c, t) for t, c in columns), kept.column(BUCKET)]
                    yield pa.RecordBatch.from_arrays(arrays, names=_STORED.names)
                    begin, held, found = at, 0, []

    return read


def archive_chunks(
    spark: SparkSession,
    root: str,
    destinations: Sequence[str],
    run_id: str,
    hours: float,
    as_of: datetime,
    group_by: str = "daily",
    format: str = DEFAULT_FORMAT,
    level: int = DEFAULT_LEVEL,
    chunk_bytes: int = CHUNK_BYTES,
) -> tuple[list[CopyOutcome], DataFrame]:
    """Every file below ``root`` older than the cutoff, of any size and any name.

    Returns the outcomes (their items are chunks, their bytes those of the chunks) and
    the errors: folders and files that could not be read. A file with a range that could
    not be read is among the errors and not whole in the manifest. An empty file is one
    empty chunk. ``as_of`` is UTC; files exactly at the cutoff stay.
    """
    if chunk_bytes < 1:
        raise ValueError(f"chunk_bytes must be positive, got {chunk_bytes}")
    refuse_overlap(root, destinations)
    files, errors = walk_objects(spark, root)
    before = (cutoff(as_of, hours) - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    old = files.where(F.col("mtime") < F.timestamp_micros(F.lit(before)))
    total = old.agg(
        F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum(F.greatest(F.lit(1), F.ceil(F.col("size") / chunk_bytes))), F.lit(0)).alias("rows"),
    ).first()
    tasks = max(spark.sparkContext.defaultParallelism, total["bytes"] // _TASK_BYTES, total["rows"] // _TASK_ROWS)

    size = F.lit(chunk_bytes).cast("long")
    ranges = (
        old.withColumn("chunks", F.greatest(F.lit(1), F.ceil(F.col("size") / size)).cast("long"))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        .withColumn("offset", F.col("chunk") * size)
        .withColumn("length", F.least(size, F.col("size") - F.col("offset")))
        .withColumn(BUCKET, archive_bucket("mtime", group_by))
    )
    # ranges without content; a large container, or a large object, is split over many tasks
    dealt = ranges.repartitionByRange(int(tasks), BUCKET, "rel_path", "chunk")

    def write(rows: DataFrame, path: str) -> None:
        writer = rows.write.mode("overwrite").partitionBy(BUCKET)
        # rows are large: the writer looks at its memory after every fourth of them
        writer = writer.option("parquet.page.size.row.check.min", 4).option("parquet.page.size.row.check.max", 4)
        if codec(format) == "gzip":
            writer = writer.option("compression", "gzip").option("zlib.compress.level", ZLIB_LEVELS[level])
        writer.parquet(path)

    def read(path: str) -> DataFrame:
        return spark.read.schema(_STORED).parquet(path)

    outcomes: list[CopyOutcome] = []
    for destination in destinations:
        path = f"{destination.rstrip('/')}/chunks/{RUN}={run_id}"
        good = next((o for o in outcomes if o.ok), None)
        rows = dealt.mapInArrow(_chunk_rows(root), _STORED) if good is None else read(good.path)
        outcome = checked_copy(rows, _STORED, destination, path, write, read, "length")
        if outcome.ok:
            _manifest(read(path)).write.mode("overwrite").parquet(f"{destination.rstrip('/')}/manifest/{RUN}={run_id}")
        outcomes.append(outcome)
    good = next((o for o in outcomes if o.ok), None)
    if good is not None:
        unread = read(good.path).where("err IS NOT NULL").groupBy(F.col("rel_path").alias("key")).agg(F.min("err").alias("err"))
        errors = errors.unionByName(unread.withColumn("operation", F.lit("access")))
    return outcomes, errors


def _composed(order: str, digest: str) -> Column:
    ordered = F.array_sort(F.collect_list(F.struct(order, digest)))
    return F.sha2(F.array_join(F.transform(ordered, lambda one: one[digest]), ""), 256)


def composed_digest(digests: Sequence[str]) -> str:
    """The digest that the manifest gives an object with chunks of these digests."""
    groups = [digests[at : at + _FAN_IN] for at in range(0, len(digests), _FAN_IN)]
    inner = [hashlib.sha256("".join(group).encode()).hexdigest() for group in groups]
    return hashlib.sha256("".join(inner).encode()).hexdigest()


def _manifest(chunks: DataFrame) -> DataFrame:
    """One row per object. Content is not read, and an object of very many chunks is
    composed group by group, by many tasks."""
    grouped = chunks.groupBy("rel_path", BUCKET, "mtime", "size", "chunks", F.floor(F.col("chunk") / _FAN_IN).alias("g")).agg(
        _composed("chunk", "digest").alias("digest"),
        F.count("digest").alias("found"),
        F.sum(F.when(F.col("digest").isNotNull(), F.col("length"))).alias("bytes"),
    )
    objects = grouped.groupBy("rel_path", BUCKET, "mtime", "size", "chunks").agg(
        _composed("g", "digest").alias("digest"), F.sum("found").alias("found"), F.sum("bytes").alias("bytes")
    )
    whole = (F.col("found") == F.col("chunks")) & F.coalesce(F.col("bytes") == F.col("size"), F.lit(False))
    return objects.select("rel_path", BUCKET, "mtime", "size", "chunks", "digest", whole.alias("whole"))


def open_manifest(spark: SparkSession, root: str) -> DataFrame:
    """The objects of all runs below ``root``, each with its chunks, digest and state."""
    schema = f"rel_path string, {BUCKET} string, mtime timestamp, size long, chunks long, digest string, whole boolean, {RUN} string"
    return spark.read.schema(schema).parquet(f"{root.rstrip('/')}/manifest")


def _put_back(target: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_root(target)
        key, staged, out, written, digests, fault = None, None, None, 0, [], None

        def close() -> pa.RecordBatch:
            nonlocal out
            err = fault
            if out is not None:
                out.close()
                out = None
                if err is None:
                    store.move(staged, below(base, key))
                else:
                    store.delete_file(staged)
            digest = None if err else composed_digest(digests)
            row = [[key], [written], [digest], [err]]
            types = (pa.string(), pa.int64(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types)], names=["rel_path", "size", "digest", "err"])

        try:
            for batch in batches:
                columns = [batch.column(n) for n in ("rel_path", "content", "digest")]
                for name, content, digest in zip(*columns):
                    if name.as_py() != key:
                        if key is not None:
                            yield close()
                        key, written, digests, fault = name.as_py(), 0, [], None
                        path = below(base, key)
                        # a name of its own: a repeated task never meets what a lost one left open
                        staged = f"{path}.{uuid.uuid4().hex}.part"
                        try:
                            store.create_dir(path.rpartition("/")[0], recursive=True)
                            out = store.open_output_stream(staged)
                        except OSError as problem:
                            fault = str(problem).splitlines()[0]
                    data = content.as_buffer()
                    if hashlib.sha256(data).hexdigest() != digest.as_py():
                        fault = fault or f"chunk {len(digests)} differs from its digest"
                    digests.append(digest.as_py())
                    if fault is None:
                        out.write(data)
                        written += len(data)
            if key is not None:
                yield close()
        finally:
            if out is not None:
                out.close()

    return write


def restore_chunks(
    spark: SparkSession,
    root: str,
    target: str,
    buckets: Sequence[str] | None = None,
    as_of_run: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Puts the newest whole copy of every object back below ``target``.

    Returns (objects written: ``rel_path, size, digest``; ``restore`` errors: keys that
    leave the folder, chunks that differ from their digest, names that cannot be written).
    An object is written by one task as a stream, in order, a batch of chunks at a time,
    under a name of its own that becomes the final one when all of it is there.
    Objects without a whole copy are left out; ``open_manifest`` names them.
    """
    manifest = open_manifest(spark, root)
    chunks = spark.read.schema(T.StructType([*_STORED.fields, T.StructField(RUN, T.StringType())])).parquet(f"{root.rstrip('/')}/chunks")
    if buckets is not None:
        manifest, chunks = (df.where(F.col(BUCKET).isin(*buckets)) for df in (manifest, chunks))
    if as_of_run is not None:
        manifest, chunks = (df.where(F.col(RUN) <= as_of_run) for df in (manifest, chunks))
    newest, refused = split_unsafe_keys(latest_copies(manifest.where("whole"), "rel_path", RUN), "rel_path")
    wanted = newest.select("rel_path", RUN)
    content = chunks.select("rel_path", RUN, "chunk", "content", "digest").join(wanted, ["rel_path", RUN], "left_semi")
    at = scratch_dir(spark, "restored")
    rows = content.repartition("rel_path").sortWithinPartitions("rel_path", "chunk")
    rows.mapInArrow(_put_back(target), "rel_path string, size long, digest string, err string").write.parquet(at)
    written = spark.read.parquet(at)
    failed = written.where("err IS NOT NULL").select(F.col("rel_path").alias("key"), F.lit("restore").alias("operation"), "err")
    return written.where("err IS NULL").drop("err"), refused.unionByName(failed)


def _remover(root: str):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_root(root)
        for batch in batches:
            faults = []
            for key, size, us in zip(*(batch.column(n).to_pylist() for n in ("rel_path", "size", "us"))):
                path = below(base, key)
                info = store.get_file_info(path)
                fault = None
                if info.type == pafs.FileType.File:
                    if (info.size, info.mtime_ns // 1000) != (size, us):
                        fault = "changed since it was listed"
                    else:
                        try:
                            store.delete_file(path)
                        except OSError as problem:
                            fault = str(problem).splitlines()[0]
                # what is gone already was removed by an attempt of this task that was lost
                faults.append(fault)
            given = [batch.column(n) for n in ("rel_path", "size")]
            yield pa.RecordBatch.from_arrays([*given, pa.array(faults, pa.string())], names=["rel_path", "size", "err"])

    return remove


def prune_objects(
    spark: SparkSession, root: str, vaults: Sequence[str], hours: float, as_of: datetime
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remove the files below ``root`` that are older than the cutoff and archived as they are.

    Returns (files removed: ``rel_path, size``; expired files that stay because no vault
    holds a whole copy of the same size and time; ``prune`` errors). A file that has
    changed since it was archived, or since it was listed, stays. Files are removed by
    tasks; one that a lost task had removed already counts as removed.
    """
    files, _ = walk_objects(spark, root)
    before = (cutoff(as_of, hours) - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    us = F.unix_micros("mtime").alias("us")
    old = files.select("rel_path", "size", us).where(F.col("us") < before)
    same = ["rel_path", "size", "us"]
    proven = None
    for vault in vaults:
        whole = open_manifest(spark, vault).where("whole").select("rel_path", "size", us)
        proven = whole if proven is None else proven.unionByName(whole)
    if proven is None:
        raise ValueError("without a vault nothing is proven")
    at = scratch_dir(spark, "removed")
    removable = old.join(proven.distinct(), same, "left_semi")
    removable.mapInArrow(_remover(root), "rel_path string, size long, err string").write.parquet(at)
    done = spark.read.schema("rel_path string, size long, err string").parquet(at)
    errors = done.where("err IS NOT NULL").select(F.col("rel_path").alias("key"), F.lit("prune").alias("operation"), "err")
    unproven = old.join(proven.distinct(), same, "left_anti").select("rel_path", "size")
    return done.where("err IS NULL").drop("err"), unproven, errors
