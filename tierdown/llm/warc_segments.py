"""WARC archives with segmented records: writing, reading, reassembly.

Each page is an HTTP response with chunked transfer framing. A block above the segment
size is written as a first record (``WARC-Segment-Number: 1``) and continuation records
that name it in ``WARC-Segment-Origin-ID``; the last one has the total length. Equal
payloads are stored once: the page with the smallest id is the response, the others are
``revisit`` records that refer to it.

Reading takes the archives as binary files, cuts them into records by Content-Length,
groups the segments by origin, puts them in order, checks numbers and total length, and
takes the chunked framing off. Only segments are shuffled; whole records are decoded
where they are read.

Archives are written by Spark's text sink, one record a row and the two empty lines of
the format as line end, so they land where all executors see them, gzipped, and a
retried task replaces its own file. A file takes a bounded number of records, and a
record is at most a segment long.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierdown.scratch import scratch_dir

SEGMENT_BYTES = 4 << 10  # pages are often longer, so that many are put together from segments
CHUNK_BYTES = 16 << 10
RECORDS_PER_FILE = 2000
DATE = "2024-01-31T00:00:00Z"

_END = b"\r\n\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_PARSED = (
    "origin_id string, segment int, total_length long, warc_type string, uri string, page_id long, digest string, "
    "block binary, payload binary, payload_bytes long"
)


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The payload in chunked transfer framing."""
    out = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join((*out, b"0\r\n\r\n"))


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body. Sizes, ends and trailers are checked."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size missing")
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk is not as long as it says")
        out.append(body[at : at + size])
        at += size + 2


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the two line ends that follow it."""
    lines = "".join(f"{name}: {value}\r\n" for name, value in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block


def records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of an archive."""
    at = 0
    while at < len(archive):
        head = archive.find(_END, at)
        if head < 0 or not archive.startswith(b"WARC/1.", at):
            raise ValueError(f"no record at byte {at}")
        lines = archive[at:head].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
        begin = head + len(_END)
        end = begin + int(headers["content-length"])
        if archive[end : end + len(_END)] != _END:
            raise ValueError(f"record at byte {at} is not as long as it says")
        yield headers, archive[begin:end]
        at = end + len(_END)


def _one_line(text: str | None) -> str:
    return re.sub(r"[\x00-\x20]+", "%20", text or "urn:none")


def _record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, '/'.join(map(str, parts)))}>"


def segments(
    page_id: int | None, url: str | None, payload: bytes, number: int, first: tuple[int, str | None] | None, segment_bytes: int = SEGMENT_BYTES
) -> list[bytes]:
    """The records of one page. ``number`` is this row's own; ``first`` is page and url of
    the response for this payload, None if no other page has it. Revisits name it by its
    target and date, since no record id is known outside the task that writes it."""
    digest = digest32(payload)
    own = _record_id(page_id, digest, number)
    shared = [
        ("WARC-Target-URI", _one_line(url)),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
    ]
    http = ("Content-Type", "application/http;msgtype=response")
    if first is not None and page_id != first[0]:
        headers = [("WARC-Type", "revisit"), ("WARC-Record-ID", own), *shared, http]
        headers.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        headers += [("WARC-Refers-To-Target-URI", _one_line(first[1])), ("WARC-Refers-To-Date", DATE)]
        return [record(headers, _HTTP)]
    block = _HTTP + chunked(payload)
    parts = [block[at : at + segment_bytes] for at in range(0, len(block), segment_bytes)]
    out = []
    for n, part in enumerate(parts, 1):
        if n == 1:
            headers = [("WARC-Type", "response"), ("WARC-Record-ID", own), *shared, http]
        else:
            headers = [("WARC-Type", "continuation"), ("WARC-Record-ID", _record_id(own, n)), *shared]
            headers.append(("WARC-Segment-Origin-ID", own))
        if len(parts) > 1:
            headers.append(("WARC-Segment-Number", str(n)))
        if n == len(parts) > 1:
            headers.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(record(headers, part))
    return out


def write_archives(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Writes ``pages`` (``page_id, url, html``) as gzipped WARC files below ``path``.

    A null html is an empty payload. Of pages with equal payloads the one with the
    smallest id is the response (each such row, if it is repeated) and the others are
    revisits; rows without an id are revisits of a page that has one, and responses
    otherwise. Other columns are ignored. No rows: no records.
    """
    spark = pages.sparkSession
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")
    ).withColumns({"payload": F.sha1(F.encode("html", "UTF-8")), "number": F.monotonically_increasing_id()})
    known = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    # payloads of one page need no partner; the table of the others is written, so that
    # Spark knows whether it is small enough to be broadcast
    at = scratch_dir(spark, "warc-copies")
    rows.groupBy("payload").agg(F.min(known).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(
        "payload", "first"
    ).write.parquet(at)
    copies = spark.read.parquet(at)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                page_id, url, html, number, first = (column[row].as_py() for column in batch.columns)
                first = (first["page_id"], first["url"]) if first else None
                built = segments(page_id, url, html.encode("utf-8", "surrogatepass"), number, first, segment_bytes)
                yield pa.RecordBatch.from_arrays([pa.array(built, pa.binary())], names=["record"])

    joined = rows.join(copies, "payload", "left").select("page_id", "url", "html", "number", "first")
    (
        joined.mapInArrow(build, "record binary")
        .select(F.col("record").cast("string").alias("value"))
        .write.option("lineSep", _END.decode())
        .option("compression", "gzip")
        .option("maxRecordsPerFile", records_per_file)
        .text(path)
    )


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per page of the archives below ``path``: ``page_id, uri, payload_bytes,
    digest, record_type, refers_to`` and, if asked for, ``payload``.

    Segments are reassembled; a missing, repeated or surplus segment, a wrong total
    length, a broken chunk or a digest that does not fit the payload raise an error.
    Revisits are resolved to the response with the same payload digest, which must be
    in the archives.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for headers, block in records(zlib.decompress(content.as_py(), 31)):
                    number, total = headers.get("warc-segment-number"), headers.get("warc-segment-total-length")
                    page, digest = headers.get("x-page-id", ""), headers.get("warc-payload-digest", "").removeprefix("sha1:")
                    payload = None
                    if number is None and headers["warc-type"] == "response":
                        payload = _payload(block, digest)
                    rows.append(
                        {
                            "origin_id": headers.get("warc-segment-origin-id", headers["warc-record-id"]),
                            "segment": int(number) if number else None,
                            "total_length": int(total) if total else None,
                            "warc_type": headers["warc-type"],
                            "uri": headers.get("warc-target-uri"),
                            "page_id": int(page) if page else None,
                            "digest": digest,
                            "block": block if number else None,
                            "payload": payload if with_payload else None,
                            "payload_bytes": None if payload is None else len(payload),
                        }
                    )
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, _ARROW)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                payload = _payload(reassembled(row.pop("parts")), row["digest"])
                rows.append(row | {"payload": payload if with_payload else None, "payload_bytes": len(payload)})
            yield pa.RecordBatch.from_pylist(rows, _WHOLE)

    at = scratch_dir(spark, "warc-records")
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    archives.select("content").mapInArrow(parse, _PARSED).write.parquet(at)
    found = spark.read.parquet(at)
    columns = ("page_id", "uri", "digest", "payload", "payload_bytes")
    whole = found.where("segment is null and warc_type = 'response'").select(*columns)
    joined = (
        found.where("segment is not null")
        .groupBy("origin_id")
        .agg(
            F.max("page_id").alias("page_id"),
            F.max("uri").alias("uri"),
            F.max("digest").alias("digest"),
            F.array_sort(F.collect_list(F.struct("segment", "total_length", "block"))).alias("parts"),
        )
        .drop("origin_id")
        .mapInArrow(assemble, "page_id long, uri string, digest string, payload binary, payload_bytes long")
    )
    responses = whole.unionByName(joined)
    # where a payload has several response rows they are the same page
    stored = responses.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("payload_bytes").alias("payload_bytes"))
    revisits = found.where("warc_type = 'revisit'").select("page_id", "uri", "digest")
    resolved = revisits.join(stored, "digest", "left").select(
        "page_id", "uri", "digest", F.lit(None).cast("binary").alias("payload"), "payload_bytes",
        F.lit("revisit").alias("record_type"), "refers_to",
    )
    lost = F.raise_error(F.concat(F.lit("no response for a revisit of "), "digest")).cast("long")
    resolved = resolved.withColumn("payload_bytes", F.coalesce("payload_bytes", lost))
    every = responses.withColumns({"record_type": F.lit("response"), "refers_to": F.lit(None).cast("long")}).unionByName(resolved)
    return every if with_payload else every.drop("payload")


def reassembled(parts: list[dict]) -> bytes:
    """The block that segments make up, in order of their numbers."""
    if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)):
        raise ValueError(f"segments {[p['segment'] for p in parts]} are not a whole record")
    block = b"".join(p["block"] for p in parts)
    if parts[-1]["total_length"] != len(block) or any(p["total_length"] is not None for p in parts[:-1]):
        raise ValueError(f"total length {parts[-1]['total_length']} of a block of {len(block)} bytes")
    return block


def _payload(block: bytes, digest: str) -> bytes:
    head, found, body = block.partition(_END)
    if not found:
        raise ValueError("response without an end of its headers")
    payload = dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    if digest32(payload) != digest:
        raise ValueError(f"payload does not fit its digest {digest}")
    return payload


_WHOLE = pa.schema(
    [("page_id", pa.int64()), ("uri", pa.string()), ("digest", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64())]
)
_ARROW = pa.schema(
    [
        ("origin_id", pa.string()), ("segment", pa.int32()), ("total_length", pa.int64()), ("warc_type", pa.string()),
        ("uri", pa.string()), ("page_id", pa.int64()), ("digest", pa.string()), ("block", pa.binary()),
        ("payload", pa.binary()), ("payload_bytes", pa.int64()),
    ]
)


def archived_pages(pages: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Writes the archives of ``pages`` into the shared folder and reads them back."""
    at = scratch_dir(pages.sparkSession, "warc")
    write_archives(pages, at, segment_bytes)
    return read_archives(pages.sparkSession, at)
