"""Secret scans with linking of credentials that come in several parts.

Assignments, access identifiers and long hexadecimal strings are secrets on their own.
Other things are not: a short hexadecimal string, a base64 string, an account name, an
address. These are weak candidates, and they are reported only where the parts that
complete them stand nearby: an identifier with a secret, a secret with an identifier,
an endpoint with both.

Nearby means within one scope (no blank line between) and, if a ``reach`` is given, at
most so many code points apart, so linking is an interval join. Its parts all come from one row, so it runs
where the row is read, for all rows of a batch at once, by binary search in parts
sorted by scope and position: no shuffle, and no pairs are formed.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tierdown.llm.words import Block, blocks, runs

REACH = 200

# fixed values: kinds in the order they are listed by
KINDS = ("assign", "access", "hex", "weak_access", "weak_secret", "endpoint")
BASE = 3

_ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_SESSION = re.compile(r"(?<![A-Z0-9])(?:ASIA|AIDA|AROA|AGPA)[A-Z0-9]{12,}")
_NAME = re.compile(r"""(?:client|account|user|tenant|access)_?(?:id|name)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", re.IGNORECASE | re.ASCII)
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{32,}+={0,2}+(?![A-Za-z0-9+/=])")
_ENDPOINT = re.compile(r"""(?:[a-z][a-z0-9+.-]*://|(?<![A-Za-z0-9.])(?:[a-z0-9-]+\.)+[a-z]{2,}:\d)[^\s"'<>]*""")
_BLANK = re.compile(r"\n[\x20\x09\x0D]*\n")


def _table(characters: str) -> np.ndarray:
    return np.isin(np.arange(256), list(characters.encode()))


_DIGITS, _CAPITALS = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_RUNS = (
    (_table(_DIGITS + "abcdef"), 16),
    (_table(_DIGITS + _CAPITALS), 16),
    (_table(_DIGITS + _CAPITALS + _CAPITALS.lower() + "+/"), 32),
)
_SEPARATORS = _table(":=")


def _worth_reading(block: Block) -> np.ndarray:
    """Texts in which any pattern can match: each needs a colon, an equals sign, or a long
    run of its characters. The others are passed over without being decoded."""
    marked = _SEPARATORS[block.data]
    for table, least in _RUNS:
        starts, ends = runs(table[block.data], block.bounds)
        marked[starts[ends - starts >= least]] = True
    return block.byte_sums(marked) > 0


def parts(text: str) -> list[tuple[int, int, int]]:
    """``start, end, kind`` of every part: base ones, then weak ones apart from these."""
    found = [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text)]
    runs_of_hex = [(m.start(), m.end()) for m in _HEX.finditer(text)]
    found += [(s, e, 2) for s, e in runs_of_hex if e - s >= 24]
    weak = [(m.start(), m.end(), 3) for pattern in (_SESSION, _NAME) for m in pattern.finditer(text)]
    weak += [(s, e, 4) for s, e in runs_of_hex if e - s < 24]
    weak += [
        (m.start(), m.end(), 4)
        for m in _BASE64.finditer(text)
        if re.search("[0-9]", m[0]) and re.search("[A-Z]", m[0]) and re.search("[a-z]", m[0])
    ]
    weak += [(m.start(), m.end(), 5) for m in _ENDPOINT.finditer(text)]
    found.sort()
    begins, furthest = [s for s, _, _ in found], list(accumulate((e for _, e, _ in found), max))
    apart, last = [], 0
    for s, e, kind in sorted(weak):
        before = bisect_left(begins, e)
        if s >= last and not (before and furthest[before - 1] > s):
            apart.append((s, e, kind))
            last = e
    return found + apart


def linked(scope: np.ndarray, start: np.ndarray, end: np.ndarray, kind: np.ndarray, reach: int | None) -> np.ndarray:
    """The interval join: which parts are to be reported. ``scope`` numbers the stretches
    of text within which parts may complete each other; without ``reach``, all of one do."""
    reach = int(end.max(initial=0)) if reach is None else reach
    width = int(end.max(initial=0)) + 2 * reach + 2
    start, end = start + scope * width + reach, end + scope * width + reach

    def near(others: np.ndarray) -> np.ndarray:
        """Whether one of ``others`` begins or ends within reach of each part."""
        if not others.any():
            return np.zeros(len(start), bool)
        order = np.argsort(start[others], kind="stable")
        begins = start[others][order]
        furthest = np.maximum.accumulate(end[others][order])
        before = np.searchsorted(begins, end + reach, "right")
        return (before > 0) & (furthest[np.maximum(before, 1) - 1] >= start - reach)

    identifier, secret = np.isin(kind, (1, 3)), np.isin(kind, (0, 2, 4))
    by_identifier, by_secret = near(identifier), near(secret)
    return (
        (kind < BASE)
        | ((kind == 3) & by_secret)
        | ((kind == 4) & by_identifier)
        | ((kind == 5) & by_identifier & by_secret)
    )


def credential_spans(documents: DataFrame, reach: int | None = REACH) -> DataFrame:
    """One row per row of ``documents``: ``doc_id, n_assign, n_access, n_hex,
    base_sha256, spans, n_linked``.

    ``spans`` lists ``kind:start:end`` (code points, end exclusive) of base spans and of
    linked weak ones, by start and then kind; ``base_sha256`` is the digest of the same
    list of base spans only; ``n_linked`` counts the weak ones. ``reach`` None links over
    the whole scope, as the registered query does. A null or empty text has
    none (the digest of an empty string). Repeated rows and a null ``doc_id`` are rows
    like others; other columns are ignored.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                rows, scopes, spans = [], [], []
                scope = 0
                for i in np.flatnonzero(_worth_reading(block)):
                    text = block.data[block.bounds[i] : block.bounds[i + 1]].tobytes().decode("utf-8", "replace")
                    found = parts(text)
                    if found:
                        breaks = [m.start() for m in _BLANK.finditer(text)]
                        rows += [i] * len(found)
                        spans += found
                        scopes += (scope + np.searchsorted(breaks, [s for s, _, _ in found])).tolist()
                        scope += len(breaks) + 1
                yield _listed(batch.column(0).slice(block.lo, len(block)), rows, np.array(scopes, np.int64), spans, reach)

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long"
    return documents.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(scan, schema)


def _listed(ids: pa.Array, rows: list[int], scopes: np.ndarray, spans: list[tuple[int, int, int]], reach: int | None) -> pa.RecordBatch:
    start, end, kind = np.array(spans, np.int64).reshape(-1, 3).T
    told = linked(scopes, start, end, kind, reach)
    base, every = [[] for _ in range(len(ids))], [[] for _ in range(len(ids))]
    counts = np.zeros((4, len(ids)), np.int64)
    for row, span in sorted((row, span) for row, span, yes in zip(rows, [(s, k, e) for s, e, k in spans], told) if yes):
        s, k, e = span
        written = f"{KINDS[k]}:{s}:{e}"
        every[row].append(written)
        if k < BASE:
            base[row].append(written)
        counts[min(k, BASE), row] += 1
    digests = [hashlib.sha256(",".join(b).encode()).hexdigest() for b in base]
    return pa.RecordBatch.from_arrays(
        [ids, *(pa.array(c) for c in counts[:3]), pa.array(digests), pa.array([",".join(x) for x in every]), pa.array(counts[3])],
        names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"],
    )
