"""Words and word windows of whole texts, as arrays.

A word is a maximal run of bytes other than space and the five controls 0x09 to 0x0D
in UTF-8, which is the same as ``[^\\x20\\x09-\\x0D]+`` over code points. Texts come as
Arrow arrays and are worked through in blocks of a few megabytes, so memory follows
the block (or the one text that is longer than a block), never the partition.

Words and windows are compared by 64-bit hashes that are the same in every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20
_SEGMENT = 1 << 20  # bytes hashed with one run of powers

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_CODES = mixed(np.arange(1, 257, dtype=np.uint64) * _ODD)
_BASE = 0x5851F42D4C957F2D
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n + 1:
        size = max(n + 1, _SEGMENT + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = [
            np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, base, np.uint64))))
            for base in (_BASE, inverse)
        ]
    return _powers[0], _powers[1]


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row and the n + 1 offsets between them; a null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(pc.cast(texts, pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts):
        offsets = np.zeros(1, np.int64)
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data, offsets


@dataclass
class Block:
    """Consecutive texts. ``first[i]:first[i + 1]`` are the words of text ``i``."""

    lo: int
    hi: int
    data: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return self.hi - self.lo

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.counts)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)

    def subset(self, wanted: np.ndarray) -> Block:
        """The block with the wanted texts alone."""
        if wanted.all():
            return self
        lengths = np.diff(self.bounds)
        here = np.repeat(wanted, lengths)
        moved = np.concatenate(([0], np.cumsum(here)))
        words = np.repeat(wanted, self.counts)
        bounds = np.concatenate(([0], np.cumsum(lengths[wanted])))
        first = np.concatenate(([0], np.cumsum(self.counts[wanted])))
        starts, ends = self.starts[words], self.ends[words]
        return Block(0, len(bounds) - 1, self.data[here], bounds, moved[starts], moved[ends], first)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a value per word over each text."""
        return range_sums(flags, self.first)

    def byte_sums(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a value per byte over each text."""
        return range_sums(flags, self.bounds)


def range_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def blocks(texts: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    data, offsets = text_buffers(texts)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + block_bytes, "right")) - 1
        hi = min(n, max(lo + 1, hi))
        part, bounds = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        yield Block(lo, hi, part, bounds, *_words(part, bounds))
        lo = hi


def runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of marked bytes that stay in one text."""
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    inner = bounds[(bounds > 0) & (bounds < len(inside))]
    begins[inner] = inside[inner]
    stops[inner - 1] = inside[inner - 1]
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1


def _words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends = runs(~_SEPARATOR[data], bounds)
    return starts, ends, np.searchsorted(starts, bounds)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each byte span; spans are in order and do not overlap."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + _SEGMENT, "right")))
        s, e = starts[at:to] - base, ends[at:to] - base
        power, inverse = _power_tables(int(e[-1]))
        total = np.empty(int(e[-1]) + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE_CODES[data[base : base + e[-1]]] * power[: e[-1]], out=total[1:])
        out[at:to] = (total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64) * _ODD
        at = to
    return mixed(out)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words, by its first word. Runs over the end of a
    text are included; ``window_starts`` tells them apart."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out *= np.uint64(_BASE)
        out += words[k : k + n]
    return mixed(out)


def window_starts(block: Block, size: int) -> np.ndarray:
    """Positions of words that begin a run of ``size`` words within their own text."""
    n = len(block.starts) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    stop = np.repeat(block.first[1:], block.counts)[:n]
    return np.flatnonzero(np.arange(n) + size <= stop)


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a run of ``size`` words from one of ``starts``."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + size, n), -1)
    return np.cumsum(change[:-1]) > 0


def code_points(block: Block, within: np.ndarray | None = None) -> np.ndarray:
    """Code points of each text, of chosen bytes only if ``within`` is given."""
    leads = (block.data & 0xC0) != 0x80
    return block.byte_sums(leads if within is None else leads & within)
