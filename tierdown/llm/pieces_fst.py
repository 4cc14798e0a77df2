"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The model is compiled into three machines: the normaliser (dummy prefix, spaces written
as the space mark), the pieces (one arc per piece), and byte fallback (one arc per
character that no piece spells, giving its bytes). Each input is composed with them, and
the path of least weight in the tropical semiring (weights add along a path, the least
path wins) gives the ids.

Unigram models weigh each arc by minus its score. Byte-pair models have no such weights:
there a fourth machine is composed, an acceptor over neighbouring pieces, of weight 0 if
merging their joined text gives just these two pieces and infinite otherwise. A sequence
of pieces is what the merges give exactly if all its neighbours are accepted, so one path
of weight 0 is left, and its prefixes are the paths of the prefixes.

No piece goes on over a space mark, so inputs are composed word by word, and words met
again come from a bounded memory.
"""

from __future__ import annotations

import heapq
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
REMEMBERED_WORDS = 800_000  # per worker
REMEMBERED_CHARS = 64  # of a word; longer ones are rarely met again
MARK = "▁"
UNKNOWN_PENALTY = 10.0  # what the published unigram encoder takes off the least score

# fixed values: model and piece types of the published file format
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

_NO_PIECE = -1


def _fields(message: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(message):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            size = varint()
            yield key >> 3, message[at : at + size]
            at += size
        else:
            size = 4 if kind == 5 else 8
            yield key >> 3, message[at : at + size]
            at += size


class _Remembered(dict):
    """Ids, as 32-bit numbers, of words without spaces that have a space in front. A word of
    more than ``REMEMBERED_CHARS`` is worked out and forgotten (in texts without spaces a
    word can be a whole line), so a worker keeps at most about 400 MB, and about 200 MB of
    words as long as they usually are."""

    def __init__(self, machine: Transducer):
        self.machine = machine

    def __missing__(self, word: str) -> bytes:
        ids = array("i", self.machine.path(" " + word)).tobytes()
        if len(word) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def __reduce__(self):  # what is remembered stays where it is
        return _Remembered, (self.machine,)


@dataclass
class Transducer:
    """A compiled model. ``ids`` spells pieces with a space for the space mark."""

    kind: int
    dummy_prefix: bool
    trim_spaces: bool
    texts: list[bytes]
    scores: list[float]
    ids: dict[str, int]
    bytes_ids: list[int] | None
    unknown: int
    longest: int
    halves: dict[int, tuple[int, int]] = field(default_factory=dict)
    whole: dict[int, str] = field(default_factory=dict)
    _accepted: dict[int, bool] = field(default_factory=dict)
    _borders: dict[int, list] = field(default_factory=dict)
    _lengths: dict[str, tuple[int, ...]] = field(default_factory=dict)
    _words: _Remembered = None

    def __post_init__(self):
        self._words = _Remembered(self)

    # -- normaliser ------------------------------------------------------------

    def normalised(self, text: str) -> str:
        """With spaces for space marks, the dummy prefix in front."""
        text = text.replace(MARK, " ")
        if self.trim_spaces:
            text = re.sub(" +", " ", text.strip(" "))
        return (" " + text) if self.dummy_prefix and text else text

    # -- composition and shortest path -------------------------------------------

    def path(self, text: str) -> list[int]:
        """Ids of the least path through ``text`` (normalised, without runs of spaces)."""
        if self.kind == BPE:
            return self._accepted_path(text)
        arcs = self._least_arcs(text)
        out: list[int] = []
        end = len(text)
        while end:
            begin, piece = arcs[end]
            if piece == _NO_PIECE:
                out += self._fallback(text[begin:end])[::-1]
            else:
                out.append(piece)
            end = begin
        return out[::-1]

    def _least_arcs(self, text: str) -> list[tuple[int, int]]:
        """The last arc of the least path to each position. Characters that are no piece
        have an arc of their own, heavier than any piece."""
        get, scores, longest = self.ids.get, self.scores, self.longest
        rare = UNKNOWN_PENALTY - min(scores)
        least, arcs = [0.0], [(0, _NO_PIECE)]
        for end in range(1, len(text) + 1):
            weight, arc = float("inf"), (end - 1, _NO_PIECE)
            for begin in range(max(0, end - longest), end):
                piece = get(text[begin:end])
                if piece is not None and least[begin] - scores[piece] < weight:
                    weight, arc = least[begin] - scores[piece], (begin, piece)
            if text[end - 1 : end] not in self.ids and least[end - 1] + rare < weight:
                weight, arc = least[end - 1] + rare, (end - 1, _NO_PIECE)
            least.append(weight)
            arcs.append(arc)
        return arcs

    def _accepted_path(self, text: str) -> list[int]:
        """The same where arcs weigh nothing and only accepted neighbours may follow each
        other. All finite paths weigh 0, so the first one found is the least: long arcs are
        tried first, and since one accepted path at most leads to a position, a position
        that leads nowhere is tried once. A character that is no piece is never merged, so
        anything may stand beside it."""
        get, accepted, size, n = self.ids.get, self._accepted, len(self.texts), len(text)
        if not self._lengths:
            self._measure()
        lengths = self._lengths.get
        trail: list[tuple[int, int]] = []
        blocked: set[int] = set()
        at, before = 0, _NO_PIECE
        while at < n:
            for length in lengths(text[at : at + 2], (1,)):
                end = at + length
                piece = get(text[at:end]) if end <= n else None
                if piece is not None and end not in blocked:
                    if before < 0:
                        break
                    known = accepted.get(before * size + piece)
                    if self.accepts(before, piece) if known is None else known:
                        break
            else:
                if text[at] not in self.ids:
                    trail.append((at, _NO_PIECE))
                    at, before = at + 1, _NO_PIECE
                else:
                    blocked.add(at)
                    at = trail.pop()[0]
                    before = trail[-1][1] if trail else _NO_PIECE
                continue
            trail.append((at, piece))
            at, before = end, piece
        if all(piece >= 0 for _, piece in trail):
            return [piece for _, piece in trail]
        out: list[int] = []
        for begin, piece in trail:
            out += [piece] if piece >= 0 else self._fallback(text[begin])
        return out

    def _measure(self) -> None:
        """Lengths of pieces by their first two characters, the longest first."""
        found: dict[str, set[int]] = {}
        for piece in self.ids:
            if len(piece) > 1:
                found.setdefault(piece[:2], {1}).add(len(piece))
        self._lengths = {start: tuple(sorted(sizes, reverse=True)) for start, sizes in found.items()}

    def _fallback(self, character: str) -> list[int]:
        if self.bytes_ids is None:
            return [self.unknown]
        return [self.bytes_ids[b] for b in character.encode("utf-8", "surrogatepass")]

    def accepts(self, left: int, right: int) -> bool:
        """Whether merging the joined text of two pieces ends in just these two.

        They would not if, while both are being built, a merge across their border came
        first. So the pieces at the border are taken apart, last merge first, and each
        two that ever stood side by side are looked at.
        """
        key = left * len(self.texts) + right
        known = self._accepted.get(key)
        if known is None:
            if len(self._accepted) > 4 * REMEMBERED_WORDS:
                self._accepted.clear()
            known = self._accepted[key] = self._accepts(left, right)
        return known

    def _accepts(self, left: int, right: int) -> bool:
        # the border pieces on either side with the score of the merge that ended each
        lefts, rights, get = self._border(left, 1), self._border(right, 0), self.ids.get
        for a, a_made, a_gone in lefts:
            for b, b_made, b_gone in rights:
                merged = get(a + b)
                if merged is None:
                    continue
                score = self.scores[merged]
                # both stand there from the later making to the earlier end; merges go by
                # falling score, and of equal ones the left one goes first
                if min(a_made, b_made) < score:
                    stood = min(a_made, b_made)
                    if max(a_gone, b_gone) < stood:
                        return False
                elif score > max(a_gone, b_gone) or (score == b_gone and b_gone > a_gone):
                    return False
        return True

    def _border(self, piece: int, side: int) -> list[tuple[str, float, float]]:
        """The pieces that stood at one end while ``piece`` was built: each with the score
        it was made at and the score of the merge that took it up."""
        known = self._borders.get(2 * piece + side)
        if known is None:
            known = self._borders[2 * piece + side] = []
            gone = float("-inf")
            while True:
                halves = self.halves.get(piece)
                known.append((self.whole[piece], self.scores[piece] if halves else float("inf"), gone))
                if not halves:
                    break
                gone, piece = known[-1][1], halves[side]
        return known

    # -- whole texts -------------------------------------------------------------

    def encode(self, text: str) -> np.ndarray:
        text = self.normalised(text)
        if text.startswith(" ") and "  " not in text and text[-1] != " ":
            return np.frombuffer(b"".join(map(self._words.__getitem__, text[1:].split(" "))), np.int32)
        out = []
        for part in re.findall(r" *[^ ]+| +", text):
            spaces = len(part) - len(part.lstrip(" "))
            if spaces == len(part):
                out += self._spaces(spaces)
                continue
            ids = self.path(part[spaces - 1 :] if spaces else part)
            if spaces > 1:
                # space marks join each other last; one that the word did not take is free for that
                if self.kind == BPE and self.texts[ids[0]] == b" ":
                    ids = self._spaces(spaces) + ids[1:]
                elif self.kind == BPE:
                    ids = self._spaces(spaces - 1) + ids
                else:
                    ids = self.path(part)
            out += ids
        return np.array(out, np.int32)

    def _spaces(self, count: int) -> list[int]:
        return [self.ids[s] for s in merges(" " * count, self.ids, self.scores)] if self.kind == BPE else self.path(" " * count)

    def decode(self, ids: np.ndarray) -> str:
        """The text of a sequence of ids; bytes that are no UTF-8 become replacements."""
        text = b"".join(map(self.texts.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


def merges(text: str, ids: dict[str, int], scores: list[float]) -> list[str]:
    """Byte-pair merging as it is defined: the best-scored neighbours first, of equals the
    left ones. Compiles the acceptor, and joins runs of space marks, which all score the
    same."""
    parts: list[str | None] = list(text)
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap: list[tuple[float, int, str, int]] = []

    def offer(left: int) -> None:
        right = after[left]
        if right < len(parts):
            joined = parts[left] + parts[right]
            if joined in ids:
                heapq.heappush(heap, (-scores[ids[joined]], left, joined, right))

    for i in range(len(parts) - 1):
        offer(i)
    while heap:
        _, left, joined, right = heapq.heappop(heap)
        if parts[left] is None or parts[right] is None or after[left] != right or parts[left] + parts[right] != joined:
            continue
        parts[left], parts[right] = joined, None
        after[left] = after[right]
        if after[right] < len(parts):
            before[after[right]] = left
        if before[left] >= 0:
            offer(before[left])
        offer(left)
    return [p for p in parts if p is not None]


def compiled(model: bytes) -> Transducer:
    """The transducer of a model file's bytes. Raises ValueError for what it does not
    know: models other than unigram and byte-pair, normalisers with a character map,
    user-defined pieces, pieces that go on over a space mark."""
    kind, rows, prefix, trim, charmap, fallback = UNIGRAM, [], True, True, b"", False
    for number, value in _fields(model):
        if number == 1:
            piece = dict(_fields(value))
            score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            rows.append((piece.get(1, b"").decode(), score, piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
            kind, fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
        elif number == 3:
            rules = dict(_fields(value))
            charmap, prefix, trim = rules.get(2, b""), bool(rules.get(3, 1)), bool(rules.get(4, 1))
    if kind not in (UNIGRAM, BPE):
        raise ValueError(f"model type {kind}")
    if charmap:
        raise ValueError("a normaliser with a character map")
    if any(row[2] == USER_DEFINED for row in rows):
        raise ValueError("user-defined pieces")
    plain = {text.replace(MARK, " "): i for i, (text, _, of) in enumerate(rows) if of == NORMAL}
    if any(" " in text.lstrip(" ") for text in plain):
        raise ValueError("pieces that go on over a space mark")
    scores = [row[1] for row in rows]
    texts = []
    for text, _, of in rows:
        if of == BYTE:
            texts.append(bytes([int(text[3:-1], 16)]))
        else:
            texts.append(text.replace(MARK, " ").encode() if of == NORMAL else b" \xe2\x81\x87 " if of == UNKNOWN else b"")
    bytes_ids = [i for i, row in enumerate(rows) if row[2] == BYTE] if fallback else None
    unknown = next((i for i, row in enumerate(rows) if row[2] == UNKNOWN), 0)
    built = Transducer(kind, prefix, trim, texts, scores, plain, bytes_ids, unknown, max(map(len, plain), default=1))
    if kind == BPE:
        _compile_acceptor(built)
    return built


def _compile_acceptor(machine: Transducer) -> None:
    """Finds the last merge of each piece, and leaves pieces out that no merging gives."""
    ids, scores = machine.ids, machine.scores
    machine.whole = {i: text for text, i in ids.items()}
    for text, i in list(ids.items()):
        if len(text) < 2:
            continue
        done: list[tuple[str, str]] = []
        result = _last_merge(text, ids, scores, done)
        if len(result) == 1:
            machine.halves[i] = (ids[done[0][0]], ids[done[0][1]]) if done[0][0] in ids and done[0][1] in ids else None
    for text, i in list(ids.items()):
        if len(text) > 1 and machine.halves.get(i) is None:
            machine.halves.pop(i, None)
            del machine.ids[text]


def _last_merge(text: str, ids: dict[str, int], scores: list[float], done: list) -> list[str]:
    parts = list(text)
    while len(parts) > 1:
        found = [(-scores[ids[a + b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ids]
        if not found:
            break
        k = min(found)[1]
        done[:] = [(parts[k], parts[k + 1])]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return parts


def load(path: str = MODEL) -> Transducer:
    with open(path, "rb") as file:
        return compiled(file.read())


def encoded(documents: DataFrame, machine: Transducer, text: str = "text", columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of ``documents``: its ``columns``, and ``n_tokens, ids, round_trip``
    (which ``columns`` may not hold).

    ``round_trip``: decoding the ids gives the text back (with every space mark of the
    text as a space, which is how the model spells one). A null or empty text has no ids and a
    true ``round_trip``. Nulls in ``columns`` and repeated rows are kept; other columns are
    ignored. No shuffle.
    """
    shared = documents.sparkSession.sparkContext.broadcast(machine)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                found, same = [], []
                for row in part.column(len(columns)):
                    value = row.as_py() or ""
                    ids = machine.encode(value)
                    found.append(ids)
                    same.append(machine.decode(ids) == value.replace(MARK, " "))
                offsets = np.concatenate(([0], np.cumsum([len(ids) for ids in found]))).astype(np.int32)
                flat = np.concatenate(found) if found else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[: len(columns)],
                        pa.array(np.diff(offsets).astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                        pa.array(same, pa.bool_()),
                    ],
                    names=[*columns, "n_tokens", "ids", "round_trip"],
                )

    schema = T.StructType([documents.schema[c] for c in columns])
    schema = schema.add("n_tokens", "long").add("ids", T.ArrayType(T.IntegerType())).add("round_trip", "boolean")
    return documents.select(*columns, F.col(text).alias("__text")).mapInArrow(encode, schema)
