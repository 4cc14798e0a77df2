"""Quality rules as a short-circuit cascade.

A text is kept if no rule rejects it. Which order the rules are asked in does not
change that, only what it costs: a text is dropped from the block as soon as one rule
rejects it, and the later rules see what is left. So each rule's cost and rejections
are measured on a sample first, and rules are asked by rejections per second.

The figures every row is to have (repeated windows, symbols, lines) are taken for all
texts; only the verdict is short-circuited.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tierdown.llm.words import Block, blocks, code_points, covered, mixed, span_hashes, window_hashes, window_starts

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
SAMPLE_ROWS = 100  # first rows of each partition, for costs and rejections; no verdict depends on it


def _bytes(characters: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(characters, np.uint8)] = True
    return table


_SYMBOLS = _bytes(b"#*$%&|<>")
_UPPER = _bytes(bytes(range(65, 91)))
_LETTERS = _bytes(bytes(range(65, 91)) + bytes(range(97, 123)))
_WORDLIKE = _LETTERS | (np.arange(256) >= 0x80)


@dataclass(frozen=True)
class Rule:
    """``rejects`` says of each text of a block whether it is to go."""

    name: str
    rejects: Callable[[Block], np.ndarray]


def _symbols(block: Block) -> np.ndarray:
    """More than one symbol of ``# * $ % & | < >`` in ten words."""
    return 10 * block.byte_sums(_SYMBOLS[block.data]) > block.counts


def _shouting(block: Block) -> np.ndarray:
    """More than half of at least 20 ASCII letters are capitals."""
    letters = block.byte_sums(_LETTERS[block.data])
    return (letters >= 20) & (2 * block.byte_sums(_UPPER[block.data]) > letters)


def _exclaiming(block: Block) -> np.ndarray:
    """More than three words in ten end in two exclamation marks."""
    marked = (block.data[block.ends - 1] == 0x21) & (block.data[np.maximum(block.ends - 2, 0)] == 0x21)
    return 10 * block.per_text(marked & (block.ends - block.starts > 1)) > 3 * block.counts


def _long_words(block: Block) -> np.ndarray:
    """Words are longer than 100 bytes on average."""
    return block.per_text(block.ends - block.starts) > 100 * block.counts


def _few_letters(block: Block) -> np.ndarray:
    """Fewer than half of the words hold a letter (ASCII, or any other script)."""
    seen = np.concatenate(([0], np.cumsum(_WORDLIKE[block.data])))
    return 2 * block.per_text(seen[block.ends] > seen[block.starts]) < block.counts


def _same_lines(block: Block) -> np.ndarray:
    """More than three lines in ten repeat an earlier one, of at least five lines."""
    lines, repeats = _lines(block)
    return (lines >= 5) & (10 * repeats > 3 * lines)


def _one_word(block: Block) -> np.ndarray:
    """One word makes up more than three tenths of at least 50 words."""
    keys = block.hashes() ^ mixed(block.owner.astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys)
    same = keys[order]
    runs = np.flatnonzero(np.concatenate(([True], same[1:] != same[:-1]))) if len(same) else np.zeros(0, np.int64)
    most = np.zeros(len(block), np.int64)
    np.maximum.at(most, block.owner[order[runs]], np.diff(np.append(runs, len(same))))
    return (block.counts >= 50) & (10 * most > 3 * block.counts)


RULES = (
    Rule("symbols", _symbols),
    Rule("shouting", _shouting),
    Rule("exclaiming", _exclaiming),
    Rule("long_words", _long_words),
    Rule("few_letters", _few_letters),
    Rule("same_lines", _same_lines),
    Rule("one_word", _one_word),
)


def _lines(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: lines with a word, and those of them equal to an earlier line."""
    breaks = np.flatnonzero(block.data == 0x0A)
    edges = np.unique(np.concatenate((block.bounds, breaks)))
    is_break = np.zeros(len(block.data) + 1, bool)
    is_break[breaks] = True
    begins, ends = edges[:-1] + is_break[edges[:-1]], edges[1:]
    worded = np.searchsorted(block.starts, ends) > np.searchsorted(block.starts, begins)
    begins, ends = begins[worded], ends[worded]
    owner = np.searchsorted(block.bounds, begins, "right") - 1
    keys = span_hashes(block.data, begins, ends) ^ mixed(owner.astype(np.uint64) + np.uint64(1))
    earliest = np.unique(keys, return_index=True)[1]
    lines = np.bincount(owner, minlength=len(block))
    return lines, lines - np.bincount(owner[earliest], minlength=len(block))


def _repeated_words(block: Block, window: int) -> np.ndarray:
    """Of each text, words in a run of ``window`` words that it has twice or more."""
    begins = window_starts(block, window)
    if not len(begins):
        return np.zeros(len(block), np.int64)
    keys = window_hashes(block.hashes(), window)[begins] ^ mixed(block.owner[begins].astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.concatenate((same, [False])) | np.concatenate(([False], same))
    return block.per_text(covered(begins[order[twice]], window, len(block.starts)))


def cascade(block: Block, rules: Sequence[Rule], alive: np.ndarray) -> np.ndarray:
    """Which of the ``alive`` texts every rule lets pass, asked in the order given."""
    alive = alive.copy()
    left, part = np.flatnonzero(alive), None
    for rule in rules:
        if part is None:
            part = block.subset(alive)
        if not len(part):
            break
        rejected = rule.rejects(part)
        alive[left[rejected]] = False
        if rejected.any():
            left, part = np.flatnonzero(alive), None
    return alive


def measured_order(documents: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per second, best first, on at most ``sample_rows`` rows of
    each partition, where they are. Sums per rule come to the driver. Without rows the
    order stays as given."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = next(iter(batches), None)
        for block in blocks(texts.column(0).slice(0, sample_rows)) if texts is not None else ():
            for number, rule in enumerate(rules):
                began = time.perf_counter()
                rejected = int(rule.rejects(block).sum())
                yield pa.record_batch(
                    [[number], [time.perf_counter() - began], [rejected]], names=["rule", "seconds", "rejected"]
                )

    measured = documents.select("text").mapInArrow(measure, "rule long, seconds double, rejected long")
    found = measured.groupBy("rule").sum("seconds", "rejected").collect()
    gain = {row[0]: (row[2] + 1e-3) / max(row[1], 1e-9) for row in found}
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: -gain.get(i, 0.0))]


def quality_verdicts(
    documents: DataFrame,
    rules: Sequence[Rule] = RULES,
    sample_rows: int = SAMPLE_ROWS,
    window: int = WINDOW,
    least_words: int = LEAST_WORDS,
    most_repeated_percent: int = MOST_REPEATED_PERCENT,
) -> DataFrame:
    """One row per row of ``documents``: ``doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept``.

    ``base_failed``: fewer than ``least_words`` words, or more than
    ``most_repeated_percent`` % of them repeated. ``kept`` needs that and every rule to
    pass. A null text has no words, so it fails; a null ``doc_id`` is kept as a null.
    Repeated rows are judged one by one; other columns are ignored. No shuffle.
    """
    ordered = measured_order(documents, rules, sample_rows)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                inside = np.zeros(len(block.data) + 1, np.int8)
                inside[block.starts] += 1
                inside[block.ends] -= 1
                inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
                words = block.counts
                repeated = _repeated_words(block, window)
                failed = (words < least_words) | (100 * repeated > most_repeated_percent * words)
                figures = [
                    words,
                    code_points(block, inside),
                    block.byte_sums(_SYMBOLS[block.data]),
                    _lines(block)[1],
                    repeated,
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(block.lo, len(block)),
                        *(pa.array(f.astype(np.int64)) for f in figures),
                        pa.array(failed),
                        pa.array(cascade(block, ordered, ~failed)),
                    ],
                    names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
                )

    schema = (
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
        "n_repeat_words long, base_failed boolean, kept boolean"
    )
    return documents.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(judge, schema)
