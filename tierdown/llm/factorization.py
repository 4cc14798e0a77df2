"""Quality classifier: a factorisation machine over hashed words and text structure.

    score = sigmoid(b + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2])

The bracket is the sum over all pairs of features of their low-rank interaction, in
time linear in the features of a text. Features are hashed lower-case words (counts,
scaled to unit length) and figures of structure and size, each as one of a few
quantile bins. Who wrote a text, where, in what language and under what id is not
looked at.

The model is fitted on a bounded sample of labelled rows and sent to the tasks, which
score whole texts where they are read; scoring does not shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierdown.llm.words import Block, blocks, mixed, span_hashes

HASH_BITS = 16
FACTORS = 8
BINS = 12
TRAIN_ROWS = 8000  # bound on the labelled rows that are fitted; others are not needed
EPOCHS = 12
BATCH = 128
LEARNING_RATE = 0.1
SHRINKAGE = 1e-6
THRESHOLD = 0.3
FOLDS = 5
SEED = 20240131

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
_HIGH = np.arange(256) >= 0x80
_LETTER = _UPPER | np.roll(_UPPER, 32) | _HIGH
_STOPS = np.isin(np.arange(256), list(b".,;:!?"))
_MARKS = ~_LETTER & ~_DIGIT & ~_STOPS & (np.arange(256) > 32)

STATISTICS = (
    "log_bytes", "log_words", "mean_word", "upper", "digits", "high", "stops", "marks", "capital_words",
    "marked_words", "exclaimed_words", "bare_words", "lines_per_word", "distinct_words", "most_frequent",
    "same_neighbour", "twin_words",
)


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """Rows that never teach: the checksum of the id as text is a multiple of ``folds``."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


@dataclass
class Features:
    """Sparse words and dense statistics of the texts of one block."""

    bounds: np.ndarray
    index: np.ndarray
    value: np.ndarray
    statistics: np.ndarray


def features(block: Block, bits: int = HASH_BITS) -> Features:
    words = span_hashes(_LOWER[block.data], block.starts, block.ends)
    owner, n = block.owner, np.maximum(block.counts, 1)
    keys, counts = np.unique((owner.astype(np.int64) << bits) | (words & np.uint64((1 << bits) - 1)).astype(np.int64), return_counts=True)
    of, index = keys >> bits, (keys & ((1 << bits) - 1)).astype(np.int32)
    bounds = np.searchsorted(of, np.arange(len(block) + 1))
    squares = np.zeros(len(block))
    np.add.at(squares, of, counts.astype(float) ** 2)
    value = (counts / np.sqrt(np.maximum(squares[of], 1))).astype(np.float32)

    size = np.maximum(np.diff(block.bounds), 1)
    share = lambda table: block.byte_sums(table[block.data]) / size
    first, last = block.data[block.starts], block.data[block.ends - 1]
    lengths = block.ends - block.starts
    marked = np.concatenate(([0], np.cumsum(_MARKS[block.data])))
    lettered = np.concatenate(([0], np.cumsum(_LETTER[block.data])))
    before_last = block.data[np.maximum(block.ends - 2, 0)]
    most = np.zeros(len(block), np.int64)
    np.maximum.at(most, of, counts)
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    twins = words ^ mixed(owner.astype(np.uint64) + np.uint64(1))
    twins = twins + np.roll(twins, -1) * np.uint64(3)
    order = np.argsort(twins)
    again = np.concatenate(([False], twins[order][1:] == twins[order][:-1])) if len(order) else np.zeros(0, bool)
    repeated = np.zeros(len(words), bool)
    repeated[order] = again
    per_word = lambda flags: block.per_text(flags) / n
    statistics = np.stack(
        [
            np.log1p(np.diff(block.bounds)),
            np.log1p(block.counts),
            per_word(lengths),
            share(_UPPER),
            share(_DIGIT),
            share(_HIGH),
            share(_STOPS),
            share(_MARKS),
            per_word(_UPPER[first]),
            per_word(marked[block.ends] > marked[block.starts]),
            per_word((last == 0x21) & (before_last == 0x21) & (lengths > 1)),
            per_word(lettered[block.ends] == lettered[block.starts]),
            block.byte_sums(block.data == 0x0A) / n,
            np.diff(bounds) / n,
            most / n,
            per_word(same),
            per_word(repeated),
        ],
        axis=1,
    )
    return Features(bounds, index, value, statistics.astype(np.float64))


@dataclass
class Model:
    """``edges`` cut each statistic into bins; feature ``2 ** bits + s * bins + b`` is bin
    ``b`` of statistic ``s``."""

    bits: int
    edges: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def binned(self, statistics: np.ndarray) -> np.ndarray:
        bins = self.edges.shape[1] + 1
        found = np.stack([np.searchsorted(e, s, "right") for e, s in zip(self.edges, statistics.T)], axis=1)
        return (1 << self.bits) + found + bins * np.arange(len(self.edges))

    def scores(self, found: Features) -> np.ndarray:
        """The machine itself, for each text of a block."""
        x, dense = found.value[:, None], self.binned(found.statistics)
        scale = np.float32(1 / np.sqrt(dense.shape[1]))
        linear = _sums(self.linear[found.index] * found.value, found.bounds) + self.linear[dense].sum(1) * scale
        held = self.factors[found.index] * x
        inner = self.factors[dense] * scale
        total = _sums(held, found.bounds) + inner.sum(1)
        squares = _sums(held**2, found.bounds) + (inner**2).sum(1)
        z = self.bias + linear + 0.5 * (total**2 - squares).sum(1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum over each range; empty ranges give 0."""
    out = np.zeros((len(bounds) - 1, *values.shape[1:]), np.float64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full] = np.add.reduceat(values, bounds[full], axis=0)
    return out


def fitted(samples: list[Features], labels: np.ndarray, bits: int = HASH_BITS, factors: int = FACTORS, bins: int = BINS, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Logistic loss, AdaGrad over small batches. With labels of one kind, or none, the
    model is the constant rate of label 1 (a half without rows)."""
    statistics = np.concatenate([f.statistics for f in samples]) if samples else np.zeros((0, len(STATISTICS)))
    quantiles = np.linspace(0, 1, bins + 1)[1:-1]
    edges = np.quantile(statistics, quantiles, axis=0).T if len(statistics) else np.zeros((len(STATISTICS), bins - 1))
    random = np.random.default_rng(seed)
    size = (1 << bits) + len(STATISTICS) * bins
    model = Model(bits, edges, 0.0, np.zeros(size, np.float32), random.normal(0, 0.01, (size, factors)).astype(np.float32))
    rate = (labels.sum() + 1) / (len(labels) + 2)
    model.bias = float(np.log(rate / (1 - rate)))
    if len(np.unique(labels)) < 2:
        model.factors[:] = 0
        return model

    dense = model.binned(statistics)
    scale = 1 / np.sqrt(dense.shape[1])
    counts = np.concatenate([np.diff(f.bounds) for f in samples])
    first = np.concatenate(([0], np.cumsum(counts)))
    # features stay as narrow as they came; only those of a batch are widened
    index, value = (parts[0] if len(parts) == 1 else np.concatenate(parts) for parts in ([f.index for f in samples], [f.value for f in samples]))
    seen_w, seen_v, seen_b = np.full(size, 1e-2), np.full((size, factors), 1e-2), 1e-2
    for _ in range(epochs):
        order = random.permutation(len(labels))
        for begin in range(0, len(order), BATCH):
            rows = order[begin : begin + BATCH]
            spans = np.concatenate([np.arange(first[r], first[r + 1]) for r in rows])
            at = np.concatenate((index[spans], dense[rows].ravel()))
            x = np.concatenate((value[spans].astype(np.float64), np.full(dense[rows].size, scale)))
            of = np.concatenate((np.repeat(np.arange(len(rows)), counts[rows]), np.repeat(np.arange(len(rows)), dense.shape[1])))
            v = model.factors[at].astype(np.float64)
            held = v * x[:, None]
            total = np.zeros((len(rows), factors))
            np.add.at(total, of, held)
            squares = np.bincount(of, (held**2).sum(1), len(rows))
            z = model.bias + np.bincount(of, model.linear[at] * x, len(rows)) + 0.5 * ((total**2).sum(1) - squares)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[rows]) / len(rows) * 32
            places, back = np.unique(at, return_inverse=True)
            g_w = np.bincount(back, error[of] * x, len(places)) + SHRINKAGE * model.linear[places]
            g_v = np.stack(
                [np.bincount(back, error[of] * x * (total[of, f] - held[:, f]), len(places)) for f in range(factors)], axis=1
            ) + SHRINKAGE * model.factors[places]
            seen_w[places] += g_w**2
            seen_v[places] += g_v**2
            seen_b += error.sum() ** 2
            model.linear[places] -= LEARNING_RATE * g_w / np.sqrt(seen_w[places])
            model.factors[places] -= LEARNING_RATE * 0.3 * g_v / np.sqrt(seen_v[places])
            model.bias -= LEARNING_RATE * error.sum() / np.sqrt(seen_b)
    return model


def trained(documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, bits: int = HASH_BITS) -> Model:
    """A model of at most ``train_rows`` labelled rows, the first by a hash of their id;
    held-out rows and rows without id, label or text are left aside."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
        .dropDuplicates(["doc_id"])
        .orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id")
        .limit(train_rows)
    )
    # at most train_rows ids, so this side always fits; of rows that repeat an id the text
    # with the smallest hash counts, so that no more rows than ids come to the driver
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.first("quality").alias("quality"), F.min_by("text", F.xxhash64("text")).alias("text"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(2)):
                f = features(block, bits)
                parts = lambda values: [values[a:b] for a, b in zip(f.bounds[:-1], f.bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(block.lo, len(block)),
                        batch.column(1).slice(block.lo, len(block)),
                        pa.array(parts(f.index), pa.list_(pa.int32())),
                        pa.array(parts(f.value), pa.list_(pa.float32())),
                        pa.array(list(f.statistics), pa.list_(pa.float64())),
                    ],
                    names=["doc_id", "quality", "index", "value", "statistics"],
                )

    row = "doc_id long, quality int, index array<int>, value array<float>, statistics array<double>"
    # in order of the ids, so that the fit does not depend on how the rows are laid out
    rows = texts.mapInArrow(extract, row).toArrow().sort_by("doc_id")
    if not len(rows):
        return fitted([], np.zeros(0), bits)
    # the lists are read where Arrow holds them: as Python numbers they are nine times the size
    flat = lambda name: rows.column(name).combine_chunks().flatten().to_numpy()
    bounds = np.concatenate(([0], np.cumsum(pc.list_value_length(rows.column("index")).to_numpy(), dtype=np.int64)))
    sample = Features(bounds, flat("index"), flat("value"), flat("statistics").reshape(len(rows), len(STATISTICS)))
    return fitted([sample], rows.column("quality").to_numpy().astype(np.float64), bits)


def quality_scores(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``documents``: ``doc_id, held_out, score, predicted``.

    A null or empty text has no words and zero statistics and is scored like any other.
    A null ``doc_id`` is kept and is not held out. Other columns are ignored; no shuffle.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(2)):
                scores = shared.value.scores(features(block, shared.value.bits))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(block.lo, len(block)),
                        batch.column(1).slice(block.lo, len(block)),
                        pa.array(scores, pa.float64()),
                        pa.array((scores >= threshold).astype(np.int32)),
                    ],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id").cast("long")).alias("held_out"), "text"
    ).mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def good_documents(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``documents`` that score ``threshold`` or more, with all their columns."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    text = documents.columns.index("text")

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(text)):
                good = shared.value.scores(features(block, shared.value.bits)) >= threshold
                yield batch.slice(block.lo, len(block)).filter(pa.array(good))

    return documents.mapInArrow(select, documents.schema)
