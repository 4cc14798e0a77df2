"""A training corpus from raw documents, in five stages.

Each stage takes what the one before it kept, written as Parquet and read again; its
decisions take effect on the rows or texts that go on. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierdown.llm.factorization import good_documents, trained
from tierdown.llm.line_frequency import drop_boilerplate_lines
from tierdown.llm.ngram_join import one_of_each
from tierdown.llm.pieces_fst import encoded, load
from tierdown.llm.spaced_seeds import clean_documents
from tierdown.scratch import scratch_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fits the factorisation machine on labelled rows and drops what it scores low."""
    return good_documents(docs, trained(docs, _table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the lines that are boilerplate of their source; documents stay."""
    cleaned = drop_boilerplate_lines(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*docs.columns)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    return clean_documents(docs, _table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes each text, and checks that the ids decode to it."""
    return encoded(docs, load(), columns=("doc_id", "lang", "source", "n_chars"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_join),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: SQL has no transducer and no fitted model; tests/llm/test_pipeline.py compares each
#: stage of run() with a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    at = scratch_dir(spark, "corpus")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{number}")
        docs = spark.read.parquet(f"{at}/{number}")
    return docs
