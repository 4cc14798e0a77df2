"""The registered queries of this subpackage: each applies one operator, with its
production parameters, to its whole table. ``ORACLES`` has the SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tierdown.llm import line_frequency, path_templates
from tierdown.llm.credentials import credential_spans
from tierdown.llm.difference_cover import removed_passages
from tierdown.llm.factorization import quality_scores, trained
from tierdown.llm.line_frequency import drop_boilerplate_lines
from tierdown.llm.ngram_join import near_duplicates
from tierdown.llm.page_template import page_texts
from tierdown.llm.path_templates import judged_urls
from tierdown.llm.pieces_fst import encoded, load
from tierdown.llm.prefix_trie import prefix_nodes
from tierdown.llm.quality_cascade import quality_verdicts
from tierdown.llm.spaced_seeds import leaked_items
from tierdown.llm.structure_repair import repaired_conversations
from tierdown.llm.warc_segments import archived_pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@_query
def op1_page_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_texts(_table(spark, sf_dir, "pages"))


@_query
def op2_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archived_pages(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", found.digest.alias("payload_digest"), "record_type", "refers_to")


@_query
def op3_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credential_spans(_table(spark, sf_dir, "documents"), reach=None)


@_query
def op4_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query
def op5_pieces_fst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(_table(spark, sf_dir, "documents"), load())


@_query
def op6_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = drop_boilerplate_lines(_table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "source", "text", "n_lines", "n_dropped")


ORACLES["op6_line_frequency"] = line_frequency.SQL.strip()


@_query
def op7_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(_table(spark, sf_dir, "documents"))


@_query
def op8_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_passages(_table(spark, sf_dir, "documents"))


@_query
def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_grams")


@_query
def op10_factorization_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return quality_scores(documents, trained(documents, _table(spark, sf_dir, "labels")))


@_query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_nodes(_table(spark, sf_dir, "conversations"))


@_query
def op12_path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_urls(_table(spark, sf_dir, "pages"))


ORACLES["op12_path_templates"] = path_templates.SQL.strip()


@_query
def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_conversations(_table(spark, sf_dir, "conversations"))
