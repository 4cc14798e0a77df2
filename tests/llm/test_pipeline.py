"""The pipeline, stage by stage, against plain versions; and decontamination against all shifts."""

from __future__ import annotations

import random
import re
import time
from collections import Counter, defaultdict

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from test_passages import linked, shingles
from tierdown.llm import pieces_fst
from tierdown.llm.factorization import quality_scores, trained
from tierdown.llm.spaced_seeds import leaked_items

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string"


def plain_words(text):
    """Lower-case words as the masks compare them, by Python's own classes of characters."""
    import regex

    return regex.findall(r"[\p{L}\p{M}\p{N}]+", (text or "").lower())


def plain_leaks(docs, items):
    """(doc, item) pairs by comparing each item at every shift of every text."""
    found = set()
    for doc_id, text in docs:
        words = plain_words(text)
        for item_id, item in items:
            sought = plain_words(item)
            size = min(13, len(sought))
            if not size:
                continue
            for shift in range(-(len(sought) - size), len(words) - size + 1):
                begin, end = max(0, -shift), min(len(sought), len(words) - shift)
                same = [sought[k] == words[k + shift] for k in range(begin, end)]
                now = sum(same[:size])
                best = now
                for k in range(size, len(same)):
                    now += same[k] - same[k - size]
                    best = max(best, now)
                if len(same) >= size and best >= -(-8 * size // 10):
                    found.add((doc_id, item_id))
                    break
    return found


def test_leaks_equal_all_shifts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in leaked_items(docs, bench).collect()}
    short = docs.where(F.length("text") < 6000)
    plain = plain_leaks([(r.doc_id, r.text) for r in short.collect()], [(r.item_id, r.text) for r in bench.collect()])
    kept = {r.doc_id for r in short.select("doc_id").collect()}
    assert plain and {p for p in got if p[0] in kept} == plain


def test_a_long_text_of_many_hits_is_taken_apart_once(spark):
    rng = random.Random(2)
    passage = " ".join(f"t{k}" for k in range(30))
    words = " ".join(f"{' '.join(f'd{rng.randrange(900)}' for _ in range(70))} {passage}" for _ in range(1000))
    docs = spark.createDataFrame([(1, words), (2, "none of it")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, passage)], "item_id long, text string")
    started = time.perf_counter()
    found = leaked_items(docs, bench).collect()
    assert {(r.doc_id, r.item_id, r.best_run) for r in found} == {(1, 7, 13)}
    assert time.perf_counter() - started < 60


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with nulls, empty and repeated rows, and a column of a clashing name."""
    at = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("words", F.lit("clash"))
    rows = [tuple(r) for r in docs.limit(3).collect()]
    odd = [*rows, rows[0], (None, rows[1][1], "en", None, 3, None), (9001, None, None, "s", None, "x"), (9002, "", "en", "s", 0, "x"), (9003, "word " * 30, "en", "s", 150, "x")]
    docs.select(*[c.split()[0] for c in SCHEMA.split(", ")]).unionByName(spark.createDataFrame(odd, SCHEMA)).repartition(3).write.parquet(f"{at}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{at}/{name}.parquet")
    return at


def test_each_stage_equals_its_plain_version(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, [tuple(r) for r in docs.collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == [
        "quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "SentencePiece encoding and decoding",
    ]

    def run(name, rows):
        df = spark.createDataFrame(rows, docs.schema).repartition(4)
        out = stages[name](spark, df, folder)
        return df, out, [tuple(r) for r in out.collect()]

    # 1: what the classifier scores below its threshold goes
    df, out, kept = run("quality classifier", before)
    model = trained(df, spark.read.parquet(f"{folder}/labels.parquet"))
    good = Counter((r.doc_id, r.predicted) for r in quality_scores(df, model).collect())
    assert out.columns == columns and Counter(r[0] for r in kept) == Counter({i: n for (i, p), n in good.items() if p})
    assert not Counter(kept) - Counter(before) and 0 < len(kept) < len(before)

    # 2: lines on more than a tenth of the pages of a source, and on five of them
    df, out, cleaned = run("line dedup", kept)
    at = {c: n for n, c in enumerate(columns)}
    pages, held = Counter(), defaultdict(Counter)
    for row in kept:
        if row[at["source"]] is not None:
            pages[row[at["source"]]] += 1
            held[row[at["source"]]].update({x for x in (row[at["text"]] or "").split("\n") if re.search(r"\S", x, re.A)})
    expected = []
    for row in kept:
        host, text = row[at["source"]], row[at["text"]]
        if text is not None and host is not None:
            text = "\n".join(x for x in text.split("\n") if not (held[host][x] >= 5 and held[host][x] > 0.1 * pages[host]))
        row = list(row)
        row[at["text"]], row[at["n_chars"]] = text, None if text is None else len(text)
        expected.append(tuple(row))
    assert out.columns == columns and Counter(cleaned) == Counter(expected)

    # 3: one row of each class of linked texts
    df, out, single = run("n-gram Jaccard join", cleaned)
    verdicts = linked([(n, r[at["text"]]) for n, r in enumerate(cleaned)])
    classes = Counter()
    for (n, name, _, _), row in zip(verdicts, cleaned):
        classes[name] += bool(shingles(row[at["text"]]))
    lone = sum(not shingles(r[at["text"]]) for r in cleaned)
    assert out.columns == columns and not Counter(single) - Counter(cleaned)
    assert len(single) == lone + sum(n > 0 for n in classes.values())

    # 4: no text with a passage of the benchmark
    df, out, clean = run("benchmark decontamination", single)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    short = [r for r in single if len(r[at["text"]] or "") < 6000]
    numbered = list(enumerate(short))
    leaks = {n for n, _ in plain_leaks([(n, r[at["text"]]) for n, r in numbered], items)}
    stays = Counter(r for n, r in numbered if n not in leaks)
    assert out.columns == columns and Counter(r for r in clean if len(r[at["text"]] or "") < 6000) == stays

    # 5: ids of the published library, which decode to the text
    df, out, _ = run("SentencePiece encoding and decoding", clean)
    library = sentencepiece.SentencePieceProcessor(model_file=pieces_fst.MODEL)
    texts = Counter((r[at["doc_id"]], tuple(library.encode(r[at["text"]] or ""))) for r in clean)
    assert Counter((r.doc_id, tuple(r.ids)) for r in out.collect()) == texts
    assert out.where("not round_trip").count() == 0

    # and all of them in a row
    assert Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, folder).collect()) == texts


def test_no_documents(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
