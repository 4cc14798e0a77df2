"""Words, repeated passages, quality rules, near-duplicates and lines, against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tierdown.llm.components import components
from tierdown.llm.difference_cover import _chunked, removed_passages
from tierdown.llm.line_frequency import drop_boilerplate_lines
from tierdown.llm.ngram_join import banding, near_duplicates, one_of_each
from tierdown.llm.quality_cascade import RULES, cascade, measured_order, quality_verdicts
from tierdown.llm.words import blocks, window_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", None, " \t\n ", "one", "a b c\u0085d\x1ce", "é" * 50, "x" * 3000, "\n\n\nline\nline\n"]


def documents(spark, rows, extra="lang string, words string, h long"):
    return spark.createDataFrame([(i, t, "en", "clash", 7) for i, t in rows], f"doc_id long, text string, {extra}")


def mutated(seed=5, count=60, vocabulary=40):
    """Texts that share passages, with copies, near copies, ties and odd texts."""
    rng = random.Random(seed)
    base = [[rng.choice("abcdefghij") + str(rng.randrange(vocabulary)) for _ in range(rng.randrange(5, 90))] for _ in range(12)]
    rows = []
    for i in range(count):
        words = list(rng.choice(base))
        if rng.random() < 0.5:
            other = rng.choice(base)
            at = rng.randrange(len(other))
            words[rng.randrange(len(words)) : 0] = other[at : at + 30]
        for _ in range(rng.choice([0, 0, 1, 3])):
            words[rng.randrange(len(words))] = "new" + str(rng.randrange(9))
        rows.append((rng.randrange(1000), " ".join(words).replace(" new1 ", "\n\t ")))
    rows += [(2000 + i, t) for i, t in enumerate(ODD)]
    return rows + [(None, rows[0][1]), (None, None), rows[3], rows[3]]


@pytest.mark.parametrize("size", [1, 64, 1 << 20])
def test_words_are_those_of_the_pattern(size):
    texts = [t for _, t in mutated()]
    found = []
    for block in blocks(pa.array(texts, pa.string()).slice(1), size):
        for i in range(len(block)):
            span = slice(block.first[i], block.first[i + 1])
            found.append([block.data[s:e].tobytes().decode() for s, e in zip(block.starts[span], block.ends[span])])
    assert found == [WORD.findall(t or "") for t in texts[1:]]


def test_hashes_do_not_depend_on_the_place():
    whole = next(blocks(pa.array(["aa bb cc dd aa bb cc", "bb cc", "é bb cc"])))
    h = whole.hashes()
    assert h[0] == h[4] and h[1] == h[7] and len(set(h.tolist())) == 5
    pairs = window_hashes(h, 2)
    assert pairs[1] == pairs[5] == pairs[7]


def removed(rows, size=13):
    first = {}
    for i, t in rows:
        words = WORD.findall(t or "")
        for k in range(len(words) - size + 1):
            if i is not None:
                key = tuple(words[k : k + size])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        words = WORD.findall(t or "")
        gone = [False] * len(words)
        for k in range(len(words) - size + 1):
            if i is not None and first[tuple(words[k : k + size])] < i:
                gone[k : k + size] = [True] * size
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk_bytes", [200, 1 << 24])
def test_passages_equal_brute_force(spark, chunk_bytes):
    rows = mutated()
    found = removed_passages(documents(spark, rows), chunk_bytes=chunk_bytes, with_text=True).collect()
    assert sorted((tuple(r) for r in found), key=str) == removed(rows)
    assert sum(r.n_removed for r in found) > 100


def test_repeated_rows_are_spread_over_chunks(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(7, text)] * 60 + [(None, text)] * 60 + [(7, None), (None, ""), (9, text)]
    df = documents(spark, rows).repartition(12)
    chunks = _chunked(df, 1 << 24).groupBy("doc_id", "text").agg(F.count_distinct("chunk").alias("n")).collect()
    assert {(r.doc_id, r.n > 3) for r in chunks if r.text == text} == {(7, True), (None, True), (9, False)}
    found = removed_passages(df, with_text=True).collect()
    assert sorted((tuple(r) for r in found), key=str) == removed(rows)


def test_passages_of_other_sizes_and_wrong_covers(spark):
    rows = mutated(seed=8)
    found = removed_passages(documents(spark, rows), window=8, period=3, cover=(0, 1), with_text=True).collect()
    assert sorted((tuple(r) for r in found), key=str) == removed(rows, 8)
    with pytest.raises(ValueError):
        removed_passages(documents(spark, rows), period=7, cover=(0, 1))


def test_no_rows(spark):
    empty = documents(spark, [])
    assert removed_passages(empty).count() == 0
    assert quality_verdicts(empty).count() == 0
    assert near_duplicates(empty).count() == 0
    assert one_of_each(empty).count() == 0
    assert drop_boilerplate_lines(empty, host="lang").count() == 0


def test_quality_figures_equal_brute_force(spark):
    rows = mutated(seed=2) + [(9000, "a b c d e f g h\n" * 9), (9001, "ok\n\nok\r\nok\n" * 20)]
    found = quality_verdicts(documents(spark, rows)).collect()
    expected = []
    for i, t in rows:
        t = t or ""
        words, seen = WORD.findall(t), {}
        for k in range(len(words) - 7):
            seen.setdefault(tuple(words[k : k + 8]), []).append(k)
        repeated = {x for v in seen.values() if len(v) > 1 for k in v for x in range(k, k + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
        symbols = sum(c in "#*$%&|<>" for c in t)
        expected.append((i, len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(repeated), failed))
    assert sorted((tuple(r)[:7] for r in found), key=str) == sorted(expected, key=str)
    assert not any(r.kept and r.base_failed for r in found)


def test_cascade_gives_the_same_in_any_order(spark):
    clean = "Plain words of a sentence that goes on for long enough to be read by anyone who cares to."
    texts = [clean, clean.upper(), "x! " * 60, "a| " * 40, "12 34 " * 30, "same\n" * 30 + clean, "wow!! " * 30, "", "y" * 9000]
    block = next(blocks(pa.array(texts)))
    apart = ~np.any([rule.rejects(block) for rule in RULES], axis=0)
    for order in (RULES, RULES[::-1], RULES[3:] + RULES[:3]):
        assert cascade(block, order, np.ones(len(texts), bool)).tolist() == apart.tolist()
    assert apart[0] and not apart[1:4].any()
    alive = np.zeros(len(texts), bool)
    assert not cascade(block, RULES, alive).any()
    df = documents(spark, list(enumerate(texts)))
    assert sorted(r.name for r in measured_order(df)) == sorted(r.name for r in RULES)
    assert measured_order(df.limit(0)) == list(RULES)


def shingles(text):
    words = WORD.findall(text or "")
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))


def linked(rows):
    """Links and smallest id of each row's component, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    root, links = list(range(len(rows))), Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return [(rows[a][0], least.get(find(a)) if sets[a] else rows[a][0], links[a], len(sets[a])) for a in range(len(rows))]


@pytest.mark.parametrize("block_classes", [2, 256])
def test_near_duplicates_equal_all_pairs(spark, block_classes):
    rows = mutated(seed=11, count=80)
    words = [f"w{k}" for k in range(300)]
    for i in range(40):  # one long chain of small changes
        words[i * 7] = f"changed{i}"
        rows.append((3000 + i, " ".join(words)))
    found = near_duplicates(documents(spark, rows), block_classes=block_classes)
    got = sorted((tuple(r) for r in found.select("doc_id", "class_id", "n_links", "n_grams").collect()), key=str)
    assert got == sorted(linked(rows), key=str)
    assert max(r[2] for r in got) > 10


def test_one_of_each_class_stays(spark):
    rows = [(None if i is None else i + 10_000 * n, t) for n, (i, t) in enumerate(mutated(seed=11, count=80))]
    rows += [rows[5], rows[5]]
    verdicts = linked(rows)
    kept = one_of_each(documents(spark, rows))
    assert kept.columns == documents(spark, []).columns
    classes = Counter(v[1] for v, (_, t) in zip(verdicts, rows) if shingles(t))
    ids = Counter(r.doc_id for r in kept.where(F.col("text").rlike(r"\S")).collect())
    assert all(ids[c] == 1 for c in classes if c is not None)
    assert kept.where(~F.coalesce(F.col("text"), F.lit("")).rlike(r"\S")).count() == sum(not shingles(t) for _, t in rows)


def test_banding_reaches_the_recall():
    for similarity, recall in ((0.8, 0.999), (0.5, 0.9), (0.95, 0.99)):
        bands, rows = banding(similarity, recall, 200)
        assert 1 - (1 - similarity**rows) ** bands >= recall and bands * rows <= 200
    with pytest.raises(ValueError):
        banding(0.2, 0.9999, 4)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, None), (150, 100)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}


def test_rounds_of_components_run_few_tasks(spark):
    session = spark.newSession()  # of its own, so that no other test sees the settings
    for key, value in (("shuffle.partitions", 64), ("adaptive.coalescePartitions.enabled", "false"), ("autoBroadcastJoinThreshold", -1)):
        session.conf.set(f"spark.sql.{key}", value)
    edges = session.createDataFrame([(i, i + 1) for i in range(40)], "a int, b int")
    session.sparkContext.setJobGroup("rounds", "rounds of components")
    try:
        found = {r.node: r.component for r in components(edges).collect()}
    finally:
        session.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found == dict.fromkeys(range(41), 0)
    tracker = session.sparkContext.statusTracker()
    stages = {s for job in tracker.getJobIdsForGroup("rounds") for s in tracker.getJobInfo(job).stageIds}
    ran = sum(info.numCompletedTasks for info in map(tracker.getStageInfo, stages) if info)
    assert 64 < ran < 5000  # twice as many when each round read all partitions again


def test_lines_go_by_their_share_of_the_host(spark):
    menu, rare = "Home | About", "Only here"
    rows = [(f"{menu}\npage {i}\n\n{menu}" + f"\n{rare}" * (i < 2), "big.org", i) for i in range(20)]
    rows += [(menu, "small.org", i) for i in range(3)] + [(menu, None, 1), (None, "big.org", 2), ("", "big.org", 3), (menu, "big.org", 3)]
    df = spark.createDataFrame(rows, "text string, host string, seen long").withColumn("n_lines", F.lit(-1))
    found = drop_boilerplate_lines(df, host="host", ratio=0.5, least_pages=5)
    got = Counter((r.text, r.host, r.n_lines, r.n_dropped) for r in found.collect())
    expected = Counter((f"page {i}\n" + f"\n{rare}" * (i < 2), "big.org", 4 + (i < 2), 2) for i in range(20))
    expected += Counter([(menu, "small.org", 1, 0)] * 3 + [(menu, None, 1, 0), (None, "big.org", 0, 0), ("", "big.org", 1, 0), ("", "big.org", 1, 1)])
    assert got == expected


def test_one_of_rows_that_differ_elsewhere(spark):
    rows = [(1, "a b c d e f g h", f"s{n}") for n in range(4)] + [(None, "a b c d e f g h", "x")] * 3 + [(2, "other words are here to stay", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = [{(r.doc_id, r.source) for r in one_of_each(df.repartition(n)).collect()} for n in (1, 5)]
    assert kept[0] == kept[1] and len(kept[0]) == 2 and (2, "y") in kept[0]
    lone = spark.createDataFrame([(None, "q w e r t y u", f"{n % 2}") for n in range(6)], "doc_id long, text string, source string")
    near = lone.unionByName(spark.createDataFrame([(9, "q w e r t y u i", "z")], lone.schema))
    found = near_duplicates(near).collect()
    assert len(found) == 7
