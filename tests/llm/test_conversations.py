"""Conversation repair, prefix trie and URL filters, against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest

from tierdown.llm import structure_repair as repair

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string"


def odd_conversations(seed=5):
    rng = random.Random(seed)
    texts = ["Yes.", "no", "", None, " \t", "Why?!", "a. b", "é…", "x" * 3000, "end.\n"]
    roles = ["user", "assistant", "system", "tool", None, "", "User", "ua"]
    rows = [(c, rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts)) for c in range(90) for _ in range(rng.randrange(0, 9))]
    rows += [(500, t, rng.choice(roles[:3]), rng.choice(texts[:2])) for t in range(700)]
    rows += [(None, t, "user", "lost.") for t in (None, 1, 2)] + [(7, 1, "user", "Yes.")] * 3 + [(-3, 0, "system", "s")]
    return rows


def table(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return df.withColumn("symbol", F.lit("clash")).withColumn("segment", F.lit(1)).withColumn("_row", F.lit(1)).withColumn("h", F.lit(2))


# ---- repair --------------------------------------------------------------------------


def first_null(value):
    return (value is not None, value if value is not None else 0)


def least_repair(symbols):
    """(cost, audit) by plain recursion; a symbol is (initial, must go, truncated)."""
    step = {"": "su", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def best(at, state, inserted):
        found = []
        if at == len(symbols) and state in ("", "a"):
            found.append((0, ""))
        if inserted < 3:
            for letter in step[state].replace("s", ""):
                cost, audit = best(at, letter, inserted + 1)
                found.append((cost + 3, "I" + audit))
        if at < len(symbols):
            initial, goes, cut = symbols[at]
            cost, audit = best(at + 1, state, 0)
            found.append((cost + 4, "D" + audit))
            for letter in "" if goes else step[state]:
                if letter == initial:
                    cost, audit = best(at + 1, letter, 0)
                    found.append((cost + 3 * cut, "K" + audit))
                if letter != "s":
                    cost, audit = best(at + 1, letter, 0)
                    found.append((cost + 3 + 3 * cut, "R" + audit))
        return min(found) if found else (10**9, "")

    for at in range(len(symbols), -1, -1):  # keeps the recursion shallow
        for state in step:
            best(at, state, 0)
    return best(0, "", 0)


def brute_repairs(rows):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn, role if role is not None else " ", text if text is not None else " "))
    out = {}
    for conv, found in groups.items():
        left = []
        for turn, role, text in sorted(found, key=lambda r: (first_null(r[0]), r[1].encode(), r[2].encode())):
            chance = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if chance == 1 else re.sub("[.!?]", "", text) if chance == 2 else text
            left += [(turn, "user" if chance == 4 else role, text)] * (0 if chance == 0 else 2 if chance == 3 else 1)
        turns = [t for t, _, _ in left if t is not None]
        seen, symbols, faults = set(), [], [0, 0, 0]
        for _, role, text in left:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            blank, again = not solid, (role, text) in seen
            cut = not blank and not again and solid[-1] not in ".!?"
            seen.add((role, text))
            for n, fault in enumerate((blank, again and not blank, cut)):
                faults[n] += fault
            symbols.append((role[:1], blank or again, cut))
        pairs = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(symbols, symbols[1:]))
        cost, audit = least_repair(tuple(symbols))
        text, state, at = [], "", 0
        for edit in audit:
            wanted = "a" if state == "u" else "u"
            if edit == "I":
                text.append(f"{ {'u': 'user', 'a': 'assistant'}[wanted] }:")
                state = wanted
                continue
            _, role, said = left[at]
            at += 1
            if edit == "K":
                text.append(f"{role}:{said}")
                state = role[:1]
            elif edit == "R":
                text.append(f"{ {'u': 'user', 'a': 'assistant'}[wanted] }:{said}")
                state = wanted
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (conv, gaps, *faults, pairs, cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest())
    return out


@pytest.mark.parametrize("segment", [3, 256])
def test_repairs_equal_plain_recursion(spark, segment):
    rows = odd_conversations()
    got = {r.conv_id: tuple(r) for r in repair.repaired_conversations(table(spark, rows), segment).collect()}
    assert got == brute_repairs(rows)
    assert all(re.fullmatch("[KRDI]*", r[7]) for r in got.values())


def test_repairs_of_the_given_table_and_of_none(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    got = {r.conv_id: tuple(r) for r in repair.repaired_conversations(df).collect()}
    assert got == brute_repairs([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    assert repair.repaired_conversations(df.limit(0)).count() == 0


def test_matrices_by_rules_equal_matrices_by_symbols(spark):
    rng = random.Random(3)
    symbols = [*repair.symbol_matrices()]
    words = ["".join(rng.choices(symbols[:5], k=rng.randrange(1, 40))) for _ in range(60)] + ["ab" * 50, symbols[0] * 33]
    rules, short = repair.re_pair(spark.createDataFrame([(w,) for w in words], "word string"))
    assert rules and max(len(r.short) for r in short.collect()) < 40
    known, plain = repair.grammar_matrices(rules), repair.symbol_matrices()
    for row in short.collect():
        one, other = repair._factor(row.short, known), repair._factor(row.word, plain)
        assert {k: (c, str(a)) for k, (c, a) in one.items()} == {k: (c, str(a)) for k, (c, a) in other.items()}


# ---- trie ----------------------------------------------------------------------------


def brute_trie(rows):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            groups[conv].append((turn, role or "", text or ""))
    own = {c: [r[1:] for r in sorted(found, key=lambda r: (first_null(r[0]), r[1].encode(), r[2].encode()))] for c, found in groups.items()}
    whole = {}
    for c, found in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(abs(c) % 20 * (1 if c >= 0 else -1))
        whole[c] = tuple(own.get(base, [])[:h] + found[h:])
    members = defaultdict(list)
    for c, found in whole.items():
        for d in range(len(found) + 1):
            members[found[:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        children[node[:-1]] += bool(node)
    for node, found in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children.get(node)
            saved[node[:d]] += (len(found) - 1) * words
    out = []
    for node, found in members.items():
        ends = ",".join(str(c) for c in sorted(found) if whole[c] == node)
        parent = min(members[node[:-1]]) if node else None
        out.append((min(found), len(node), parent, len(found), children.get(node, 0), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("block", "shard"), [(4096, 200_000), (5, 7)])
def test_trie_equals_plain_dictionary(spark, block, shard):
    from tierdown.llm import prefix_trie

    rows = odd_conversations(8)
    rows = [r for r in rows if r[0] != 500] + [(500, t, "user", f"t {t % 3}") for t in range(60)]
    rows += [(600 + n, t, "user", f"same {t}") for n in range(120) for t in range(1 + n % 4)] + [(640, t, "system", "a b") for t in range(7)]
    got = sorted((tuple(r) for r in prefix_trie.prefix_nodes(table(spark, rows), block, shard).collect()), key=str)
    assert got == brute_trie(rows)


def test_trie_of_the_given_table_and_of_none(spark):
    from tierdown.llm.prefix_trie import prefix_nodes

    df = spark.read.parquet(f"{SF}/conversations.parquet")
    got = sorted((tuple(r) for r in prefix_nodes(df).collect()), key=str)
    assert got == brute_trie([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    assert prefix_nodes(df.limit(0)).count() == 0


def test_slot_table_is_minimal_and_tells_strangers_apart():
    import numpy as np

    from tierdown.llm.slot_table import SlotTable, distinct

    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        hi, lo = distinct(rng.integers(0, max(n // 3, 1), n, dtype=np.uint64), rng.integers(0, 1 << 63, n, dtype=np.uint64))
        found = SlotTable(hi, lo)
        assert sorted(found.slots(hi, lo).tolist()) == list(range(len(hi)))
        assert (found.slots(hi, lo + np.uint64(1 << 63)) == -1).all()
    with pytest.raises(ValueError):
        SlotTable(np.zeros(2, np.uint64), np.zeros(2, np.uint64))


def test_two_prefixes_of_one_digest_are_refused(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tierdown.llm import prefix_trie

    plain = prefix_trie._hashes
    monkeypatch.setattr(prefix_trie, "_hashes", lambda depth, code: [F.lit(5).cast("long"), F.lit(7).cast("long"), plain(depth, code)[2]])
    with pytest.raises(prefix_trie.DigestCollision):
        prefix_trie.prefix_nodes(spark.createDataFrame([(c, t, "a", f"{c} {t}") for c in (1, 2) for t in range(5)], SCHEMA))
