"""Repair of conversation structure, by dynamic programming over a grammar.

Each turn is one symbol: the first letter of its role, and its first fault (blank,
duplicate, truncated). A conversation is a word over these symbols, and its cheapest
repair a product of matrices: one per symbol, 4 x 4 over the states of the automaton
for ``(s?(ua)+)?``, each entry a cost and the audit (the edits' initials) that costs it.
Entries are multiplied by adding costs and joining audits, and added by taking the
cheaper one, or of equal ones the ASCII-least audit. That is a semiring here: two audits
of one entry read the same turns, and if one began the other it would be cheaper.

Words repeat, and parts of words do, so the distinct words (cut into segments of
``SEGMENT`` turns) are compressed by Re-Pair: rounds that count neighbouring pairs on Spark
and replace the commonest by a new symbol. Each rule gets one matrix, the product of its
two halves, computed once, bottom-up, its audits kept as ropes; each distinct segment is
then a product of a few, shared by all conversations that hold it.

Nothing depends on how long a conversation is: turns are numbered by range-partitioned
scans, faults and segments are grouped by more than the conversation, and a segment's
matrix takes its place in the walk through its conversation as one row. The SHA-256 of a
repaired conversation is sequential by its nature; its turns are streamed through one task
in order, one at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierdown.operators.scans import ROW, running, sliced, written

SEGMENT = 256
#: The grammar is bounded; words are whole whatever it holds, only less shared.
MOST_RULES = 400
ROUNDS = 6
LEAST_PAIRS = 2

# fixed values: the costs of the contract
RETOUCH, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

# states: nothing yet, after a system turn, after a user turn, after an assistant turn
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
FINAL = (START, ASSISTANT)

#: Symbols: a letter for each role class and soundness, and one for turns that must go.
SYMBOLS = {(role, cut): chr(ord("a") + 2 * n + cut) for n, role in enumerate("sua-") for cut in (False, True)}
GOES = "i"
_MEANING = {symbol: key for key, symbol in SYMBOLS.items()}

# ---- ropes and matrices ------------------------------------------------------------------


#: Longer texts of ropes are not kept: a rope of many pieces would keep each beginning.
_REMEMBERED = 2 * SEGMENT


@dataclass(frozen=True)
class Rope:
    """An audit as a tree of shared halves; written out only when it is compared or used."""

    left: Rope | str
    right: Rope | str
    text: list = field(default_factory=list, compare=False)

    def __str__(self) -> str:
        if not self.text:
            out, stack = [], [self]
            while stack:
                node = stack.pop()
                if isinstance(node, str):
                    out.append(node)
                elif node.text:
                    out.append(node.text[0])
                else:
                    stack += [node.right, node.left]
            whole = "".join(out)
            if len(whole) > _REMEMBERED:
                return whole
            self.text.append(whole)
        return self.text[0]


Entry = tuple[int, "Rope | str"]
Matrix = dict[tuple[int, int], Entry]


def _better(one: Entry | None, other: Entry) -> Entry:
    if one is None or other[0] < one[0]:
        return other
    if one[0] == other[0] and str(other[1]) < str(one[1]):
        return other
    return one


def product(a: Matrix, b: Matrix) -> Matrix:
    """Min-plus product, audits joined."""
    out: Matrix = {}
    for (i, k), (cost, audit) in a.items():
        for (k2, j), (more, rest) in b.items():
            if k == k2:
                out[i, j] = _better(out.get((i, j)), (cost + more, Rope(audit, rest)))
    return out


def _insertions() -> Matrix:
    """Any number of inserted turns; more than two come back to a state at a cost."""
    one: Matrix = {(i, j): (INSERT, "I") for (i, letter), j in NEXT.items() if letter != "s"}
    none: Matrix = {(i, i): (0, "") for i in range(4)}
    out = dict(none)
    for _ in range(3):
        for key, entry in product(out, one).items():
            out[key] = _better(out.get(key), entry)
    return out


def _edits(symbol: str) -> Matrix:
    out: Matrix = {(i, i): (DELETE, "D") for i in range(4)}
    if symbol == GOES:
        return out
    role, cut = _MEANING[symbol]
    for (i, letter), j in NEXT.items():
        if letter == role:
            out[i, j] = _better(out.get((i, j)), (TRUNCATED * cut, "K"))
        elif letter != "s":
            out[i, j] = _better(out.get((i, j)), (RETOUCH + TRUNCATED * cut, "R"))
    return out


INSERTIONS = _insertions()


def symbol_matrices() -> dict[str, Matrix]:
    """Of each symbol: insertions, then what is done to the turn."""
    return {symbol: product(INSERTIONS, _edits(symbol)) for symbol in (*_MEANING, GOES)}


def _factor(symbols: Sequence[str], known: dict[str, Matrix]) -> Matrix:
    out = known[symbols[0]]
    for symbol in symbols[1:]:
        out = product(out, known[symbol])
    return out


# ---- the grammar -------------------------------------------------------------------------

#: Rules are written as private-use characters, so a word stays a string.
_FIRST_RULE = 0xE000


def replaced(word: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """``word`` with each pair replaced by its rule, from left to right, in the order given."""
    for pair, symbol in rules:
        word = F.replace(word, F.lit(pair), F.lit(symbol))
    return word


def re_pair(words: DataFrame, word: str = "word") -> tuple[list[tuple[str, str]], DataFrame]:
    """``(pair, symbol)`` rules, in order, and ``words`` with ``short``, the compressed word.

    Each round counts the pairs of all words at once and takes the commonest that share no
    symbol with each other, so that the order among them does not matter. A round brings
    the counts of at most ``(9 + MOST_RULES) ** 2`` pairs together, and none of the words.
    """
    short, rules = words.withColumn("short", F.col(word)), []
    for _ in range(ROUNDS):
        places = F.sequence(F.lit(1), F.length("short") - 1)
        pairs = F.transform(places, lambda at: F.substring("short", at, F.lit(2)))
        counted = short.where(F.length("short") > 1).select(F.explode(pairs).alias("pair")).groupBy("pair").count().where(F.col("count") >= LEAST_PAIRS)
        taken: set[str] = set()
        new: list[tuple[str, str]] = []
        for row in counted.orderBy(F.desc("count"), "pair").limit(MOST_RULES).collect():
            if not taken.intersection(row.pair) and len(rules) + len(new) < MOST_RULES:
                taken.update(row.pair)
                new.append((row.pair, chr(_FIRST_RULE + len(rules) + len(new))))
        if not new:
            break
        rules += new
        short = written(short.withColumn("short", replaced(F.col("short"), new)), "short-words")
    return rules, short


def grammar_matrices(rules: Sequence[tuple[str, str]]) -> dict[str, Matrix]:
    """One matrix per symbol and rule, bottom-up: a rule only names earlier ones."""
    known = symbol_matrices()
    for pair, symbol in rules:
        known[symbol] = product(known[pair[0]], known[pair[1]])
    return known


def segment_matrices(words: DataFrame) -> DataFrame:
    """``word, costs, audits`` of each distinct ``word``: both 16 long, by row and column of
    the matrix; -1 where there is no way."""
    rules, short = re_pair(words.select("word").distinct())

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = grammar_matrices(rules)
        for batch in batches:
            costs, audits = [], []
            for word in batch.column(1).to_pylist():
                found = _factor(word, known)
                entries = [found.get((i, j), (-1, "")) for i in range(4) for j in range(4)]
                costs.append([cost for cost, _ in entries])
                audits.append([str(audit) for _, audit in entries])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(costs, pa.list_(pa.int64())), pa.array(audits, pa.list_(pa.string()))],
                names=["word", "costs", "audits"],
            )

    return short.select("word", "short").mapInArrow(evaluate, "word string, costs array<long>, audits array<string>")


# ---- turns -------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after the contract's damage: nulls are one space, and
    ``crc32("conv_id:turn") % 20`` says what happens to the row."""
    told = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    chance = F.crc32(F.concat_ws(":", *told)) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"), chance.alias("chance"))
    rows = rows.where("chance <> 0").withColumn("times", F.when(F.col("chance") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    text = F.when(F.col("chance") == 1, "").when(F.col("chance") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("chance") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", "role", "text", text.alias("t"), role.alias("r"), F.explode("times").alias("copy"))
    return rows


_SOLID = r"[^\x20\x09-\x0D]"


def _faults(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, at, initial, blank, duplicate, truncated, symbol`` of each row."""
    # the first row of equal ones is found by grouping, so that a text repeated a million
    # times is summed up on the way; its number then leads back to one row
    first = rows.groupBy("conv_id", "code").agg(F.min(ROW).alias(ROW)).select(ROW, F.lit(True).alias("first"))
    marked = rows.join(first, ROW, "left")
    duplicate = ~F.col("blank") & F.col("first").isNull()
    truncated = ~F.col("blank") & ~duplicate & ~F.col("ended")
    role = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("-")
    cases = F.when(F.col("blank") | duplicate, GOES)
    for (letter, cut), symbol in SYMBOLS.items():
        cases = cases.when((role == letter) & (truncated == F.lit(cut)), symbol)
    return marked.select("conv_id", "turn", "at", ROW, "initial", "blank", duplicate.alias("duplicate"), truncated.alias("truncated"), cases.alias("symbol"))


class _Walk:
    """A conversation, segment by segment: the cheapest way to each state so far."""

    def __init__(self, conv: int | None):
        self.conv = conv
        self.best: dict[int, Entry] = {START: (0, "")}

    def step(self, costs: list[int], audits: list[str]) -> None:
        after: dict[int, Entry] = {}
        for i, (cost, audit) in self.best.items():
            for j in range(4):
                if costs[4 * i + j] >= 0:
                    after[j] = _better(after.get(j), (cost + costs[4 * i + j], Rope(audit, audits[4 * i + j])))
        self.best = after

    def finish(self) -> tuple[int | None, int, str]:
        end: Entry | None = None
        for (i, j), (cost, audit) in INSERTIONS.items():
            if i in self.best and j in FINAL:
                end = _better(end, (self.best[i][0] + cost, Rope(self.best[i][1], audit)))
        return self.conv, end[0], str(end[1])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments, sorted by conversation and place, to cost and audit of each conversation.
    What is held of one is four ways, as long as its audit."""
    now: _Walk | None = None
    for batch in batches:
        done = []
        for conv, _, costs, audits in zip(*[c.to_pylist() for c in batch.columns]):
            if now is None or now.conv != conv:
                if now is not None:
                    done.append(now.finish())
                now = _Walk(conv)
            now.step(costs, audits)
        yield _repairs(done)
    if now is not None:
        yield _repairs([now.finish()])


def _repairs(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in enumerate(types)], names=["conv_id", "cost", "audit"])


_ROLES = {"u": "user", "a": "assistant"}


class _Repaired:
    """A conversation as it is repaired, hashed as it goes."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START
        self.digest, self.turns = hashlib.sha256(), 0

    def _write(self, role: str, text: str) -> None:
        self.digest.update((("\n" if self.turns else "") + f"{role}:{text}").encode("utf-8", "replace"))
        self.turns += 1

    def _expected(self) -> str:
        return "a" if self.state == USER else "u"

    def insertions(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            letter = self._expected()
            self._write(_ROLES[letter], "")
            self.state = NEXT[self.state, letter]
            self.at += 1

    def turn(self, role: str, text: str) -> None:
        self.insertions()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "D":
            return
        letter = role[:1] if edit == "K" else self._expected()
        self.state = NEXT[self.state, letter]
        self._write(role if edit == "K" else _ROLES[letter], text)

    def finish(self) -> str:
        self.insertions()
        return self.digest.hexdigest()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows, the audit of a conversation before its turns: the hash of each."""
    now, number = None, None
    for batch in batches:
        out = []
        for conv, role, text, audit in zip(*[c.to_pylist() for c in batch.columns]):
            if audit is not None:
                if now is not None:
                    out.append((number, now.finish()))
                now, number = _Repaired(audit), conv
            else:
                now.turn(role, text)
        yield _hashes(out)
    if now is not None:
        yield _hashes([(number, now.finish())])


def _hashes(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["conv_id", "repaired_sha256"]
    )


def repaired_conversations(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row per conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256`` (counts as long).

    Rows with a null ``conv_id`` are one conversation of their own. Rows of one turn are in
    the order of role and text as given; repeated rows stay, as duplicates of the first. A
    role or text of null is one space, so such a turn is blank or has no legal role. Other
    columns are ignored. An empty table has no rows.
    """
    every = conversations.select(F.col("conv_id").cast("long")).distinct()
    rows = sliced(damaged(conversations), ["conv_id"], ["turn", "role", "text", "copy"])
    last = F.regexp_extract("t", rf"(?s)({_SOLID})[\x20\x09-\x0D]*+\z", 1)
    keys = rows.select(
        "conv_id", "turn", ROW, "_part", "_slice", F.left("r", F.lit(1)).alias("initial"), (last == "").alias("blank"),
        last.isin(".", "!", "?").alias("ended"), F.sha2(F.concat(F.length("r").cast("string"), F.lit(":"), "r", "t"), 256).alias("code"),
    )
    numbered = running(keys, {"at": ("sum", F.lit(1).cast("long"))})
    turns = written(_faults(numbered), "turns").withColumn("segment", F.floor((F.col("at") - 1) / segment))

    # initials beside each other: within a segment, and over its edges
    symbols = F.array_sort(F.collect_list(F.struct("at", "symbol", "initial")))
    segments = turns.groupBy("conv_id", "segment").agg(
        symbols.alias("s"), F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(c) for c in ("blank", "duplicate", "truncated")],
        F.min("turn").alias("low"), F.max("turn").alias("high"),
    )
    initials = F.transform("s", lambda s: s["initial"])
    segments = written(
        segments.select(
            "conv_id", "segment", "blank", "duplicate", "truncated", "low", "high", initials.alias("initials"),
            F.array_join(F.transform("s", lambda s: s["symbol"]), "").alias("word"),
        ),
        "segments",
    )
    beside = F.zip_with(F.slice("initials", 1, F.greatest(F.size("initials") - 1, F.lit(0))), F.slice("initials", 2, F.size("initials")), lambda a, b: F.concat(a, b))
    illegal = F.size(F.filter(beside, lambda p: ~p.isin("su", "ua", "au")))
    counts = segments.groupBy("conv_id").agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")], F.sum(illegal).alias("within"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    edges = segments.select(F.col("conv_id").alias("conv"), (F.col("segment") + 1).alias("next"), F.element_at("initials", -1).alias("before"))
    starts = segments.where("segment > 0").select("conv_id", "segment", F.element_at("initials", 1).alias("behind"))
    crossing = (
        starts.join(edges, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("segment") == F.col("next")))
        .groupBy("conv_id")
        .agg(F.count_if(~F.concat("before", "behind").isin("su", "ua", "au")).alias("across"))
    )
    distinct = turns.where("turn is not null").select("conv_id", "turn").distinct().groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))

    matrices = written(segment_matrices(segments), "matrices")
    placed = segments.select("conv_id", "segment", "word").join(matrices, "word").select("conv_id", "segment", "costs", "audits")
    audits = written(
        placed.repartition("conv_id").sortWithinPartitions("conv_id", "segment").mapInArrow(_walk, "conv_id long, cost long, audit string"), "audits"
    )
    pieces = rows.select("conv_id", F.col(ROW).alias("place"), F.col("r").alias("role"), F.col("t").alias("text"), F.lit(None).cast("string").alias("audit"))
    heads = audits.select("conv_id", F.lit(-1).cast("long").alias("place"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "audit")
    hashes = (
        pieces.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "place")
        .select("conv_id", "role", "text", "audit").mapInArrow(_hashed, "conv_id long, repaired_sha256 string")
    )

    found = every.withColumnRenamed("conv_id", "id")
    for one in (counts, crossing, distinct, audits, hashes):
        found = found.join(one.withColumnRenamed("conv_id", "other"), F.col("id").eqNullSafe(F.col("other")), "left").drop("other")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return found.select(
        F.col("id").alias("conv_id"),
        zero(F.col("high") - F.col("low") + 1 - F.col("turns")).alias("gaps"),
        *[zero(F.col(c)).alias(c) for c in ("blank", "duplicate", "truncated")],
        (zero(F.col("within")) + zero(F.col("across"))).alias("illegal"),
        zero(F.col("cost")).alias("cost"),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
