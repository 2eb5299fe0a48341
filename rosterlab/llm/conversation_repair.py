"""Repair of conversation structure by Knuth's lightest-derivation agenda.

A conversation's roles should read ``(s?(ua)+)?``, by the roles' first letters. Rows are kept (free),
given the role user or assistant (3), deleted (4; blank rows and repeats must be) and rows with empty
text inserted (3); a truncated row that is not deleted costs 3 more. Wanted is the cheapest
repair, and of equally cheap ones that whose edit letters (K, R, D, I) come first in ASCII order.

Repair is a weighted deduction: the items are "row k reads as x" and "the rows before k read as a
beginning that ends in state q", the rules join a beginning with a row's reading or with an insertion,
and a derivation weighs (cost, letters), added and appended. These functions are superior (the result
is never lighter than a premise) and, as equal costs at one item never belong to letters of
which one begins the other, monotone. So the agenda pops items in the order of their final weight and
stops at the goal.

Rows are numbered over all conversations by a range sort (by turn, nulls first; equal turns by role, then
by a hash of the text) and solved in blocks of ``block`` consecutive rows, of which only number, role
letter and fault are read. A conversation inside a block is solved there. The one at each end of a
block gives a piece: the lightest derivation from every state to every state. Pieces of a conversation are
joined by the same agenda, ``fan`` at a time, in as many rounds as it has levels; the way back
down tells each piece its states. So one conversation may hold most of all rows: no task solves more
than a block, and only its letters, one string in the result, meet in one task.

Null roles and texts read as one space (such a row is blank). A null ``conv_id`` is a conversation of
its own, and null turns come first and count in no gap. Repeated rows are repeats. Empty texts are
blank. A conversation without rows has zeros, no letters and the hash of nothing. An empty table gives
no rows; other columns are left out. A hash of a whole conversation has to read it in order: that one
step streams each conversation through one task, which holds a batch of rows at a time.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlab.llm.common import BEFORE_ALL, lean, order_key, stored
from rosterlab.plans.numbering import number_rows

BLANKS = " \t\n\x0b\x0c\r"
CONV = "_conv"
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
# States of a beginning: nothing yet, after s, after u, after a.
STATES, ACCEPTED = range(4), (0, 3)
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
LEGAL = ("su", "ua", "au")
ROLES = {"u": "user", "a": "assistant"}
GOAL = ("goal",)

Weight = tuple[int, str]


@dataclass(frozen=True)
class Repair:
    rerole: int = 3
    delete: int = 4
    insert: int = 3
    truncated: int = 3
    block: int = 1024
    fan: int = 16


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` with faults put in by a hash of conversation and turn; nulls become a space."""
    text_or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(text_or_space("conv_id"), F.lit(":"), text_or_space("turn")).cast("binary")) % 20
    rows = conversations.select(
        "conv_id", "turn", text_or_space("role").alias("role"), text_or_space("text").alias("text"),
        fault.alias("_fault"),
    ).where("_fault <> 0")
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.translate("text", ".!?", ""))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("_fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("_fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))),
    ).drop("col")


def lightest(
    axioms: Iterable[tuple[tuple, Weight]],
    rules: Callable[[tuple, dict], Iterable[tuple[tuple, Weight]]],
    done: Callable[[tuple], bool],
) -> dict[tuple, Weight]:
    """Final weights of items, settled from the lightest on until ``done``.

    ``rules(item, settled)`` gives the consequents of all rules whose last settled premise is ``item``.
    """
    agenda = [(weight, item) for item, weight in axioms]
    heapq.heapify(agenda)
    settled: dict[tuple, Weight] = {}
    offered: dict[tuple, Weight] = {}
    while agenda:
        weight, item = heapq.heappop(agenda)
        if item in settled:
            continue
        settled[item] = weight
        if done(item):
            break
        for found, offer in rules(item, settled):
            if found not in settled and (found not in offered or offer < offered[found]):
                offered[found] = offer
                heapq.heappush(agenda, (offer, found))
    return settled


def both(a: Weight, b: Weight) -> Weight:
    return a[0] + b[0], a[1] + b[1]


def readings(letters: list[str], faults: list[int], how: Repair) -> Iterator[tuple[tuple, Weight]]:
    """Axioms: what each row can read as ("" if deleted), and what can be inserted."""
    for k, (letter, fault) in enumerate(zip(letters, faults, strict=True)):
        yield ("row", k, ""), (how.delete, "D")
        if fault in (BLANK, DUPLICATE):
            continue
        more = how.truncated if fault == TRUNCATED else 0
        for symbol in "sua":
            if symbol == letter:
                yield ("row", k, symbol), (more, "K")
            elif symbol != "s":
                yield ("row", k, symbol), (how.rerole + more, "R")


def derive(letters: list[str], faults: list[int], begin: int, how: Repair, whole: bool) -> dict[tuple, Weight]:
    """Weights of ("before", n, q) from state ``begin``, or of the goal for a whole conversation."""
    n = len(letters)
    steps = {q: [(x, to) for (of, x), to in NEXT.items() if of == q] for q in STATES}
    arrive = {x: [(q, to) for (q, y), to in NEXT.items() if y == x] for x in "sua"}
    arrive[""] = [(q, q) for q in STATES]

    def rules(item: tuple, settled: dict) -> Iterator[tuple[tuple, Weight]]:
        own = settled[item]
        if item[0] == "row":
            _, k, x = item
            for q, to in arrive[x]:
                if (before := settled.get(("before", k, q))) is not None:
                    yield ("before", k + 1, to), both(before, own)
            return
        _, k, q = item
        if k == n and whole and q in ACCEPTED:
            yield GOAL, own
        for x, to in steps[q]:
            if x != "s":
                yield ("before", k, to), (own[0] + how.insert, own[1] + "I")
            if (row := settled.get(("row", k, x))) is not None:
                yield ("before", k + 1, to), both(own, row)
        if (row := settled.get(("row", k, ""))) is not None:
            yield ("before", k + 1, q), both(own, row)

    open_ends = set(STATES)

    def done(item: tuple) -> bool:
        if item[0] == "before" and item[1] == n:
            open_ends.discard(item[2])
        # Nothing leads back to the state before all rows, or after s, once it is left.
        return item == GOAL if whole else not open_ends

    axioms = [*readings(letters, faults, how), (("before", 0, begin), (0, ""))]
    return lightest(axioms, rules, done)


def symbols(audit: str, letters: list[str], state: int) -> str:
    """The symbol that each edit gives: s, u, a, or - for a deletion."""
    out, k = [], 0
    for edit in audit:
        if edit == "D":
            out.append("-")
        else:
            symbol = letters[k] if edit == "K" else "a" if state == 2 else "u"
            out.append(symbol)
            state = NEXT[state, symbol]
        k += edit != "I"
    return "".join(out)


def illegal_pairs(letters: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(letters, letters[1:], strict=False))


_SOLVED = (
    f"{CONV} bigint, block bigint, first bigint, q_in int, q_out int, cost bigint, audit string, "
    "path string, illegal bigint, head string, tail string"
)
_NAMES = [c.split()[0] for c in _SOLVED.split(", ")]
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _table(rows: list[tuple], ddl: str) -> pa.Table:
    fields = [c.split() for c in ddl.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.table({n: pa.array(list(c), _ARROW[t]) for (n, t), c in zip(fields, columns, strict=True)})


def solved_blocks(facts: DataFrame, how: Repair) -> DataFrame:
    """Per conversation and block: the solution (q_out null), or a piece's solution by states."""

    def solve(group: pa.Table) -> pa.Table:
        rows = sorted(zip(*(group.column(c).to_pylist() for c in ("n", CONV, "letter", "fault")), strict=True))
        cuts = [i for i in range(len(rows)) if i == 0 or rows[i][1] != rows[i - 1][1]] + [len(rows)]
        block = (rows[0][0] - 1) // how.block
        out = []
        for i, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
            first, conv = rows[a][:2]
            letters, faults = [r[2] for r in rows[a:z]], [r[3] for r in rows[a:z]]
            ends = illegal_pairs(letters), letters[0], letters[-1]
            if 0 < i < len(cuts) - 2:
                cost, audit = derive(letters, faults, 0, how, True)[GOAL]
                out.append((conv, block, first, 0, None, cost, audit, symbols(audit, letters, 0), *ends))
                continue
            for q in STATES:
                found = derive(letters, faults, q, how, False)
                for to in STATES:
                    if (weight := found.get(("before", z - a, to))) is not None:
                        path = symbols(weight[1], letters, q)
                        out.append((conv, block, first, q, to, *weight, path, *ends))
        return _table(out, _SOLVED)

    keyed = facts.select("n", CONV, "letter", "fault", F.floor((F.col("n") - 1) / how.block).alias("_block"))
    return keyed.groupBy("_block").applyInArrow(solve, _SOLVED)


_JOINED = (
    f"{CONV} bigint, part bigint, q_in int, q_out int, cost bigint, audit string, via string, "
    "illegal bigint, head string, tail string"
)


def join_pieces(parts: DataFrame, how: Repair) -> DataFrame:
    """Pieces of a conversation (numbered by ``part``) joined ``fan`` at a time; ``via`` has all states."""

    def join(group: pa.Table) -> pa.Table:
        by_part: dict[int, list[dict]] = {}
        for row in group.to_pylist():
            by_part.setdefault(row["part"], []).append(row)
        chain = [by_part[p] for p in sorted(by_part)]
        ends = [c[0] for c in chain]
        illegal = sum(e["illegal"] for e in ends)
        illegal += sum(a["tail"] + b["head"] not in LEGAL for a, b in zip(ends, ends[1:], strict=False))
        head = ends[0][CONV], ends[0]["part"] // how.fan
        weights = [{(r["q_in"], r["q_out"]): (r["cost"], r["audit"]) for r in rows} for rows in chain]
        out = []
        for begin in STATES:

            def rules(item: tuple, settled: dict) -> Iterator[tuple[tuple, Weight]]:
                _, k, q = item
                for (of, to), weight in weights[k].items() if k < len(chain) else ():
                    if of == q:
                        yield ("before", k + 1, to), both(settled[item], weight)

            found = lightest([(("before", 0, begin), (0, ""))], rules, lambda item: False)
            for to in STATES:
                if (weight := found.get(("before", len(chain), to))) is None:
                    continue
                # Backwards, each state is the one from which the settled weight was made.
                via = [to]
                for k in range(len(chain) - 1, -1, -1):
                    via.append(
                        next(
                            q
                            for q in STATES
                            if (before := found.get(("before", k, q))) is not None
                            and (q, via[-1]) in weights[k]
                            and both(before, weights[k][q, via[-1]]) == found["before", k + 1, via[-1]]
                        )
                    )
                states = "".join(map(str, reversed(via)))
                out.append((*head, begin, to, *weight, states, illegal, ends[0]["head"], ends[-1]["tail"]))
        return _table(out, _JOINED)

    grouped = parts.withColumn("_group", F.floor(F.col("part") / how.fan)).groupBy(CONV, "_group")
    return grouped.applyInArrow(join, _JOINED)


def numbered_rows(rows: DataFrame) -> DataFrame:
    """The rows with their conversation's key and ``n``, their number over all conversations."""
    own = rows.select(
        order_key("conv_id").alias(CONV),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    )
    order = [F.col(CONV), F.col("turn").asc_nulls_first(), F.col("role"), F.xxhash64("text")]
    return stored(number_rows(own, order, "n"), "numbered")


def faulty(numbered: DataFrame) -> DataFrame:
    """Number, turn, role letter and first fault of each row."""
    end = F.rtrim("text", F.lit(BLANKS))
    facts = numbered.select(
        CONV,
        "n",
        "turn",
        F.substring("role", 1, 1).alias("letter"),
        (end == "").alias("_blank"),
        (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("_cut"),
        F.xxhash64("role", "text").alias("_a"),
        F.xxhash64(F.lit(1), "role", "text").alias("_b"),
    )
    same = [CONV, "_a", "_b"]
    # Only what occurs twice is joined back.
    twice = facts.groupBy(*same).agg(F.min("n").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    fault = (
        F.when(F.col("_blank"), BLANK)
        .when(F.col("n") > F.col("_first"), DUPLICATE)
        .when(F.col("_cut"), TRUNCATED)
        .otherwise(FINE)
    )
    joined = facts.join(twice.drop("_n"), same, "left")
    return stored(joined.select(CONV, "n", "turn", "letter", fault.alias("fault")), "facts")


def chosen(pieces: DataFrame, how: Repair) -> tuple[DataFrame, DataFrame]:
    """Of conversations in pieces: the solutions, and the states that each piece begins and ends with."""
    spark = pieces.sparkSession
    begin = pieces.groupBy(CONV).agg(F.min("block").alias("_begin"))
    level = pieces.join(begin, CONV).withColumn("part", F.col("block") - F.col("_begin"))
    level = level.select(CONV, "part", "q_in", "q_out", "cost", "audit", "illegal", "head", "tail")
    levels = []
    while True:
        joined = stored(join_pieces(level, how), "joined")
        levels.append(joined)
        if (joined.agg(F.max("part")).first()[0] or 0) == 0:
            break
        level = joined.drop("via")
    ends = joined.where((F.col("q_in") == 0) & F.col("q_out").isin(*ACCEPTED))
    best = ends.groupBy(CONV).agg(
        F.min(F.struct("cost", "audit", "q_out")).alias("_b"), F.first("illegal").alias("illegal")
    )
    best = stored(best.select(CONV, "_b.cost", "_b.audit", "_b.q_out", "illegal"), "best")
    states = best.select(CONV, F.lit(0).cast("bigint").alias("part"), F.lit(0).alias("q_in"), "q_out")
    for joined in reversed(levels):
        found = joined.join(states, [CONV, "part", "q_in", "q_out"])
        each = F.transform(
            F.sequence(F.lit(1), F.length("via") - 1),
            lambda i: F.struct(
                (F.col("part") * how.fan + i - 1).alias("part"),
                F.substring("via", i, F.lit(1)).cast("int").alias("q_in"),
                F.substring("via", i + 1, F.lit(1)).cast("int").alias("q_out"),
            ),
        )
        states = found.select(CONV, F.explode(each).alias("_s")).select(CONV, "_s.*")
    placed = states.join(begin, CONV).withColumn("block", F.col("part") + F.col("_begin"))
    ways = pieces.join(placed.select(CONV, "block", "q_in", "q_out"), [CONV, "block", "q_in", "q_out"])
    return best, ways.select(CONV, "block", "first", "audit", "path")


@dataclass(frozen=True)
class Repaired:
    """``rows``: _conv, block, step, n (null if inserted), edit, role, text; in a conversation's order by
    block and step. ``solutions``: _conv, cost, audit, illegal. ``facts``: a row per row before repair."""

    rows: DataFrame
    solutions: DataFrame
    facts: DataFrame


def repair(rows: DataFrame, how: Repair | None = None) -> Repaired:
    """Cheapest repairs of conversations (conv_id, turn, role, text)."""
    how = how or Repair()
    numbered = numbered_rows(rows)
    facts = faulty(numbered)
    solved = stored(solved_blocks(facts, how), "solved")
    whole = solved.where("q_out IS NULL")
    best, ways = chosen(solved.where("q_out IS NOT NULL"), how)
    all_ways = whole.select(CONV, "block", "first", "audit", "path").union(ways)

    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for way in batch.to_pylist():
                n, out = way["first"], []
                for step, (edit, symbol) in enumerate(zip(way["audit"], way["path"], strict=True)):
                    if edit != "D":
                        out.append((way[CONV], way["block"], step, None if edit == "I" else n, edit, symbol))
                    n += edit != "I"
                if out:
                    yield from _table(out, _EDITS).to_batches()

    made = all_ways.mapInArrow(lean(edits), _EDITS).join(numbered.select("n", "role", "text"), "n", "left")
    given = F.when(F.col("symbol") == "u", ROLES["u"]).otherwise(ROLES["a"])
    repaired = made.select(
        CONV,
        "block",
        "step",
        "n",
        "edit",
        F.when(F.col("edit") == "K", F.col("role")).otherwise(given).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    solutions = whole.select(CONV, "cost", "audit", "illegal").union(best.select(CONV, "cost", "audit", "illegal"))
    return Repaired(repaired, solutions, facts)


_EDITS = f"{CONV} bigint, block bigint, step int, n bigint, edit string, symbol string"


def digests(rows: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's repaired ``role:text``, joined by line ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            found = []
            lines = (batch.column(c).to_pylist() for c in (CONV, "role", "text"))
            for conv, role, text in zip(*lines, strict=True):
                if state is None or conv != now:
                    if state is not None:
                        found.append((now, state.hexdigest()))
                    now, state = conv, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            if found:
                yield from _table(found, f"{CONV} bigint, sha string").to_batches()
        if state is not None:
            yield from _table([(now, state.hexdigest())], f"{CONV} bigint, sha string").to_batches()

    ordered = rows.select(CONV, "block", "step", "role", "text").repartition(CONV)
    ordered = ordered.sortWithinPartitions(CONV, "block", "step")
    return ordered.mapInArrow(lean(run), f"{CONV} bigint, sha string")


def repair_report(conversations: DataFrame, rows: DataFrame, how: Repair | None = None) -> DataFrame:
    """Per conversation of ``conversations``: faults, cost and edits of the repair of its ``rows``, and the
    repaired conversation's digest."""
    found = repair(rows, how)
    every = conversations.select(order_key("conv_id").alias(CONV)).distinct()
    count = lambda kind: F.count(F.when(F.col("fault") == kind, 1))
    faults = found.facts.groupBy(CONV).agg(
        count(BLANK).alias("blank"), count(DUPLICATE).alias("duplicate"), count(TRUNCATED).alias("truncated")
    )
    turns = found.facts.where("turn IS NOT NULL").select(CONV, "turn").distinct()
    gaps = turns.groupBy(CONV).agg(
        (F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps")
    )
    joined = (
        every.join(gaps, CONV, "left")
        .join(faults, CONV, "left")
        .join(found.solutions, CONV, "left")
        .join(digests(found.rows), CONV, "left")
    )
    number: Callable[[str], Column] = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return joined.select(
        F.when(F.col(CONV) != BEFORE_ALL, F.col(CONV)).alias("conv_id"),
        *map(number, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
