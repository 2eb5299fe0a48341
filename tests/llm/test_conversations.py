"""Conversation repair against an exhaustive search over edits."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from rosterlab.llm import conversation_repair
from rosterlab.llm.conversation_repair import Repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, n int, audit string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 3, "clash") for r in rows], SCHEMA).repartition(3)


def damage(conv, turn, role, text):
    spoken = lambda v: " " if v is None else str(v)
    fault = zlib.crc32(f"{spoken(conv)}:{spoken(turn)}".encode()) % 20
    role, text = spoken(role), spoken(text)
    return {
        0: [], 1: [(turn, role, "")], 2: [(turn, role, re.sub("[.!?]", "", text))], 3: [(turn, role, text)] * 2,
        4: [(turn, "user", text)],
    }.get(fault, [(turn, role, text)])


def search(rows, faults):
    """Cheapest (cost, edits) and the rows it leaves, trying whole edit strings in order of weight."""
    open_, tried = [(0, "", 0, "", ())], 0
    while True:
        cost, audit, at, roles, left = heapq.heappop(open_)
        tried += 1
        assert tried < 200_000
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, left
        if not re.fullmatch("s?(ua)*u?", roles):
            continue
        for role in ("user", "assistant"):
            heapq.heappush(open_, (cost + 3, audit + "I", at, roles + role[0], (*left, (role, ""))))
        if at == len(rows):
            continue
        (_, role, text), fault = rows[at], faults[at]
        heapq.heappush(open_, (cost + 4, audit + "D", at + 1, roles, left))
        if fault in ("blank", "duplicate"):
            continue
        more = 3 if fault == "truncated" else 0
        heapq.heappush(open_, (cost + more, audit + "K", at + 1, roles + (role[:1] or "-"), (*left, (role, text))))
        for new in ("user", "assistant"):
            heapq.heappush(open_, (cost + 3 + more, audit + "R", at + 1, roles + new[0], (*left, (new, text))))


def expected(rows):
    by_conv = defaultdict(list)
    for conv, *row in rows:
        by_conv[conv].append(row)
    out = []
    for conv, own in by_conv.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        left = [d for r in own for d in damage(conv, *r)]
        seen, faults = set(), []
        for _, role, text in left:
            bare = re.sub(r"[\x20\x09-\x0D]+$", "", text)
            faults.append(
                "blank" if not re.search(r"[^\x20\x09-\x0D]", text)
                else "duplicate" if (role, text) in seen
                else "truncated" if bare[-1] not in ".!?"
                else ""
            )
            seen.add((role, text))
        cost, audit, kept = search(left, faults)
        turns = {r[0] for r in left} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        letters = [r[1][:1] for r in left]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:]))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *counts, illegal, cost, audit, digest))
    return sorted(out, key=repr)


def report(spark, rows, how):
    table = frame(spark, rows)
    got = conversation_repair.repair_report(table, conversation_repair.damaged(table), how)
    return sorted(map(tuple, got.collect()), key=repr)


def invented(seed, conversations, most):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "unknown", "", None]
    texts = ["Yes.", "No!", "So it is", "Why?  ", " ", "", None, "A b\x0b", "One. Two", "。"]
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randrange(most + 1)):
            spread = turn + rng.choice([0, 0, 0, 40])
            rows.append((conv, spread, rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"T {turn}."))
    # One row a turn: the order of equal turns is not part of the contract.
    return list({(r[0], r[1]): r for r in rows}.values())


@pytest.mark.parametrize(("block", "fan"), [(1024, 16), (3, 2)])
def test_repairs_are_the_cheapest(spark, block, fan):
    rows = invented(1, 120, 7)
    rows += [(None, 0, "user", "Null id."), (None, 1, "assistant", "Yes."), (500, None, "user", "No turn.")]
    rows += [(500, 3, "assistant", "Turn three."), (501, None, None, None)]
    assert report(spark, rows, Repair(block=block, fan=fan)) == expected(rows)


def test_one_conversation_with_most_rows(spark):
    """It is solved in pieces; the rows before and after repair follow the edits."""
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"Line {t % 90}.") for t in range(600)]
    rows += [(2, t, r, f"Turn {t}.") for t, r in enumerate(["system", "user", "assistant"])]
    assert report(spark, rows, Repair(block=16, fan=3)) == report(spark, rows, Repair())
    found = conversation_repair.repair(frame(spark, rows), Repair(block=16, fan=3))
    kept = found.rows.where("_conv = 1").orderBy("block", "step").collect()
    assert "".join(r["role"][0] for r in kept) == "ua" * (len(kept) // 2)
    solution = {r["_conv"]: r for r in found.solutions.collect()}
    assert "".join(r["edit"] for r in kept) == solution[1]["audit"].replace("D", "")
    price = {"K": 0, "R": 3, "D": 4, "I": 3}
    assert solution[1]["cost"] == sum(price[e] for e in solution[1]["audit"])
    assert solution[1]["audit"].count("D") >= 510 - 90  # repeats have to go


def test_no_rows(spark):
    assert report(spark, [], Repair()) == []
    gone = next(t for t in range(999) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    nothing = hashlib.sha256().hexdigest()
    assert report(spark, [(7, gone, "user", "Hi.")], Repair()) == [(7, 0, 0, 0, 0, 0, 0, "", nothing)]


def test_agenda_settles_in_order_of_weight():
    """A rule with two premises: the lightest derivation of c uses the dearer b made of two a."""
    axioms = [(("a",), (1, "x")), (("b",), (5, "y"))]

    def rules(item, settled):
        if item == ("a",):
            yield ("b",), conversation_repair.both(settled["a",], settled["a",])
        if ("a",) in settled and ("b",) in settled:
            yield ("c",), conversation_repair.both(settled["a",], settled["b",])

    found = conversation_repair.lightest(axioms, rules, lambda item: item == ("c",))
    assert found == {("a",): (1, "x"), ("b",): (2, "xx"), ("c",): (3, "xxx")}
