"""Conversation repair against an exhaustive search over edits and plain Python on rows."""

import hashlib
import heapq
import random
import re
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shiori.llm import conversation, registered

TABLES = Path("/root/testdata/sf0.001")
WANTED = re.compile(r"(s?(ua)+)?")
STEPS = {"": "su", "s": "u", "su": "a", "u": "a", "ua": "u"}


def brute_repair(rows):
    """rows: (initial, must go, truncated). Cheapest cost and least audit, by cost and audit over whole paths."""
    # Position in the pattern, spelled out: nothing yet, s, after a user, after an assistant.
    moves = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    heap, done = [(0, "", 0, 0, "")], set()
    while heap:
        cost, audit, i, state, initials = heapq.heappop(heap)
        if i == len(rows) and WANTED.fullmatch(initials[-400:] if len(initials) < 400 else initials):
            return cost, audit
        if (i, state) in done:
            continue
        done.add((i, state))
        for c in "ua":
            if c in moves[state]:
                heapq.heappush(heap, (cost + 3, audit + "I", i, moves[state][c], initials + c))
        if i < len(rows):
            initial, gone, cut = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, initials))
            if not gone:
                more = 3 if cut else 0
                if initial in moves[state]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, moves[state][initial], initials + initial))
                for c in "ua":
                    if c in moves[state]:
                        heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, moves[state][c], initials + c))


def sign(row):
    initial, gone, cut = row
    if gone:
        return "x"
    known = initial if initial in ("s", "u", "a") else "-"
    return (("=" if known == "-" else known.upper()) if cut else known)


def test_edits_equal_exhaustive_search():
    rng = random.Random(2)
    for _ in range(3000):
        rows = [(rng.choice(["s", "u", "a", "u", "a", "t", ""]), rng.random() < 0.2, rng.random() < 0.2) for _ in range(rng.randrange(0, 12))]
        assert conversation.cheapest("".join(map(sign, rows))) == brute_repair(rows)


def test_long_conversation():
    rows = [("u" if k % 3 else "a", k % 17 == 0, k % 5 == 0) for k in range(400)]
    assert conversation.cheapest("".join(map(sign, rows))) == brute_repair(rows)
    cost, audit = conversation.cheapest("ua" * 50_000)
    assert (cost, audit) == (0, "K" * 100_000)


def brute(rows):
    """The whole contract over (conv_id, turn, role, text)."""
    broken = {}
    for conv, turn, role, text in rows:
        out = broken.setdefault(conv, [])
        blank = lambda v: " " if v is None else v
        role, text = blank(role), blank(text)
        fault = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        out += [(turn, role, text)] * (2 if fault == 3 else 1)
    results = []
    for conv, out in broken.items():
        out.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, marked, counts = set(), [], {"b": 0, "d": 0, "t": 0}
        for _, role, text in out:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            marked.append((role[:1], fault in ("b", "d") and bool(fault), fault == "t"))
        turns = [t for t, _, _ in out if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:], strict=False))
        cost, audit = brute_repair(marked)
        lines, state, k = [], "", 0
        for edit in audit:
            wanted = "a" if lines and state == "u" else "u"
            if edit == "D":
                k += 1
                continue
            if edit == "I":
                role, text = {"u": "user", "a": "assistant"}[wanted], ""
            else:
                role, text = out[k][1:]
                k += 1
                if edit == "R":
                    role = {"u": "user", "a": "assistant"}[wanted]
            state = role[:1]
            lines.append(f"{role}:{text}")
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        results.append((conv, gaps, counts["b"], counts["d"], counts["t"], illegal, cost, audit, digest))
    return results


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def compare(spark, rows, schema=SCHEMA):
    got = conversation.damage_and_repair(spark.createDataFrame(rows, schema)).select(COLUMNS).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute([r[:4] for r in rows])))


def test_made_conversations(spark):
    rng = random.Random(7)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", None, "", "usher", "Ärger"]
    texts = ["Fine.", "cut off", "", " \n", None, "What?\r\n", "...", "é!", "x" * 5000 + ".", "a\x00b.", "nb\xa0"]
    rows = [
        (rng.choice([*range(60), None]), rng.choice([None, *range(-2, 9)]), rng.choice(roles), rng.choice(texts))
        for _ in range(900)
    ]
    compare(spark, rows)


def test_only_dropped_rows(spark):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    compare(spark, [(gone, 0, "user", "Hi.")])


def test_empty_table_and_other_columns(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert conversation.damage_and_repair(df).count() == 0
    df = spark.createDataFrame([(5, 1, "user", "Hi."), (5, 2, "assistant", "Yes.")], SCHEMA)
    extra = df.withColumn("audit", F.lit("x")).withColumn("place", F.lit(9)).withColumn("fault", F.lit(0)).withColumn("_id", F.lit(1))
    assert conversation.damage_and_repair(extra).select(COLUMNS).collect() == conversation.damage_and_repair(df).select(COLUMNS).collect()


def test_repaired_rows(spark):
    df = spark.createDataFrame([(1, 1, "assistant", "A."), (1, 2, "assistant", "B."), (1, 3, "user", "A."), (1, 3, "user", " ")], SCHEMA)
    found = conversation.findings(df)
    rows = [tuple(r) for r in conversation.repaired(df, found).collect()]
    roles = "".join(r[3][0] for r in sorted(rows, key=lambda r: r[1]))
    assert WANTED.fullmatch(roles) and [r[1] for r in rows] == list(range(len(rows)))
    assert "".join(r[2] for r in rows) == found.first()["audit"].replace("D", "")


@pytest.mark.skipif(not TABLES.exists(), reason="no test data")
def test_registered_query(spark):
    rows = [tuple(r) for r in registered.table(spark, str(TABLES), "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = registered.op11_conversation_repair(spark, str(TABLES)).select(COLUMNS).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))
