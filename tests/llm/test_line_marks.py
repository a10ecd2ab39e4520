"""Lines of a large group are held against each other only where their bits allow it, and none is lost by that."""

import random

from pyspark.sql import functions as F

from shiori.llm import line_dedup


def edited(rng: random.Random, line: str, edits: int) -> str:
    for _ in range(edits):
        at = rng.randrange(len(line))
        line = line[:at] + rng.choice(["", "x", " ", ",", "の", "人", "😀", "𝒜", line[at] + "q"]) + line[at + 1 :]
    return line


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def family(n: int, edits: int) -> list[str]:
    rng = random.Random(n + edits)
    base = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(20))
    return sorted({edited(rng, base, edits) for _ in range(n)}, key=lambda x: rng.random())


def test_near_lines_differ_in_few_bits(spark):
    rng = random.Random(5)
    pairs = [(x, edited(rng, x, 2)) for x in family(150, 4)]
    lines = sorted({x for pair in pairs for x in pair})
    texts = spark.createDataFrame([(k, k, x) for k, x in enumerate(lines)], "a bigint, b bigint, line string")
    marks = {r["a"]: r["marks"] for r in line_dedup.marks_of(texts).collect()}
    number = {x: k for k, x in enumerate(lines)}
    differ = lambda x, y: sum(((p ^ q) & (2**64 - 1)).bit_count() for p, q in zip(marks[number[x]], marks[number[y]], strict=True))
    assert all(differ(x, y) <= 4 for x, y in pairs)
    shared = spark.createDataFrame([(1, 1, "a b"), (1, 2, "c d")], "a bigint, b bigint, line string")
    rows = line_dedup.marks_of(shared).collect()
    assert [r["a"] for r in rows] == [1, 1] and rows[0]["marks"] != rows[1]["marks"]
    plan = line_dedup.marks_of(shared)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_a_family_is_not_held_against_itself(spark, monkeypatch):
    """Copies with six edits each share segments with nearly all of their family, but few pairs are verified."""
    lines = family(120, 6)
    documents = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    seen, whole = [], line_dedup._verified
    monkeypatch.setattr(line_dedup, "_verified", lambda pairs, *a: seen.append(pairs.count()) or whole(pairs, *a))
    out = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(documents).collect()}
    want = {k: int(any(distance(lines[j], x) <= 2 for j in range(k))) for k, x in enumerate(lines)}
    assert out == want
    assert seen[1] < len(lines)


def test_texts_are_picked_out_either_way(spark, monkeypatch):
    lines = family(40, 1) + family(30, 3)
    documents = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    sent = line_dedup.dedup_lines(documents).orderBy("doc_id").collect()
    monkeypatch.setattr(line_dedup, "BROADCAST_HASHES", 0)
    assert line_dedup.dedup_lines(documents).orderBy("doc_id").collect() == sent
    assert sum(r["n_removed"] for r in sent) > 0
    assert documents.select(F.count("*")).first()[0] == len(sent)
