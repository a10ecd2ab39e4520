"""Nodes meet their neighbours before all others, so a group of near copies has no pairs left by then; words are hashed by bytes."""

import random

import pyarrow as pa

from shiori.llm import line_dedup, ngram_join


def test_near_copies_have_no_pairs_left(spark, monkeypatch):
    chance = random.Random(3)
    texts = []
    for n in range(60):
        words = [f"w{i}" for i in range(150)]
        words[chance.randrange(150)] = f"x{n}"
        texts.append(" ".join(words))
    pairs, every = [], ngram_join.all_pairs

    def counted(mixed):
        pairs.append(every(mixed).count())
        return every(mixed)

    # Nothing is linked by groups, so that all links come from the later steps.
    monkeypatch.setattr(ngram_join, "searched", lambda shared, sets: spark.createDataFrame([], "u long, v long"))
    monkeypatch.setattr(ngram_join, "all_pairs", counted)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.component_id for r in ngram_join.ngram_components(rows).collect()} == {0}
    assert pairs == [0]


def test_sets_of_many_texts_at_once(monkeypatch):
    texts = ["A b C d e f", "a B c D e F", "a b", None, "", " \n", "a b c d e\x0bf", "a b c d e f", "a b c d e a b c d e a b c d e", "é É"]
    sets = [s.tolist() for s in ngram_join.Shingler().of(pa.array(texts))]
    assert [len(s) for s in sets] == [2, 2, 1, 0, 0, 0, 2, 1, 5, 1]
    assert sets[0] == sets[1] == sets[6]
    monkeypatch.setattr(ngram_join, "CHUNK_BYTES", 7)
    assert [s.tolist() for s in ngram_join.Shingler().of(pa.array([*texts, "more"]).slice(1))][: len(texts) - 1] == sets[1:]


def test_segments_of_plain_lines_are_cut_by_bytes(spark):
    """The same keys by bytes and by characters: a plain line and one with a letter beyond ASCII share what they have in common."""
    rows = spark.createDataFrame([("x" * 10 + "y" * 10 + "zz plain end",), ("x" * 10 + "y" * 10 + "zz pläin end",)], "line string").selectExpr("line", "bigint(length(line)) n")
    keyed = rows.select("line", line_dedup.line_keys(rows.line, rows.n).alias("keys"))
    plain, other = (r["keys"] for r in keyed.collect())
    assert len({k.key for k in plain} & {k.key for k in other} - {None}) >= 2
    assert "octet_length" in str(line_dedup._key(rows.line, rows.n, rows.n, 0, rows.n))
