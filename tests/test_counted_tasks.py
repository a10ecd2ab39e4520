"""Counting of many texts at once, pairs counted by numbers in the tasks, and buckets of bounded size."""

import random
from collections import Counter
from itertools import pairwise

import pytest
import regex
from test_counted import TEXTS

from shiori.functions import text as tx
from shiori.functions.runs import point_table, runs_of, spaces
from shiori.operators import counted
from shiori.plans.index_build import CHARACTERS_PER_BUCKET, _layout

CHARACTERS = [" ", "\n", "\x1c", "　", "\x85", "a", "B", "_", "é", "İ", "Σ", "σ", "人", "𝒜", "😀", "9", "٣", "-", "\x00", "ß", "ͅ"]


def made_texts(n: int) -> list[str]:
    rng = random.Random(n)
    return ["", " ", *("".join(rng.choices(CHARACTERS, k=rng.randrange(40))) for _ in range(n))]


def test_runs_equal_plain_python():
    texts, word = made_texts(500), point_table(tx.WORD.removesuffix("{2,}+"))
    for inside, least, plain in ((~spaces(), 1, str.split), (word, 2, regex.compile(tx.WORD).findall)):
        number, tokens = runs_of(texts, inside, least)
        assert list(zip(number.tolist(), tokens.to_pylist(), strict=True)) == [(k, t) for k, x in enumerate(texts) for t in plain(x)]
        assert len(runs_of(["", ""], inside, least)[1]) == 0


def test_small_groups_count_the_same(spark, monkeypatch):
    """Groups of a few characters hold one document or several; each is counted alone."""
    texts = {k: t for k, t in enumerate(made_texts(60))}
    monkeypatch.setattr(counted, "CHARACTERS", 50)
    df = spark.createDataFrame(list(texts.items()), "doc_id int, search_text string").coalesce(1)
    rows = counted.counted_tokens(df).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for row in rows:
        text = texts[row["doc_id"]]
        assert row["dl"] == len(text.split()) and dict(zip(row["terms"], row["tfs"], strict=True)) == Counter(text.split())
        words = regex.findall(tx.WORD, text.lower())
        assert dict(zip(row["words"], row["counts"], strict=True)) == Counter(words)
        pairs = zip(row["firsts"], row["seconds"], row["pair_counts"], strict=True)
        assert {(row["words"][a], row["words"][b]): n for a, b, n in pairs} == Counter(pairwise(words))


@pytest.mark.parametrize("held", [1, 1_000_000])
def test_pairs_are_counted_in_the_tasks(spark, monkeypatch, held):
    monkeypatch.setattr(counted, "HELD_PAIRS", held)
    texts = [t for t in TEXTS.values() if t] * 3 + ["bb cc_1 の人口 bb bb", "the cat 人口 人口"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, search_text string").repartition(3)
    tokens = counted.counted_tokens(df)
    words = {"the", "cat", "bb", "cc_1", "人口"}
    chosen = spark.createDataFrame([(w,) for w in words], "term string")
    found = [pairwise(regex.findall(tx.WORD, t.lower())) for t in texts]
    found = [Counter(p for p in pairs if set(p) <= words) for pairs in found]
    cf, df_ = sum(found, Counter()), Counter(p for pairs in found for p in pairs)
    for least in (1, 4):
        want = sorted((" ".join(p), df_[p], n) for p, n in cf.items() if n >= least)
        by_number = counted.pair_counts(tokens, least, chosen)
        assert sorted(map(tuple, by_number.collect())) == want
        assert "Join" not in by_number._jdf.queryExecution().executedPlan().toString()
        with monkeypatch.context() as few:
            few.setattr(counted, "NUMBERED_WORDS", 2)
            assert sorted(map(tuple, counted.pair_counts(tokens, least, chosen).collect())) == want


def test_buckets_are_bounded_by_their_characters():
    assert _layout(20_000, 4, 50 * CHARACTERS_PER_BUCKET)[0] == 50
    assert _layout(20_000, 4, 1_000)[0] == 4
    assert _layout(1_000_000, 4, 1_000)[0] == 10
