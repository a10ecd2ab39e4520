"""Links between classes: large classes in slices, repeated rows, and no table left behind."""

import os
import random
from collections import Counter

import pytest

from shiori.llm import ngram_join
from shiori.sources.workspace import shared_folder


def shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def classes(sets):
    label = {i: i for i in sets}
    for i, a in sets.items():
        for j, b in sets.items():
            if j < i and label[i] != label[j] and 100 * len(a & b) >= 80 * len(a | b):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = {k: new if v == old else v for k, v in label.items()}
    return label


def texts():
    """One large group of near copies by chance edits, several small ones, and unlike texts that share a passage."""
    chance = random.Random(7)
    base = [[f"b{g}w{i}" for i in range(80)] for g in range(4)]
    out = []
    for n in range(150):
        words = list(base[0] if n < 100 else base[1 + n % 3])
        for _ in range(chance.randrange(3)):
            words[chance.randrange(80)] = f"x{n}"
        out.append(" ".join(words))
    passage = " ".join(f"p{i}" for i in range(30))
    return out + [f"{passage} " + " ".join(f"o{n}v{i}" for i in range(25)) for n in range(30)]


@pytest.mark.parametrize(("search_keys", "group_nodes", "share"), [(1, 2048, 0.5), (1, 4, 0.5), (0, 4, 0.5), (0, 8, 8.0)])
def test_sliced_classes_equal_brute_force(spark, monkeypatch, search_keys, group_nodes, share):
    monkeypatch.setattr(ngram_join, "PASS_SHARE", share)
    monkeypatch.setattr(ngram_join, "SEARCH_KEYS", search_keys)
    monkeypatch.setattr(ngram_join, "GROUP_NODES", group_nodes)
    rows = dict(enumerate(texts()))
    want = classes({i: shingles(t) for i, t in rows.items()})
    assert len(Counter(want.values())) > 10
    got = ngram_join.ngram_components(spark.createDataFrame(list(rows.items()), "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == want


def test_repeated_rows_are_one_set(spark):
    a = texts()[0]
    b = f"{a} more"
    rows = [(1, a)] * 40 + [(2, b)] * 40 + [(1, "something else of more than five words")]
    got = Counter((r.doc_id, r.component_id) for r in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {(1, 1): 41, (2, 1): 40}


def test_intermediate_tables_are_removed(spark):
    base = os.path.join(shared_folder(spark).removeprefix("file:"), "shiori")
    before = set(os.listdir(base)) if os.path.isdir(base) else set()
    rows = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    result = ngram_join.ngram_components(rows)
    left = Counter(n.rsplit("-", 1)[0] for n in set(os.listdir(base)) - before)
    assert set(left) <= {"shingle-sets", "labels"} and left["labels"] == 1
    assert result.count() == 180
