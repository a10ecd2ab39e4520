"""The counted-token table, the exact top counts, and versions of an index."""

import random
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F
from test_search import corpus_of, made_rows

from shiori.operators import counted
from shiori.operators.bm25 import bm25_topk
from shiori.operators.top_counts import count_floor, top_by_count
from shiori.plans import index_build
from shiori.plans.index_build import build_index
from shiori.sources import index_store
from shiori.sources.workspace import fresh_path, materialise

TEXTS = {1: "The cat, the CAT and the hat", 2: "", 3: None, 4: "a　bb cc_1 bb\ncc_1 bb", 5: "ÉTÉ été İx 人口 人口 の人口", 6: " x "}


def test_counts_of_each_text(spark):
    df = spark.createDataFrame(list(TEXTS.items()), "doc_id int, search_text string")
    for row in counted.counted_tokens(df, ["and"]).collect():
        text = TEXTS[row["doc_id"]] or ""
        assert row["dl"] == len(text.split())
        assert dict(zip(row["terms"], row["tfs"], strict=True)) == Counter(text.split())
        words = [w for w in brute.re.findall(r"\w\w+", text.lower()) if w != "and"]
        assert dict(zip(row["words"], row["counts"], strict=True)) == Counter(words)
        pairs = zip(row["firsts"], row["seconds"], row["pair_counts"], strict=True)
        assert {(row["words"][a], row["words"][b]): n for a, b, n in pairs} == Counter(zip(words, words[1:], strict=False))


@pytest.mark.parametrize("size", [1, 2, 7, 60, 500, 100_000])
def test_top_counts_equal_a_sort(spark, size):
    rng = random.Random(size)
    for spread in (1, 5, 10**12):
        rows = [(f"t{k:05d}", min(rng.randrange(1, spread + 1), rng.randrange(1, spread + 1))) for k in range(700)]
        rng.shuffle(rows)
        table = materialise(spark.createDataFrame(rows, "term string, cf bigint").repartition(5), "top")
        want = sorted(rows, key=lambda r: (-r[1], r[0]))[:size]
        assert sorted(map(tuple, top_by_count(table, "cf", "term", size).collect())) == sorted(want)
        floor, more = count_floor(table, "cf", size)
        if size < 700:
            assert floor == want[-1][1] and more == sum(n > floor for _, n in rows)


def test_no_ordered_limit_over_all_terms(spark):
    table = materialise(spark.createDataFrame([(f"t{k}", k) for k in range(50)], "term string, cf bigint"), "top")
    plan = top_by_count(table, "cf", "term", 10)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "Sort" not in plan


def test_texts_are_read_once(spark, monkeypatch):
    read = []
    whole = counted.counted_tokens
    monkeypatch.setattr(index_build.counted, "counted_tokens", lambda *a: read.append(1) or whole(*a))
    index = build_index(corpus_of(spark, made_rows()), fresh_path(spark, "once"), buckets=2, term_parts=1)
    assert len(read) == 1
    for name in ("postings", "weights", "vectors", "vocab"):
        assert index.table(name).count() > 0


QUERY = [(1, "total age")]


def test_rebuild_in_place(spark):
    path = fresh_path(spark, "rebuilt")
    rows = made_rows()
    old = build_index(corpus_of(spark, rows[:20]), path, vocabulary=25, buckets=2, term_parts=1)
    queries = spark.createDataFrame(QUERY, "query_id int, query string")
    before = bm25_topk(old, queries, 50).collect()
    new = build_index(corpus_of(spark, rows), path, vocabulary=25, buckets=3, term_parts=2)
    assert old.version != new.version and index_store.open_index(spark, path).version == new.version
    assert bm25_topk(old, queries, 50).collect() == before and len(before) == 20
    assert bm25_topk(new, queries, 50).count() == 40
    assert index_store.open_index(spark, path, old.version).meta == old.meta
    assert index_store.remove_versions(spark, path) == [old.version]
    assert bm25_topk(index_store.open_index(spark, path), queries, 50).count() == 40


def test_half_built_index_is_not_opened(spark, monkeypatch):
    path = fresh_path(spark, "half")
    with pytest.raises(ValueError, match="no finished index"):
        index_store.open_index(spark, path)

    def stopped(*a):
        raise RuntimeError("executor lost")

    with monkeypatch.context() as broken:
        broken.setattr(index_build.bm25, "term_stats", stopped)
        with pytest.raises(RuntimeError):
            build_index(corpus_of(spark, made_rows()), path, buckets=2, term_parts=1)
    with pytest.raises(ValueError, match="no finished index"):
        index_store.open_index(spark, path)
    index = build_index(corpus_of(spark, made_rows()), path, buckets=2, term_parts=1)
    assert index_store.open_index(spark, path).version == index.version
    assert len(index_store.remove_versions(spark, path, unfinished=True)) == 1
    assert index.table("postings").count() > 0


def test_keyword_only_build(spark):
    index = build_index(corpus_of(spark, made_rows()), fresh_path(spark, "keywords"), buckets=2, term_parts=1, keyword_only=True)
    assert index.meta["n_vectors"] == 0 and index.table("weights").count() == 0
    assert index.table("counted").filter(F.col("embedding").isNotNull()).count() == 0
    queries = spark.createDataFrame(QUERY, "query_id int, query string")
    assert bm25_topk(index, queries, 5).count() == 5
