"""Many queries in one scan: the sparse query matrix, splits as keys of one job, negative scores without collected ids."""

import random

import brute
import numpy as np
import pytest
from test_search import close, corpus_of, lists, made_rows

from shiori.operators import term_blocks
from shiori.operators.bm25 import bm25_topk
from shiori.plans.index_build import build_index
from shiori.sources.workspace import fresh_path


def test_matrix_scores_equal_a_dense_product():
    rng = np.random.default_rng(1)
    for n_queries in (1, 3, 50):
        dense = rng.random((30, n_queries)) * (rng.random((30, n_queries)) < rng.choice([0.05, 0.5, 1.0], 30)[:, None])
        term, query = np.nonzero(dense)
        shuffled = rng.permutation(len(term))
        matrix = term_blocks.QueryMatrix(term[shuffled], query[shuffled], dense[term, query][shuffled], 30, n_queries)
        documents = rng.random((12, 30)) * (rng.random((12, 30)) < 0.4)
        doc, cell = np.nonzero(documents)
        assert np.allclose(matrix.scores(12, doc, cell, documents[doc, cell]), documents @ dense)


@pytest.fixture(scope="module")
def index(spark):
    return build_index(corpus_of(spark, made_rows()), fresh_path(spark, "one-scan"), vocabulary=25, buckets=3, term_parts=2)


def test_any_number_of_queries_scans_the_postings_once(spark, index):
    rng = random.Random(4)
    words = ["人口", "total", "Total", "age", "rate", "school", "x", "世帯", "income", "Tokyo", "unknown"]
    asked = {q: " ".join(rng.choices(words, k=rng.randrange(1, 9))) for q in range(400)}
    queries = spark.createDataFrame(list(asked.items()), "query_id int, query string")
    whole = bm25_topk(index, queries, 5, pad=False)
    split = bm25_topk(index, queries, 5, pad=False, block_terms=150)
    for df in (whole, split):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("_postings") == 1 and "Union" not in plan
    texts = {r["doc_id"]: brute.text_of(r) for r in made_rows()}
    got, parts = lists(whole), lists(split)
    for q, text in asked.items():
        want = [p for p in brute.top(brute.bm25(texts, text), 5) if p[1] > 0]
        close(got.get(q, []), want)
        close(parts.get(q, []), want)


@pytest.mark.parametrize("terms", [10_000, 2])
def test_negative_floor_ranks_in_the_tasks(spark, terms):
    """No ids reach the plan and no score rows of all pairs are made; unknown queries still get their list."""
    names = ["a b"] * 5 + ["b a"] * 3 + ["a", "c d", "", "a c"]
    rows = [
        dict(doc_id=3 * i, koumoku_name_full=n, bunya_name="", chuubunrui_name="", shoubunrui_name="", definition="", stat_name="")
        for i, n in enumerate(names)
    ]
    index = build_index(corpus_of(spark, rows), fresh_path(spark, "negative"), term_parts=1, buckets=2)
    texts = {r["doc_id"]: r["koumoku_name_full"] for r in rows}
    if index.meta["avg_raw"] >= 0:
        index.meta["avg_raw"] = -1.0
    asked = {1: "a", 2: "a b", 3: "zz", 4: "c d a", 5: "b b"}
    queries = spark.createDataFrame(list(asked.items()), "query_id int, query string")
    for depth in (1, 4, 30):
        df = bm25_topk(index, queries, depth, block_terms=terms)
        got = lists(df)
        for q in asked:
            ranked = got[q]
            assert len(ranked) == min(depth, len(names))
            assert ranked == sorted(ranked, key=lambda p: (-p[1], p[0]))
            zeros = [d for d, s in ranked if s == 0]
            assert zeros == sorted(zeros)
            unmatched = [d for d in texts if not set(texts[d].split()) & set(asked[q].split())]
            assert set(zeros) <= set(unmatched) and zeros == unmatched[: len(zeros)]
