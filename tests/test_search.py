"""Index, retrievers, fusion, rerank and hybrid search against plain Python on a small corpus."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from shiori.functions.scores import best, by_score
from shiori.operators.bm25 import bm25_topk
from shiori.operators.fusion import fuse
from shiori.operators.rerank import lexical_score, prepared, with_documents
from shiori.operators.tfidf import tfidf_topk
from shiori.operators.vectors import hashing_embedder
from shiori.plans.hybrid import hybrid_search
from shiori.plans.index_build import build_index, document_tokens
from shiori.sources.catalogue import build_corpus, search_text
from shiori.sources.index_store import forget, open_index, table_name
from shiori.sources.workspace import fresh_path

FIELDS = ["koumoku_code", "koumoku_name_full", "bunya_name", "chuubunrui_name", "shoubunrui_name", "stat_name"]
VOCABULARY = 25


def corpus_of(spark, rows):
    """rows: dicts of the six fields plus doc_id; a missing definition is ''."""
    catalogue = [(r["doc_id"], str(r["doc_id"]), *[r[f] for f in FIELDS[1:]]) for r in rows]
    schema = "doc_id bigint, " + ", ".join(f"{f} string" for f in FIELDS)
    defs = [(str(r["doc_id"]), r["definition"]) for r in rows if r["definition"]]
    return build_corpus(
        spark.createDataFrame(catalogue, schema),
        spark.createDataFrame(defs or [("none", "")], "koumoku_code string, definition string"),
        "doc_id",
    )


def made_rows():
    rng = random.Random(3)
    words = ["人口", "total", "Total", "age", "rate", "school", "x", "世帯", "income", "Tokyo"]

    def text(n):
        return " ".join(rng.choices(words, weights=[9, 7, 2, 3, 3, 2, 5, 2, 1, 1], k=n))

    rows = [
        {
            "doc_id": 5 + 3 * i,
            "koumoku_name_full": text(rng.randrange(1, 7)) + ("　end" if i % 7 == 0 else ""),
            "bunya_name": rng.choice(["population", "Education", None]),
            "chuubunrui_name": text(1),
            "shoubunrui_name": "" if i % 3 else text(2),
            "definition": text(4) if i % 4 == 0 else "",
            "stat_name": "census",
        }
        for i in range(40)
    ]
    return rows


QUERIES = {
    1: "人口 total",
    2: "age age rate",
    3: "nothing known",
    4: " census　school ",
    5: "total age rate school income Tokyo",
    6: "x",
}


@pytest.fixture(scope="module")
def rows():
    return made_rows()


@pytest.fixture(scope="module")
def index(spark, rows):
    return build_index(
        corpus_of(spark, rows), fresh_path(spark, "test-index"), vocabulary=VOCABULARY, buckets=3, term_parts=4
    )


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([*QUERIES.items(), (7, " 　"), (8, None)], "query_id int, query string")


def lists(df):
    out = {}
    for r in df.orderBy("query_id", "rk").collect():
        out.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
        assert r["rk"] == len(out[r["query_id"]])
    return out


def close(got, want):
    assert [d for d, _ in got] == [d for d, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=2e-6)


@pytest.mark.parametrize("terms", [10_000, 3])
def test_bm25_padded(index, queries, rows, terms):
    texts = {r["doc_id"]: brute.text_of(r) for r in rows}
    got = lists(bm25_topk(index, queries, 12, block_terms=terms))
    assert set(got) == set(QUERIES)
    for q, text in QUERIES.items():
        close(got[q], brute.top(brute.bm25(texts, text), 12))


def test_bm25_unpadded(index, queries, rows):
    texts = {r["doc_id"]: brute.text_of(r) for r in rows}
    got = lists(bm25_topk(index, queries, 12, pad=False))
    assert 3 not in got
    for q in got:
        close(got[q], [p for p in brute.top(brute.bm25(texts, QUERIES[q]), 12) if p[1] > 0])


@pytest.mark.parametrize("terms", [10_000, 3])
def test_tfidf_padded(index, queries, rows, terms):
    texts = {r["doc_id"]: brute.text_of(r) for r in rows}
    got = lists(tfidf_topk(index, queries, 12, block_terms=terms))
    for q, text in QUERIES.items():
        close(got[q], brute.top(brute.tfidf(texts, text, VOCABULARY), 12))


@pytest.mark.parametrize("size", [3, 5, 12, 25, 10_000])
def test_vocabulary_cap(spark, index, rows, size):
    from shiori.operators.tfidf import vocabulary

    tokens = document_tokens(index.corpus.withColumn("search_text", search_text()))
    got = {r["term"]: (r["df"], r["cf"], pytest.approx(r["idf"])) for r in vocabulary(tokens, 40, size).collect()}
    assert brute.vocabulary({r["doc_id"]: brute.text_of(r) for r in rows}, size) == got


def test_depth_beyond_corpus(index, queries):
    got = lists(bm25_topk(index, queries, 100))
    assert {len(v) for v in got.values()} == {40}


def test_scoring_does_not_shuffle_pairs(index, queries):
    """Scores are made inside the buckets: the only exchange is by query, after each task's own top-k."""
    plan = bm25_topk(index, queries, 5, pad=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Exchange hashpartitioning(query_id" in plan
    assert "WindowGroupLimit" in plan and "Bucketed: true" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_few_terms_prune_the_scan(spark, index):
    """A short query reads only the term partitions of its words and pushes the words to the files."""
    short = spark.createDataFrame([(1, "income")], "query_id int, query string")
    plan = bm25_topk(index, short, 5, pad=False)._jdf.queryExecution().executedPlan().toString()
    assert "term_part" in plan.split("PartitionFilters")[1].split("]")[0]
    assert "EqualTo(term,income)" in plan or "In(term" in plan


def test_many_blocks_give_the_same_lists(index, queries):
    from shiori.operators.term_blocks import blocks_topk
    from shiori.operators import bm25

    weighted = bm25.query_weights(index, bm25.valid_queries(queries))
    postings = bm25._weighted_postings(index)
    one = best(blocks_topk(postings, weighted, 6), 6, ["query_id"], by_score())
    many = best(blocks_topk(postings, weighted, 6, block_queries=1), 6, ["query_id"], by_score())
    assert sorted(one.collect()) == sorted(many.collect())


def test_floored_idf(spark):
    """Words in more than half of the documents take the floor."""
    names = ["a b", "a b", "a b c", "a", "zz"]
    rows = [
        dict(doc_id=i, koumoku_name_full=n, bunya_name="", chuubunrui_name="", shoubunrui_name="", definition="", stat_name="")
        for i, n in enumerate(names)
    ]
    index = build_index(corpus_of(spark, rows), fresh_path(spark, "floored"), term_parts=1, buckets=2)
    texts = {i: n for i, n in enumerate(names)}
    queries = spark.createDataFrame([(1, "a"), (2, "a b c zz"), (3, "b")], "query_id int, query string")
    for depth in (2, 4, 9):
        got = lists(bm25_topk(index, queries, depth))
        for q, text in ((1, "a"), (2, "a b c zz"), (3, "b")):
            close(got[q], brute.top(brute.bm25(texts, text), depth))


def test_negative_idf(spark):
    """Most words in most documents: the floor is negative, so matched documents rank below unmatched ones."""
    names = ["a b", "a b", "b a", "a"]
    rows = [
        dict(doc_id=i, koumoku_name_full=n, bunya_name="", chuubunrui_name="", shoubunrui_name="", definition="", stat_name="")
        for i, n in enumerate([*names, "b b", "  "])
    ]
    index = build_index(corpus_of(spark, rows), fresh_path(spark, "negative"), term_parts=1, buckets=2)
    assert index.meta["avg_raw"] < 0
    texts = {r["doc_id"]: r["koumoku_name_full"] for r in rows}
    queries = spark.createDataFrame([(1, "a"), (2, "a b"), (3, "c")], "query_id int, query string")
    for depth in (1, 3, 9):
        got = lists(bm25_topk(index, queries, depth))
        for q, text in ((1, "a"), (2, "a b"), (3, "c")):
            close(got[q], brute.top(brute.bm25(texts, text), depth))


def test_fusion_ties_keep_first_seen_order(spark):
    def ranked(pairs):
        rows = [(1, d, float(s), i + 1) for i, (d, s) in enumerate(pairs)]
        return spark.createDataFrame(rows, "query_id int, doc_id bigint, score double, rk int")

    vector = [(9, 0.5), (3, 0.5)]
    keyword = [(7, 4.0), (2, 4.0), (3, 0.0)]
    tfidf = [(8, 1.0), (1, 1.0), (9, 0.0)]
    for w in (0.6, 0.0, 1.0):
        got = lists(fuse(ranked(vector), ranked(keyword), ranked(tfidf), 6, w))[1]
        close(got, brute.fuse(vector, keyword, tfidf, 6, w))
    zeros = [(4, 0.0), (5, 0.0)]
    got = lists(fuse(ranked(vector), ranked(zeros), ranked(zeros), 3, 0.6))[1]
    close(got, brute.fuse(vector, zeros, zeros, 3, 0.6))


def test_lexical_score(spark):
    rows = [
        dict(zip(brute.FIELDS, v))
        for v in [
            ("Total Fertility Rate", None, "rate", "", "the rate of rate", "x"),
            ("fertility rate", "a fertility rate b", None, None, None, None),
            ("Fertility　RATE total", "", "", "", "", ""),
        ]
    ]
    df = spark.createDataFrame([(1, i, *[r[f] for f in brute.FIELDS]) for i, r in enumerate(rows)],
                               "query_id int, i int, " + ", ".join(f"{f} string" for f in brute.FIELDS))
    query = "Fertility Rate"
    asked = prepared(spark.createDataFrame([(1, query)], "query_id int, query string"))
    got = df.join(asked, "query_id").select("i", lexical_score([F.col(f) for f in brute.FIELDS])).orderBy("i").collect()
    assert [r[1] for r in got] == [brute.lexical(r, query) for r in rows]


@pytest.mark.parametrize("k,w", [(4, 0.6), (30, 0.6), (5, 0.0), (5, 1.0)])
def test_hybrid(index, queries, rows, k, w):
    texts = {r["doc_id"]: brute.text_of(r) for r in rows}
    by_id = {r["doc_id"]: r for r in rows}
    embed = hashing_embedder(64)
    ids = sorted(texts)
    vectors = dict(zip(ids, embed([texts[d].strip() for d in ids])))
    got = hybrid_search(index, queries, k, w).orderBy("query_id", "rank").collect()
    for q, text in QUERIES.items():
        text = text.strip()
        depth = 2 * k
        fused = brute.fuse(
            brute.top(brute.vector(vectors, embed([text])[0]), depth),
            brute.top(brute.bm25(texts, text), depth),
            brute.top(brute.tfidf(texts, text, VOCABULARY), depth),
            depth,
            w,
        )
        ordered = sorted(fused, key=lambda p: -brute.lexical(by_id[p[0]], text))[: min(k, 80)]
        mine = [r for r in got if r["query_id"] == q]
        close([(r["doc_id"], r["score"]) for r in mine], ordered)
        for r in mine:
            assert r["bunya_name"] == by_id[r["doc_id"]]["bunya_name"]
            assert r["rerank_score"] == brute.lexical(by_id[r["doc_id"]], text)


def test_vector_weight_one_keeps_vector_order(index, queries):
    got = hybrid_search(index, queries, 5, 1.0, reranked=False).orderBy("query_id", "rank").collect()
    scores = {}
    for r in got:
        scores.setdefault(r["query_id"], []).append(r["score"])
    assert all(s == sorted(s, reverse=True) and len(s) == 5 for s in scores.values())


def test_reopen(spark, index, queries):
    before = lists(bm25_topk(index, queries, 5))
    forget(index)
    assert not spark.catalog.tableExists(table_name(index.path, "postings"))
    again = open_index(spark, index.path + "/")
    assert again.meta == index.meta
    assert lists(bm25_topk(again, queries, 5)) == before
    assert again.first_ids(2) == [5, 8]


def test_documents_joined_on_both_paths(index, queries):
    """Few candidates are broadcast and prune partitions; many are shuffled to the buckets, the corpus is not."""
    listed = bm25_topk(index, queries, 12).persist()
    few = with_documents(index, listed, 12, ["koumoku_name_full"])
    many = with_documents(index, listed, 12, ["koumoku_name_full"], broadcast_rows=0)
    columns = ["query_id", "doc_id", "koumoku_name_full", "rk"]
    assert sorted(few.select(columns).collect()) == sorted(many.select(columns).collect())
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "dynamicpruning" in plan
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and plan.count("Exchange hashpartitioning(doc_id") == 1
