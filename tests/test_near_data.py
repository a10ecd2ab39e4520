"""Rerank beside the buckets, bounded heads of fields, patterns by their literals, agreement of vectors."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_search import QUERIES, corpus_of, made_rows

from shiori.operators import facets, lookup
from shiori.operators.bm25 import bm25_topk
from shiori.operators.rerank import prepared, rerank, reranked, scored, with_documents
from shiori.operators.term_blocks import valid_queries
from shiori.plans.hybrid import hybrid_search
from shiori.plans.index_build import build_index
from shiori.sources.catalogue import SEARCH_FIELDS
from shiori.sources.workspace import fresh_path, materialise


@pytest.fixture(scope="module")
def index(spark):
    return build_index(corpus_of(spark, made_rows()), fresh_path(spark, "near"), vocabulary=25, buckets=3, term_parts=1)


@pytest.fixture(scope="module")
def queries(spark):
    return materialise(valid_queries(spark.createDataFrame(list(QUERIES.items()), "query_id int, query string")), "queries")


@pytest.mark.parametrize("rows", [500_000, 0])
def test_scores_beside_the_buckets(index, queries, rows):
    listed = materialise(bm25_topk(index, queries, 12), "list")
    documents = with_documents(index, listed, 12, SEARCH_FIELDS).join(prepared(queries), "query_id")
    want = rerank(documents, 12).select("query_id", "doc_id", "score", "rk", "rerank_score").collect()
    assert sorted(map(tuple, scored(index, listed, queries, 12, broadcast_rows=rows).collect())) == sorted(map(tuple, want))


def test_no_text_in_the_rank_exchange(index, queries):
    listed = materialise(bm25_topk(index, queries, 12), "list")
    plan = reranked(index, listed, queries, 12, 5)._jdf.queryExecution().optimizedPlan().toString()
    ranked = plan[plan.index("Window") :].splitlines()
    columns = next(line for line in ranked if "Project" in line)
    assert "_text" not in columns.split("Project")[1].split("AS rerank_score")[-1]
    assert set(reranked(index, listed, queries, 12, 5).columns) == {"query_id", "doc_id", "score", "rk", "rerank_score", "rank"}


def test_vectors_must_agree(spark, index, queries):
    given = spark.createDataFrame([(1, [0.5] * 64)], "query_id int, embedding array<float>")
    assert hybrid_search(index, queries, 3, vectors=given, model="hashing-64").count() > 0
    with pytest.raises(ValueError, match="model|made with"):
        hybrid_search(index, queries, 3, vectors=given, model="another")
    with pytest.raises(ValueError, match="3 dimensions"):
        hybrid_search(index, queries, 3, vectors=spark.createDataFrame([(1, [0.5] * 3)], "query_id int, embedding array<float>"))
    mixed = spark.createDataFrame([(1, [0.5] * 64), (2, [0.5])], "query_id int, embedding array<float>")
    with pytest.raises(ValueError, match="different dimensions"):
        hybrid_search(index, queries, 3, vectors=mixed)


@pytest.mark.parametrize("held", [1_000_000, 20])
def test_first_names_of_fields(spark, monkeypatch, held):
    monkeypatch.setattr(facets, "HELD_NAMES", held)
    rng = random.Random(6)
    rows = [(rng.choice("AB" if k % 3 else "CDEFG"), f"n{min(rng.randrange(300), rng.randrange(300))}", k) for k in range(3000)]
    df = spark.createDataFrame(rows, "facet string, name string, doc_id long").repartition(6)
    tasks = facets.first_names(df, 12)
    firsts = {}
    for f, n, d in rows:
        firsts[f, n] = min(d, firsts.get((f, n), d))
    got = {(r["facet"], r["name"]): r["first"] for r in tasks.groupBy("facet", "name").agg(F.min("doc_id").alias("first")).collect()}
    for f in "ABCDEFG":
        want = sorted(((d, n) for (g, n), d in firsts.items() if g == f))[:12]
        mine = sorted((d, n) for (g, n), d in got.items() if g == f)[:12]
        assert mine == want
    if held > 20:
        assert tasks.count() <= 6 * 7 * 12


def test_literals_are_in_every_match():
    rng = random.Random(3)
    pieces = ["ab", "k", "ſ", "İ", "ß", "x+", "(cd)+", "(e|f)", "[gh]", ".*", "(?:ij)?", "^", "$", "(?P<q>kl)", "m{2}", "n{0,2}", r"\.", r"\d", "(?=o)o", "人口", "(?i:Q)", "σ"]
    letters = ["ab", "AB", "K", "K", "s", "S", "i", "ı", "ss", "ẞ", "x", "cd", "CD", "e", "g", "", "ij", "kl", "mm", "n", ".", "7", "o", "人口", "q", "Σ", "ς"]
    tried = matched = 0
    for _ in range(4000):
        pattern = "".join(rng.choices(pieces, k=rng.randrange(1, 5)))
        try:
            compiled = re.compile(pattern, re.IGNORECASE)
        except re.error:
            continue
        literal = lookup.required_literal(pattern)
        for _ in range(5):
            text = "".join(rng.choices(letters, k=rng.randrange(0, 7)))
            tried += 1
            if compiled.search(text):
                matched += 1
                assert literal in lookup.folded(text), (pattern, literal, text)
    assert matched > 500


def test_patterns_run_only_where_their_literal_is():
    keys = [f"name{k:03d}.*end" for k in range(200)] + [r"\d\d", "bad("]
    texts = [f"this is name{k:03d} up to the END" for k in range(150)] + ["nothing here"] * 500
    finder = lookup.PatternFinder(keys)
    first = lookup.first_rows(finder, [(list(range(len(texts))), texts)])
    assert first == {f"name{k:03d}.*end": k for k in range(150)} | {r"\d\d": 0}
    # One pattern a text that holds its literal, and the one without a literal on each text before its first match.
    assert finder.runs == 150 + 1 and len(finder.slow) == 1


@pytest.mark.parametrize("regex", [False, True])
def test_split_names_find_the_same_rows(spark, regex):
    rng = random.Random(9)
    words = ["alpha", "Beta", "gamma.", "d3lta", "人口", "x"]
    rows = [(k, " ".join(rng.choices(words, k=rng.randrange(1, 5))) if k % 11 else None) for k in range(200)]
    corpus = spark.createDataFrame(rows, "doc_id long, koumoku_name_full string")
    keys = spark.createDataFrame([(" ".join(rng.choices(words, k=2)),) for _ in range(60)] + [("zz",), ("",), (None,)], "key string")
    whole = sorted(map(tuple, lookup.containing(keys, corpus, regex).collect()))
    assert len(whole) > 10 and whole == sorted(map(tuple, lookup.containing(keys, corpus, regex, characters=60).collect()))
