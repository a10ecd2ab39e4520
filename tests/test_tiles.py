"""Many queries against many documents: tiles in single precision, exact scores for what can be among the best."""

import tracemalloc

import numpy as np
import pytest
from test_essential_terms import found_lists, ranked
from test_search import corpus_of, lists, made_rows

from shiori.operators import term_blocks
from shiori.operators.bm25 import bm25_topk
from shiori.plans.index_build import build_index
from shiori.sources.workspace import fresh_path


def texts(n_docs: int, n_queries: int, n_terms: int, length: int, seed: int = 1):
    """Documents and queries of two kinds, whose frequent terms differ; weights are positive."""
    rng = np.random.default_rng(seed)
    share = 1 / np.arange(1, n_terms + 1) ** 0.8
    rows = []
    for n in (n_docs, n_queries):
        kind = np.where(rng.random((n, 1)) < 0.6, share, share[::-1])
        held = rng.random((n, n_terms)) < length * kind / share.sum()
        rows.append(held * np.round(rng.random((n, n_terms)) * 8 + 0.1, 1))
    return rows[0], rows[1].T


def matrix_of(queries: np.ndarray) -> term_blocks.QueryMatrix:
    term, query = np.nonzero(queries)
    return term_blocks.QueryMatrix(term, query, queries[term, query], *queries.shape)


def part_of(documents: np.ndarray, ids: np.ndarray):
    doc, cell = np.nonzero(documents)
    return ids, np.searchsorted(doc, np.arange(len(documents) + 1)), cell, documents[doc, cell]


@pytest.mark.parametrize("dense", [0.0, 0.5, 1e9])
def test_best_of_positive_weights_equals_all_scores(monkeypatch, dense):
    """Whichever way documents are met, in many tiles and groups, with equal documents and queries that nothing matches."""
    for name, value in dict(FIRST_ROUND=20, ROUND=64, SCORE_CELLS=500, TILE_CELLS=900, TILE_QUERIES=17, TABLE_CELLS=300, HELD_CELLS=4_000, DENSE=dense).items():
        monkeypatch.setattr(term_blocks, name, value)
    documents, queries = texts(700, 60, 80, 9)
    documents[300:420] = documents[5]
    queries[:, 7] = 0
    ids = np.random.default_rng(2).permutation(700) * 3
    matrix = matrix_of(queries)
    parts = [part_of(documents[:450], ids[:450]), part_of(documents[450:], ids[450:])]
    for k in (1, 5, 800):
        got, want = found_lists(matrix.best(parts, k, 0.5e-6)), ranked(documents @ queries, ids, k, 1e-6)
        for q in range(queries.shape[1]):
            assert [d for d, _ in got[q]] == [d for d, _ in want[q]]
            assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=2e-6)


def test_scores_closer_than_single_precision_are_told_apart():
    """Documents whose scores differ in the sixth decimal alone, at scores of many thousands."""
    n = 400
    documents = np.concatenate([np.full((n, 1), 9_000.0), 1e-6 * np.random.default_rng(3).permutation(n)[:, None]], axis=1)
    queries = np.array([[1.0], [2.0]])
    got = found_lists(matrix_of(queries).best([part_of(documents, np.arange(n))], 10, 0.5e-6))
    assert [d for d, _ in got[0]] == [d for d, _ in ranked(documents @ queries, np.arange(n), 10, 1e-6)[0]]


def test_few_equal_documents_are_kept(monkeypatch):
    """Equal scores beyond the list do not pile up."""
    monkeypatch.setattr(term_blocks, "WAITING", 100)
    kept = []
    merge = term_blocks.Nearly.merge
    monkeypatch.setattr(term_blocks.Nearly, "merge", lambda self: merge(self) or kept.append(len(self.query)))
    n = 20_000
    found = matrix_of(np.ones((1, 3))).best([part_of(np.ones((n, 1)), np.arange(n)[::-1])], 5, 0.5e-6)
    assert [d for d, _ in found_lists(found)[2]] == [0, 1, 2, 3, 4]
    assert max(kept) < 200


def test_few_documents_are_worked_out_again(monkeypatch):
    """Documents in double precision: about as many as the lists hold, once for all rounds."""
    monkeypatch.setattr(term_blocks, "DENSE", 0.0)
    again = []
    exact = term_blocks.QueryMatrix._exact
    monkeypatch.setattr(term_blocks.QueryMatrix, "_exact", lambda self, *a: again.append(len(a[2])) or exact(self, *a))
    documents, queries = texts(12_000, 300, 120, 12)
    found_lists(matrix_of(queries).best([part_of(documents, np.arange(12_000))], 10, 0.5e-6))
    assert sum(again) < 1.5 * 10 * 300


def test_memory_of_a_task_is_bounded():
    """Many queries that share terms with all documents: no arrays of all their entries."""
    documents, queries = texts(6_000, 3_000, 300, 40)
    matrix, part = matrix_of(queries), part_of(documents, np.arange(6_000))
    del documents, queries
    tracemalloc.start()
    matrix.best([part], 10, 0.5e-6)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6


def test_splits_equal_the_whole(spark, monkeypatch):
    """Splits packed in the tasks, met by held documents a few at a time."""
    index = build_index(corpus_of(spark, made_rows()), fresh_path(spark, "tiles"), vocabulary=25, buckets=2, term_parts=2)
    words = ["人口", "total", "Total", "age", "rate", "school", "x", "世帯", "income", "Tokyo", "unknown"]
    rng = np.random.default_rng(6)
    asked = [(int(q), " ".join(rng.choice(words, rng.integers(1, 9)))) for q in range(300)]
    queries = spark.createDataFrame(asked, "query_id int, query string")
    whole = lists(bm25_topk(index, queries, 5, pad=False))
    monkeypatch.setattr(term_blocks, "HELD_CELLS", 20)
    assert lists(bm25_topk(index, queries, 5, pad=False, block_terms=100)) == whole


def test_rows_without_query_id_are_one_query(spark):
    """They take no part in the list of another query."""
    index = build_index(corpus_of(spark, made_rows()), fresh_path(spark, "no-id"), vocabulary=25, buckets=2, term_parts=2)
    named = [(1, "total age"), (2, "school income"), (3, "Tokyo rate")]
    asked = spark.createDataFrame([*named, (None, "人口 rate"), (None, "income rate")], "query_id int, query string")
    alone = spark.createDataFrame([*named, (9, "人口 rate income rate")], "query_id int, query string")
    want = lists(bm25_topk(index, alone, 5, pad=False))
    want[None] = want.pop(9)
    assert len(want[None]) == 5
    assert lists(bm25_topk(index, asked, 5, pad=False)) == want
    assert lists(bm25_topk(index, asked, 5, pad=False, block_terms=2)) == want
