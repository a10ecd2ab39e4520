"""Query tables of any size: documents are met by essential terms, never copied, and merged at a cost in proportion."""

import numpy as np
import pytest
from test_search import corpus_of, lists, made_rows

from shiori.functions.scores import unit
from shiori.operators import task_topk, term_blocks
from shiori.operators.bm25 import bm25_topk
from shiori.operators.task_topk import TaskBest
from shiori.operators.vectors import vector_topk
from shiori.plans.index_build import build_index
from shiori.sources.workspace import fresh_path


def ranked(scores: np.ndarray, ids: np.ndarray, k: int, least: float) -> dict[int, list[tuple[int, float]]]:
    scores = np.rint(scores * 1e6) / 1e6
    out = {}
    for q in range(scores.shape[1]):
        rows = sorted((-s, d) for d, s in zip(ids.tolist(), scores[:, q].tolist(), strict=True) if s >= least)[:k]
        out[q] = [(d, -s) for s, d in rows]
    return out


def found_lists(found: TaskBest) -> dict[int, list[tuple[int, float]]]:
    found.merge()
    out = {q: [] for q in range(len(found.floor))}
    for q, d, s in zip(found.query.tolist(), found.doc.tolist(), found.score.tolist(), strict=True):
        out[q].append((d, s))
    return out


@pytest.mark.parametrize("dense", [0.0, 0.1, 2.0])
def test_best_equals_all_scores(monkeypatch, dense):
    """Whichever way documents are met, also with negative weights, many ties and cells a few at a time."""
    monkeypatch.setattr(term_blocks, "FIRST_ROUND", 20)
    monkeypatch.setattr(term_blocks, "ROUND", 64)
    monkeypatch.setattr(term_blocks, "SCORE_CELLS", 500)
    monkeypatch.setattr(term_blocks, "DENSE", dense)
    rng = np.random.default_rng(3)
    n_docs, n_terms, n_queries = 700, 40, 30
    share = 0.9 / np.arange(1, n_terms + 1)
    documents = rng.integers(1, 4, (n_docs, n_terms)) * (rng.random((n_docs, n_terms)) < share) / 2
    queries = rng.integers(-1, 6, (n_terms, n_queries)) * (rng.random((n_terms, n_queries)) < 0.3) / 1.5
    term, query = np.nonzero(queries)
    matrix = term_blocks.QueryMatrix(term, query, queries[term, query], n_terms, n_queries)
    doc, cell = np.nonzero(documents)
    bounds = np.searchsorted(doc, np.arange(n_docs + 1))
    ids = rng.permutation(n_docs) * 3
    parts = [(ids[:500], bounds[:501], cell, documents[doc, cell]), (ids[500:], bounds[500:], cell, documents[doc, cell])]
    for k in (1, 5, 800):
        got = found_lists(matrix.best(parts, k, 0.5e-6))
        want = ranked(documents @ queries, ids, k, 1e-6)
        for q in range(n_queries):
            assert [d for d, _ in got[q]] == [d for d, _ in want[q]]
            assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=2e-6)


def test_frequent_terms_are_not_met_document_by_document(monkeypatch):
    """One frequent term in all queries and one rare term in each: with floors known, entries are those of the rare terms."""
    met = []
    spans = term_blocks._spans
    monkeypatch.setattr(term_blocks, "_spans", lambda starts, n: met.append(int(n.sum())) or spans(starts, n))
    monkeypatch.setattr(term_blocks, "_slices", lambda n, most: iter([slice(0, len(n))]))
    n_docs, n_queries = 60_000, 50
    rare = 1 + np.arange(n_docs) % 500
    doc = np.repeat(np.arange(n_docs), 2)
    term = np.stack([np.zeros(n_docs, int), rare], axis=1).ravel()
    asked = np.concatenate([np.zeros(n_queries, int), 1 + np.arange(n_queries)])
    weight = np.concatenate([np.full(n_queries, 0.5), np.full(n_queries, 4.0)])
    matrix = term_blocks.QueryMatrix(asked, np.tile(np.arange(n_queries), 2), weight, 501, n_queries)
    found = matrix.best([(np.arange(n_docs), np.arange(0, 2 * n_docs + 1, 2), term, np.ones(len(doc)))], 3, 0.5e-6)
    assert found_lists(found)[7] == [(7, 4.5), (507, 4.5), (1007, 4.5)]
    assert sum(met) < n_docs * n_queries / 20


def test_merges_cost_in_proportion(monkeypatch):
    """Small blocks do not have all known rows sorted again."""
    monkeypatch.setattr(task_topk, "WAITING", 1_000)
    sorted_rows = []
    lexsort = np.lexsort
    monkeypatch.setattr(task_topk.np, "lexsort", lambda keys: sorted_rows.append(len(keys[0])) or lexsort(keys))
    rng = np.random.default_rng(5)
    scores = rng.random((4_000, 100))
    found = TaskBest(100, 50)
    for low in range(0, 4_000, 20):
        found.add(np.arange(low, low + 20), scores[low : low + 20])
    assert found_lists(found) == ranked(scores, np.arange(4_000), 50, -1)
    assert sum(sorted_rows) < 200 * 100 * 50 / 3


def test_scores_that_are_no_numbers_take_no_place():
    scores = np.array([[np.nan], [0.5], [0.25], [np.nan], [1.0]])
    found = TaskBest(1, 2)
    found.add(np.arange(5), scores)
    assert found_lists(found) == {0: [(4, 1.0), (1, 0.5)]}


def test_splits_copy_no_postings(spark):
    index = build_index(corpus_of(spark, made_rows()), fresh_path(spark, "no-copies"), vocabulary=25, buckets=3, term_parts=2)
    queries = spark.createDataFrame([(q, w) for q, w in enumerate(["total age", "Total", "rate x", "income school", "人口"])], "query_id int, query string")
    split = bm25_topk(index, queries, 5, pad=False, block_terms=2)
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan and "explode" not in plan.lower() and plan.count("Exchange hashpartitioning") == 1
    assert lists(split) == lists(bm25_topk(index, queries, 5, pad=False))


def test_small_vectors_stay_where_they_are(spark):
    """As many query vectors are sent to the documents as their components allow."""
    rows = [(i, [float(i % 7), 1.0, float(i % 11)]) for i in range(6_000)]
    asked = spark.createDataFrame(rows, "query_id bigint, embedding array<float>")
    stored = spark.createDataFrame(rows[:80], "doc_id bigint, embedding array<float>")
    found = vector_topk(stored, asked, 2)
    assert "CoGroup" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 12_000


def test_norm_is_worked_out_once(spark):
    """A long vector takes no time in proportion to the square of its length; null components and vectors stay as they were."""
    rows = [([3.0, 4.0],), ([0.0, 0.0],), (None,), ([],), ([1.0, None],)]
    got = [r[0] for r in spark.createDataFrame(rows, "v array<float>").select(unit("v").alias("u")).collect()]
    assert got[0] == pytest.approx([0.6, 0.8]) and got[1:4] == [[0.0, 0.0], None, []] and got[4] == [1.0, None]
    tree = spark.createDataFrame(rows, "v array<float>").select(unit("v").alias("u"))._jdf.queryExecution().optimizedPlan().toString()
    assert tree.count("aggregate(") == 1


@pytest.mark.parametrize("dense", [0.0, 2.0])
def test_rows_of_one_document_add_up(monkeypatch, dense):
    """A document whose rows repeat: the cells of a rare term add up, whichever way it is met."""
    monkeypatch.setattr(term_blocks, "DENSE", dense)
    monkeypatch.setattr(term_blocks, "FIRST_ROUND", 2)
    matrix = term_blocks.QueryMatrix(np.arange(5), np.arange(5), np.full(5, 2.0), 5, 5)
    term = np.array([0, 0, 1, 0, 3, 3, 3, 3, 4])
    found = matrix.best([(np.array([10, 20, 30]), np.array([0, 3, 4, 9]), term, np.ones(9))], 2, 0.5e-6)
    assert found_lists(found) == {0: [(10, 4.0), (20, 2.0)], 1: [(10, 2.0)], 2: [], 3: [(30, 8.0)], 4: [(30, 2.0)]}
