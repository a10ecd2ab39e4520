"""Pruned search for many query vectors: equal to every score worked out, and less work where vectors are in clusters."""

import numpy as np
import pytest
from pyspark.sql import types as T

from shiori.operators.cluster_topk import Plan, centres_of
from shiori.operators.vectors import vector_topk
from test_vectors import frame, got, want


def in_clusters(rng, n, dimension, clusters):
    centres = rng.normal(size=(clusters, dimension))
    rows = centres[rng.integers(0, clusters, n)] + 0.02 * rng.normal(size=(n, dimension))
    return np.float32(rows / np.linalg.norm(rows, axis=1, keepdims=True))


def plan(spark, docs, queries, k, query_block=8, doc_block=50):
    schema = T.StructType().add("query_id", T.LongType()).add("doc_id", T.LongType()).add("score", T.DoubleType())
    return Plan(frame(spark, docs, "doc_id"), frame(spark, queries, "query_id"), k, query_block, doc_block, schema)


def test_clusters_are_passed_over_and_lists_are_whole(spark):
    rng = np.random.default_rng(3)
    docs, queries = in_clusters(rng, 1_500, 16, 12), in_clusters(np.random.default_rng(3), 60, 16, 12)
    found = vector_topk(frame(spark, docs, "doc_id").repartition(4), frame(spark, queries, "query_id"), 5, query_block=8, doc_block=50)
    assert got(found) == want(docs, queries, 5)
    share = plan(spark, docs, queries, 5).share_met().first()
    assert share.pairs == len(docs) * len(queries) and share.met < share.pairs / 2


def test_one_cluster_of_copies_is_cut_into_blocks(spark):
    """A third of all rows are one vector: ties go by id, whichever block they are in."""
    rng = np.random.default_rng(5)
    docs = np.float32(rng.integers(-2, 3, (600, 4)))
    docs[rng.permutation(600)[:200]] = [3, 3, 3, 3]
    queries = np.float32(rng.integers(-2, 3, (30, 4)))
    found = vector_topk(frame(spark, docs, "doc_id"), frame(spark, queries, "query_id"), 7, query_block=4, doc_block=25)
    assert got(found) == want(docs, queries, 7)


@pytest.mark.parametrize("k", [1, 40, 900])
def test_vectors_of_different_lengths(spark, k):
    rng = np.random.default_rng(k)
    docs = np.float32(rng.normal(size=(400, 6)) * rng.exponential(3, (400, 1)))
    docs[:5] = 0
    queries = np.float32(rng.normal(size=(25, 6)))
    queries[0] = 0
    found = vector_topk(frame(spark, docs, "doc_id"), frame(spark, queries, "query_id"), k, query_block=6, doc_block=60)
    assert got(found) == want(docs, queries, k)


def test_no_documents(spark):
    docs = frame(spark, [[1.0, 0.0]], "doc_id").filter("doc_id > 3")
    assert vector_topk(docs, frame(spark, [[1.0, 0.0]] * 5, "query_id"), 3, query_block=2).count() == 0


def test_documents_that_are_not_numbers_hide_no_others(spark):
    docs = np.float32(np.random.default_rng(2).normal(size=(300, 4)))
    docs[7] = np.nan
    queries = np.float32(np.random.default_rng(4).normal(size=(9, 4)))
    found = vector_topk(frame(spark, docs, "doc_id"), frame(spark, queries, "query_id"), 301, query_block=3, doc_block=40)
    rest = {(r["query_id"], r["doc_id"]) for r in found.collect() if r["doc_id"] != 7}
    assert rest == {(q, d) for q in range(9) for d in range(300) if d != 7}


def test_centres():
    same = np.ones((50, 3))
    assert len(centres_of(same, 10)) == 1
    assert len(centres_of(np.arange(60.0).reshape(20, 3), 4)) == 4
    assert (centres_of(np.full((3, 2), np.nan), 4) == 0).all()
