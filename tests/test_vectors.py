import numpy as np
import pytest
from pyspark.errors import PySparkException

from shiori.operators.vectors import (
    dimension_check,
    embed,
    first_available,
    hashing_embedder,
    query_units,
    unit_vectors,
    vector_topk,
)


def frame(spark, matrix, name):
    rows = [(i, [float(x) for x in v] if v is not None else None) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{name} bigint, embedding array<float>")


def want(docs, queries, k):
    out = set()
    for q, query in enumerate(queries):
        scores = [(d, round(float(np.dot(np.float64(v), np.float64(query))), 6)) for d, v in enumerate(docs) if v is not None]
        for rk, (d, s) in enumerate(sorted(scores, key=lambda p: (-p[1], p[0]))[:k], 1):
            out.add((q, d, s, rk))
    return out


def got(df):
    return {(r["query_id"], r["doc_id"], round(r["score"], 6), r["rk"]) for r in df.collect()}


@pytest.mark.parametrize("block", [4096, 7])
@pytest.mark.parametrize("k", [1, 5, 500])
def test_topk_on_both_paths(spark, block, k):
    rng = np.random.default_rng(1)
    docs = list(np.float32(rng.integers(-2, 3, (150, 4))))  # small integers: many ties
    docs[3] = None
    queries = list(np.float32(rng.integers(-2, 3, (20, 4))))
    found = vector_topk(
        frame(spark, docs, "doc_id").repartition(5), frame(spark, queries, "query_id"), k, query_block=block, doc_block=40
    )
    assert got(found) == want(docs, queries, k)


def test_no_queries(spark):
    docs = frame(spark, [[1.0, 0.0]], "doc_id")
    assert vector_topk(docs, frame(spark, [[1.0, 0.0]], "query_id").filter("query_id > 5"), 3).count() == 0


def test_zero_vector_is_kept(spark):
    rows = unit_vectors(frame(spark, [[0, 0], [3, 4]], "doc_id")).orderBy("doc_id").collect()
    assert rows[0]["embedding"] == [0.0, 0.0]
    assert rows[1]["embedding"] == pytest.approx([0.6, 0.8])


def test_embed_in_batches(spark):
    texts = [f"word{i % 7} 共通 word{i}" for i in range(57)]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string").repartition(3)
    rows = embed(df, "id", "text", hashing_embedder(16), batch_size=10).collect()
    expected = hashing_embedder(16)(texts)
    assert len(rows) == 57
    for r in rows:
        assert r["embedding"] == pytest.approx(list(expected[r["id"]]))


def test_failing_batch_fails_the_job(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, text string")
    with pytest.raises(PySparkException):
        embed(df, "id", "text", lambda texts: np.array([])).count()


def test_dimensions(spark):
    assert list(dimension_check(frame(spark, [[1, 2], [3, 4], None], "d")).first()) == [2, 2, True]
    assert list(dimension_check(frame(spark, [[1, 2], [3]], "d")).first()) == [2, 2, False]


def test_first_available():
    a, b = hashing_embedder(2), hashing_embedder(3)
    assert first_available([("a", lambda: False, a), ("b", lambda: True, b)], "a") == ("b", b)
    assert first_available([("a", lambda: False, a), ("b", lambda: False, b)], "a") == ("a", a)


def test_query_vectors_are_asked_at_unit_length(spark):
    rows = query_units(frame(spark, [[0, 0], [3, 4], [0.6, 0.8]], "query_id")).orderBy("query_id").collect()
    given = [list(map(float, r.embedding)) for r in rows]
    assert given[0] == [0, 0] and all(abs(a - b) < 1e-6 for v in given[1:] for a, b in zip(v, [0.6, 0.8]))
