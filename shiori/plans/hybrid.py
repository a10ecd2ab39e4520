"""Hybrid search: three retrievers, fusion, reranking, result rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.bm25 import bm25_topk
from ..operators.fusion import fuse
from ..operators.term_blocks import valid_queries
from ..operators.rerank import MAX_RESULTS, with_documents
from ..operators.rerank import reranked as rerank_lists
from ..operators.tfidf import tfidf_topk
from ..operators.vectors import Embedder, dimension_check, embed, hashing_embedder, query_units, vector_topk
from ..sources.index_store import Index
from ..sources.workspace import materialise, together

# The five text columns of a result.
RESULT_COLUMNS = ["koumoku_name", "koumoku_name_full", "bunya_name", "chuubunrui_name", "shoubunrui_name"]


def query_vectors(queries: DataFrame, embedder: Embedder) -> DataFrame:
    cleaned = queries.select("query_id", tx.clean(F.col("query")).alias("text"))
    return embed(cleaned, "query_id", "text", embedder)


def vectors_agree(index: Index, embedder: Embedder, vectors: DataFrame | None = None, model: str | None = None) -> None:
    """Fails before any search if query vectors cannot be held against those of the index.

    The dimension is that of ``vectors`` (query_id, embedding) if given, else of what ``embedder`` makes. ``model`` names
    the model that the query vectors come from.
    """
    stored, name = index.meta["vector_dimension"], index.meta["embedding_model"]
    if model is not None and model != name:
        raise ValueError(f"query vectors of {model}; the index was made with {name}")
    if vectors is None:
        given = np.asarray(embedder(["a"])).shape[-1]
    else:
        facts = dimension_check(vectors).first()
        if not facts["n_vectors"]:
            return
        if not facts["uniform"]:
            raise ValueError("query vectors of different dimensions")
        given = facts["dimension"]
    if stored and stored != given:
        raise ValueError(f"query vectors of {given} dimensions; the index of {name} has {stored}")


def candidates(
    index: Index,
    queries: DataFrame,
    top_k: int,
    vector_weight: float = 0.6,
    vectors: DataFrame | None = None,
    embedder: Embedder = hashing_embedder(64),
) -> DataFrame:
    """(query_id, doc_id, score, rk): the fused list, twice as deep as the result.

    ``vectors`` (query_id, embedding) takes the place of embedding the queries. Query vectors of any length are asked
    at unit length, as the documents are stored.
    """
    depth = 2 * top_k
    asked = query_units(vectors if vectors is not None else query_vectors(queries, embedder))
    lists = together(
        lambda: vector_topk(index.table("vectors"), asked, depth),
        lambda: bm25_topk(index, queries, depth),
        lambda: tfidf_topk(index, queries, depth),
    )
    return fuse(*lists, depth, vector_weight)


def hybrid_search(
    index: Index,
    queries: DataFrame,
    top_k: int = 50,
    vector_weight: float = 0.6,
    vectors: DataFrame | None = None,
    embedder: Embedder = hashing_embedder(64),
    reranked: bool = True,
    max_results: int = MAX_RESULTS,
    model: str | None = None,
) -> DataFrame:
    """(query_id, rank, doc_id, five text columns, score, rerank_score) for every query at once.

    ``score`` is the fused score. ``reranked=False`` keeps the fused order. Either way a list has at most ``max_results``
    rows. With ``model``, the model of the query vectors must be the one that the index was made with.
    """
    vectors_agree(index, embedder, vectors, model)
    length = min(top_k, max_results)
    queries = materialise(valid_queries(queries), "queries")
    fused = materialise(candidates(index, queries, top_k, vector_weight, vectors, embedder), "candidates")
    if reranked:
        # Texts are read beside their buckets to be scored, and again for the rows that stay.
        kept = materialise(rerank_lists(index, fused, queries, 2 * top_k, length), "reranked")
        results = with_documents(index, kept.drop("rk").withColumn("rk", F.col("rank")), length, RESULT_COLUMNS)
    else:
        results = with_documents(index, fused, length, RESULT_COLUMNS).withColumn("rank", F.col("rk"))
        results = results.withColumn("rerank_score", F.lit(None).cast("int"))
    return results.select("query_id", "rank", "doc_id", *RESULT_COLUMNS, "score", "rerank_score")
