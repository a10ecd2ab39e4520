"""Lexical reranking of candidates by their catalogue fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.scores import best
from ..sources.catalogue import SEARCH_FIELDS
from ..sources.index_store import DOC_PART, Index, doc_part

# What a field holding the whole query adds, and the longest result list unless asked otherwise.
WHOLE_QUERY = 2
MAX_RESULTS = 80

# Candidate rows (ids and scores only) one broadcast may hold: about 30 MB in memory.
BROADCAST_CANDIDATES = 500_000


def prepared(queries: DataFrame) -> DataFrame:
    """Queries with their lower-cased text and its distinct words, worked out once per query."""
    lowered = queries.select("query_id", F.lower("query").alias("asked"))
    return lowered.withColumn("asked_words", F.array_distinct(tx.space_tokens(F.col("asked"))))


def lexical_score(fields: Sequence[Column]) -> Column:
    """Per field: 2 if it holds the whole query, plus the number of distinct words they share.

    Case is ignored; a null field adds nothing.
    """

    def one(field: Column) -> Column:
        held = F.lower(field)
        whole = F.when(F.contains(held, F.col("asked")), WHOLE_QUERY).otherwise(0)
        shared = F.size(F.array_intersect(F.col("asked_words"), tx.space_tokens(held)))
        return F.when(field.isNull(), 0).otherwise(whole + shared)

    total = F.lit(0)
    for field in fields:
        total = total + one(field)
    return total


def with_documents(
    index: Index, candidates: DataFrame, depth: int, columns: Sequence[str], broadcast_rows: int = BROADCAST_CANDIDATES
) -> DataFrame:
    """Candidates joined with corpus columns.

    Up to ``broadcast_rows`` candidates are broadcast and the corpus is scanned in place, reading only
    the partitions some candidate falls into. More are shuffled to the corpus buckets, which stay put.
    """
    kept = candidates.filter(F.col("rk") <= depth)
    if candidates.count() <= broadcast_rows:
        kept = F.broadcast(kept.withColumn(DOC_PART, doc_part(F.col("doc_id"), index.meta["buckets"])))
        rows = index.corpus.select("doc_id", DOC_PART, *columns)
        return rows.join(kept, ["doc_id", DOC_PART]).drop(DOC_PART)
    return index.corpus.select("doc_id", *columns).join(kept.hint("shuffle_hash"), "doc_id")


def _word_ids(text: Column) -> Column:
    """64-bit ids of the distinct words of a text."""
    return F.array_distinct(F.transform(tx.space_tokens(text), lambda w: F.xxhash64(w)))


def scored(
    index: Index, candidates: DataFrame, queries: DataFrame, depth: int, fields: Sequence[str] = SEARCH_FIELDS, broadcast_rows: int = BROADCAST_CANDIDATES
) -> DataFrame:
    """(query_id, doc_id, score, rk, rerank_score) of the candidates (query_id, doc_id, score, rk), no text among them.

    Each document that is a candidate at all is lowered and cut into word ids once per field, beside its bucket, however many
    queries ask for it; ids of query words are intersected with them there. What is ranked afterwards are numbers.
    """
    lowered = queries.select("query_id", F.lower("query").alias("asked"))
    asked = lowered.withColumn("asked_ids", _word_ids(F.col("asked")))
    kept = candidates.filter(F.col("rk") <= depth).select("query_id", "doc_id", "score", "rk")
    rows = kept.count()
    few = rows <= broadcast_rows
    kept = kept.join(asked, "query_id")
    numbered = list(enumerate(fields))
    texts = [F.lower(f).alias(f"_text{k}") for k, f in numbered]
    corpus = index.corpus
    if few:
        wanted = candidates.filter(F.col("rk") <= depth).select("doc_id").distinct()
        wanted = wanted.withColumn(DOC_PART, doc_part(F.col("doc_id"), index.meta["buckets"]))
        corpus = corpus.join(F.broadcast(wanted), ["doc_id", DOC_PART], "left_semi")
    documents = corpus.select("doc_id", *texts)
    documents = documents.select("*", *[_word_ids(F.col(f"_text{k}")).alias(f"_ids{k}") for k, _ in numbered])
    both = documents.join(F.broadcast(kept) if few else kept.hint("shuffle_hash"), "doc_id")
    total = F.lit(0)
    for k, _ in numbered:
        text = F.col(f"_text{k}")
        whole = F.when(F.contains(text, F.col("asked")), WHOLE_QUERY).otherwise(0)
        total = total + F.when(text.isNull(), 0).otherwise(whole + F.size(F.array_intersect(F.col("asked_ids"), F.col(f"_ids{k}"))))
    return both.select("query_id", "doc_id", "score", "rk", total.alias("rerank_score"))


def reranked(index: Index, candidates: DataFrame, queries: DataFrame, depth: int, k: int, fields: Sequence[str] = SEARCH_FIELDS) -> DataFrame:
    """(query_id, rank, doc_id, score, rk, rerank_score): the ``k`` best of ``depth`` candidates, without texts."""
    return best(scored(index, candidates, queries, depth, fields), k, ["query_id"], [F.desc("rerank_score"), F.asc("rk")], rank="rank")


def rerank(candidates: DataFrame, k: int, fields: Sequence[str] = SEARCH_FIELDS) -> DataFrame:
    """Candidates (query_id, asked, asked_words, doc_id, rk, fields) by lexical score, then as they were."""
    marked = candidates.withColumn("rerank_score", lexical_score([F.col(f) for f in fields]))
    kept = marked.drop("asked", "asked_words")
    return best(kept, k, ["query_id"], [F.desc("rerank_score"), F.asc("rk")], rank="rank")
