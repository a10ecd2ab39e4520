"""Okapi BM25 over white-space tokens: statistics, postings, top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.scores import best, by_score, rounded
from ..sources.index_store import TERM_PART, Index, term_part
from ..sources.workspace import materialise
from . import counted as counted_tokens
from .ranking import padded
from .term_blocks import BLOCK_TERMS, blocks_topk, valid_queries

# The customary parameters of the formula.
K1, B, EPSILON = 1.5, 0.75, 0.25

# Rows of (query, term, count) that may be broadcast to the term statistics: about 50 MB in memory.
BROADCAST_ASKED = 500_000


def postings(counted: DataFrame, term_parts: int) -> DataFrame:
    """(doc_id, term, tf, dl) from the counted-token table, without a shuffle."""
    return counted_tokens.postings(counted).withColumn(TERM_PART, term_part(F.col("term"), term_parts))


def term_stats(posting_rows: DataFrame, n_docs: int, term_parts: int) -> DataFrame:
    """Document and corpus frequency per term with the unfloored idf.

    The partial counts of a frequent term are merged per task before the shuffle.
    """
    stats = posting_rows.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    raw = F.ln(F.lit(n_docs) - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)
    return stats.withColumn("raw", raw).withColumn(TERM_PART, term_part(F.col("term"), term_parts))


def query_weights(index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, term, qw): idf times how often the query has the token; unknown terms drop out."""
    floor = EPSILON * index.meta["avg_raw"]
    wanted = (
        queries.select("query_id", F.explode(tx.space_tokens(F.col("query"))).alias("term"))
        .groupBy("query_id", "term")
        .agg(F.count("*").alias("qtf"))
        .withColumn(TERM_PART, term_part(F.col("term"), index.meta["term_parts"]))
    )
    idf = F.when(F.col("raw") >= 0, F.col("raw")).otherwise(F.lit(floor))
    return _with_stats(wanted, index.table("terms")).select(
        "query_id", "term", TERM_PART, (F.col("qtf") * idf).alias("qw")
    )


def _with_stats(wanted: DataFrame, terms: DataFrame) -> DataFrame:
    """Query terms with their statistics.

    Up to a checked size they are broadcast and only their term partitions are read. Beyond it each
    distinct term is looked up once, so the shuffled join has one row per term on both sides.
    """
    wanted = materialise(wanted, "asked-terms")
    key = ["term", TERM_PART]
    if wanted.count() <= BROADCAST_ASKED:
        return terms.join(F.broadcast(wanted.filter("qtf > 0")), key)
    known = materialise(terms.join(wanted.select(*key).distinct(), key), "known-terms")
    return wanted.join(known, key)


def _weighted_postings(index: Index) -> DataFrame:
    saturation = F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(index.meta["avg_length"]))
    weight = F.col("tf") * (K1 + 1) / saturation
    return index.table("postings").select("doc_id", "term", TERM_PART, weight.alias("w"))


def bm25_topk(
    index: Index, queries: DataFrame, depth: int, pad: bool = True, block_terms: int = BLOCK_TERMS
) -> DataFrame:
    """(query_id, doc_id, score, rk): the ``depth`` best documents per query.

    ``pad`` fills lists with unmatched documents in id order; without it only positive scores are listed. Where the floor of
    the idf is negative, matched documents can rank below unmatched ones: then every task ranks all of its documents.
    """
    queries = valid_queries(queries)
    weighted = query_weights(index, queries)
    if index.meta["avg_raw"] >= 0 or not pad:
        scores = blocks_topk(_weighted_postings(index), weighted, depth, block_terms)
        return padded(index, queries, scores, depth) if pad else best(scores, depth, ["query_id"], by_score())
    weighted = materialise(weighted, "weighted")
    scores = blocks_topk(_weighted_postings(index), weighted, depth, block_terms, documents=index.corpus)
    unknown = queries.join(weighted.select("query_id").distinct(), "query_id", "left_anti")
    rest = padded(index, unknown, scores.filter(F.lit(False)), depth)
    return best(scores, depth, ["query_id"], by_score()).unionByName(rest)
