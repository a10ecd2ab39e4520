"""TF-IDF over word 1- and 2-grams with a capped vocabulary: vocabulary, unit rows, cosine top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import text as tx
from ..functions.scores import best, by_score
from ..sources.index_store import TERM_PART, Index, term_part
from ..sources.workspace import materialise
from . import counted as counts
from .ranking import padded
from .term_blocks import BLOCK_TERMS, blocks_topk, valid_queries
from .top_counts import count_floor, top_by_count


def vocabulary(counted: DataFrame, n_docs: int, size: int) -> DataFrame:
    """The ``size`` most frequent terms by corpus count (ties by term) with their smooth idf.

    A pair is never more frequent than either of its words. So once the words alone fill the
    vocabulary, pairs holding a word below the last kept count cannot enter it, and are not counted.
    """
    words = materialise(counts.word_counts(counted), "words")
    floor, _ = count_floor(words, "cf", size)
    frequent = materialise(words.filter(F.col("cf") >= floor).select("term"), "frequent-words") if floor > 1 else None
    terms = words.filter(F.col("cf") >= floor).unionByName(counts.pair_counts(counted, floor, frequent))
    kept = top_by_count(materialise(terms, "term-counts"), "cf", "term", size)
    idf = F.ln((1.0 + F.lit(n_docs)) / (1.0 + F.col("df"))) + 1.0
    return kept.select("term", "df", "cf", idf.alias("idf"))


def _unit_rows(counted: DataFrame, key: str) -> DataFrame:
    """tf * idf divided by the L2 norm of its row."""
    raw = counted.withColumn("raw", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("raw") / norm).alias("w"))


def _in_vocabulary(grams: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    # The vocabulary has a fixed cap, so it is small whatever the corpus.
    terms = F.broadcast(vocab.select("term", "idf"))
    return grams.join(terms, "term").groupBy(key, "term", "idf").agg(F.count("*").alias("tf"))


def weights(counted: DataFrame, vocab: DataFrame, term_parts: int) -> DataFrame:
    """(doc_id, term, w): unit-length rows, made document by document from the counted-token table."""
    return counts.unit_rows(counted, vocab).withColumn(TERM_PART, term_part(F.col("term"), term_parts))


def query_weights(index: Index, queries: DataFrame) -> DataFrame:
    words = materialise(queries.select("query_id", tx.word_tokens(F.col("query"), index.meta["stop_words"] or ()).alias("words")), "query-words")
    grams = words.select("query_id", F.explode(tx.ngrams(F.col("words"))).alias("term"))
    rows = _unit_rows(_in_vocabulary(grams, index.table("vocab"), "query_id"), "query_id")
    part = term_part(F.col("term"), index.meta["term_parts"])
    return rows.select("query_id", "term", F.col("w").alias("qw"), part.alias(TERM_PART))


def tfidf_topk(
    index: Index, queries: DataFrame, depth: int, pad: bool = True, block_terms: int = BLOCK_TERMS
) -> DataFrame:
    """(query_id, doc_id, score, rk): the ``depth`` documents of highest cosine similarity per query."""
    queries = valid_queries(queries)
    scores = blocks_topk(index.table("weights"), query_weights(index, queries), depth, block_terms)
    if pad:
        return padded(index, queries, scores, depth)
    return best(scores, depth, ["query_id"], by_score())
