"""Build every index table of a corpus once."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..operators import bm25, counted, tfidf
from ..operators.vectors import Embedder, hashing_embedder, unit_vectors
from ..sources import index_store as store
from ..sources.catalogue import search_text
from ..sources.workspace import together

# What a bucket holds at most, on average: its rows are sorted in memory where they are written.
DOCS_PER_BUCKET, CHARACTERS_PER_BUCKET = 100_000, 64_000_000
DOCS_PER_TERM_PART = 10_000
MIN_DOCS_PER_TASK = 200
MAX_BUCKETS = 100_000  # Spark's own limit


def _layout(n_docs: int, cores: int, n_characters: int = 0) -> tuple[int, int]:
    """Buckets and term partitions for a corpus of so many documents and characters.

    A small corpus gets one bucket per core; a large one gets buckets of bounded size, each cut into
    term partitions that still fill a file of some megabytes.
    """
    small = min(cores, math.ceil(n_docs / MIN_DOCS_PER_TASK))
    buckets = min(MAX_BUCKETS, max(1, small, math.ceil(n_docs / DOCS_PER_BUCKET), math.ceil(n_characters / CHARACTERS_PER_BUCKET)))
    return buckets, max(1, min(32, n_docs // buckets // DOCS_PER_TERM_PART))


def document_tokens(corpus: DataFrame, stop_words: Sequence[str] = (), embedder: Embedder | None = None) -> DataFrame:
    """The counted-token table of a corpus with its search text."""
    return counted.counted_tokens(corpus, stop_words, embedder)


def build_index(
    corpus: DataFrame,
    path: str,
    *,
    vectors: DataFrame | None = None,
    embedder: Embedder = hashing_embedder(64),
    model: str = "hashing-64",
    vocabulary: int = 10_000,
    stop_words: Sequence[str] = (),
    buckets: int | None = None,
    term_parts: int | None = None,
    keyword_only: bool = False,
) -> store.Index:
    """Save corpus, BM25, TF-IDF and vector tables as a new version under ``path``, publish it and open it.

    ``corpus`` has a unique ``doc_id`` and the catalogue columns. ``vectors`` (doc_id, embedding) takes
    the place of running ``embedder`` over the search texts. The texts are read once: everything else is made from the
    counted-token table. ``keyword_only`` leaves out TF-IDF and vectors.
    """
    spark = corpus.sparkSession
    path = path.rstrip("/")
    number, version = store.new_version(spark, path)
    folder = f"{path}/{version}"

    if buckets is None or term_parts is None:
        size = corpus.agg(F.count("*").alias("docs"), F.sum(F.length(search_text())).alias("characters")).first()
        computed = _layout(size["docs"], spark.sparkContext.defaultParallelism, size["characters"] or 0)
        buckets, term_parts = buckets or computed[0], term_parts or computed[1]

    # The one shuffle of the texts. The ids are fixed from here on: everything below reads the saved
    # corpus. The search text repeats its fields, so it is put together when needed and not stored.
    placed = corpus.withColumn(store.DOC_PART, store.doc_part(F.col("doc_id"), buckets))
    store.save_table(placed.hint("rebalance", store.DOC_PART), folder, "corpus", buckets)
    saved = spark.table(store.table_name(folder, "corpus")).withColumn("search_text", search_text())

    embedding = vectors is None and not keyword_only
    tokens = document_tokens(saved, stop_words, embedder if embedding else None)
    if not embedding:
        tokens = tokens.withColumn("embedding", F.lit(None).cast("array<float>"))
    store.save_table(tokens, folder, "counted", buckets)
    tokens = spark.table(store.table_name(folder, "counted"))
    n_docs = tokens.count()
    head = [r[0] for r in tokens.select("doc_id").orderBy("doc_id").limit(store.HEAD_ROWS).collect()]

    def stored(name: str) -> DataFrame:
        return spark.read.schema(store.LAYOUT[name][0]).parquet(f"{folder}/{name}")

    def keyword_tables() -> Row:
        store.save_table(bm25.postings(tokens, term_parts), folder, "postings", buckets)
        postings = spark.table(store.table_name(folder, "postings"))
        store.save_table(bm25.term_stats(postings, n_docs, term_parts), folder, "terms")
        return stored("terms").agg(
            F.avg("raw").alias("avg_raw"), F.count("*").alias("n_terms"), F.sum("cf").alias("n_tokens")
        ).first()

    def tfidf_tables() -> None:
        kept = tokens.limit(0) if keyword_only else tokens
        store.save_table(tfidf.vocabulary(kept, n_docs, vocabulary), folder, "vocab")
        store.save_table(tfidf.weights(kept, stored("vocab"), term_parts), folder, "weights", buckets)

    def vector_table() -> Row:
        given = vectors if vectors is not None else tokens.select("doc_id", "embedding")
        store.save_table(unit_vectors(given.filter("embedding is not null")), folder, "vectors")
        size = F.size("embedding")
        return stored("vectors").agg(F.count("*").alias("n"), F.min(size).alias("low"), F.max(size).alias("high")).first()

    term_facts, _, vector_facts = together(keyword_tables, tfidf_tables, vector_table)
    if vector_facts["low"] != vector_facts["high"]:
        raise ValueError(f"vectors of different dimensions: {vector_facts['low']} to {vector_facts['high']}")
    n_tokens = term_facts["n_tokens"] or 0
    meta = spark.range(1).select(
        F.current_timestamp().alias("created_at"),
        F.lit(n_docs).alias("total_records"),
        F.lit(model).alias("embedding_model"),
        F.lit(vector_facts["high"] or 0).alias("vector_dimension"),
        F.lit(vector_facts["n"]).alias("n_vectors"),
        F.lit(n_tokens).alias("n_tokens"),
        F.lit(n_tokens / n_docs if n_docs else 0.0).alias("avg_length"),
        F.lit(float(term_facts["avg_raw"] or 0.0)).alias("avg_raw"),
        F.lit(term_facts["n_terms"]).alias("n_terms"),
        F.lit(buckets).alias("buckets"),
        F.lit(term_parts).alias("term_parts"),
        F.array(*[F.lit(i) for i in head]).alias("head"),
        F.array(*[F.lit(w) for w in stop_words]).cast("array<string>").alias("stop_words"),
    )
    store.save_table(meta.coalesce(1), folder, "meta")
    store.publish(spark, path, number, version)
    return store.open_index(spark, path, version)
