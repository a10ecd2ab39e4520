"""Registered queries of the engine over the given tables, each with its SQL check."""

from __future__ import annotations

import importlib.util
import sys
from collections.abc import Callable
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import sql_checks  # noqa: E402
import stand_ins as given  # noqa: E402
from shiori.functions import labels  # noqa: E402
from shiori.functions.scores import rounded  # noqa: E402
from shiori.operators import answers, facets, lookup, trials  # noqa: E402
from shiori.operators.bm25 import EPSILON, bm25_topk  # noqa: E402
from shiori.operators.term_blocks import valid_queries  # noqa: E402
from shiori.operators.rerank import reranked  # noqa: E402
from shiori.operators.tfidf import tfidf_topk  # noqa: E402
from shiori.operators.vectors import dimension_check, embed, hashing_embedder, unit_vectors, vector_topk  # noqa: E402
from shiori.plans.hybrid import candidates, hybrid_search  # noqa: E402
from shiori.plans.index_build import build_index  # noqa: E402
from shiori.sources import catalogue  # noqa: E402
from shiori.sources.index_store import Index, open_index, remove_versions  # noqa: E402
from shiori.sources.workspace import fresh_path, materialise  # noqa: E402
import shiori.functions.text as tx  # noqa: E402

Query = Callable[[SparkSession, str], DataFrame]

SMOKE = "/root/testdata/sf0.001"

_kept: dict[tuple[str, str, str], DataFrame] = {}


def entry(spark: SparkSession) -> DataFrame:
    """The ten best documents per benchmark passage by BM25."""
    return bm25(spark, SMOKE)


def _once(name: str) -> Callable[[Query], Query]:
    """Write an intermediate result at its first use in a session; later queries read it."""

    def wrap(make: Query) -> Query:
        def get(spark: SparkSession, sf_dir: str) -> DataFrame:
            key = (spark.sparkContext.applicationId, sf_dir, name)
            if key not in _kept:
                _kept[key] = materialise(make(spark, sf_dir), name)
            return _kept[key]

        return get

    return wrap


def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_topk(given.index(spark, sf_dir, "documents"), given.passage_queries(spark, sf_dir), 10, pad=False)


def bm25_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every row of every conversation, in one scan of the postings."""
    return bm25_topk(given.index(spark, sf_dir, "documents"), given.conversation_queries(spark, sf_dir), 10, pad=False)


def supplier_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("query_id"), F.col("s_name").alias("query")
    )


def bm25_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_topk(given.index(spark, sf_dir, "parts"), supplier_queries(spark, sf_dir), 80)


def bm25_term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = given.index(spark, sf_dir, "documents")
    floor = EPSILON * index.meta["avg_raw"]
    idf = F.when(F.col("raw") >= 0, F.col("raw")).otherwise(F.lit(floor))
    return index.table("terms").select("term", "df", "cf", rounded(idf).alias("idf"))


def bm25_term_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many terms share each pair of frequencies and its idf."""
    terms = bm25_term_stats(spark, sf_dir)
    return terms.groupBy("df", "cf", "idf").agg(
        F.count("*").alias("n_terms"),
        F.min("term").alias("first_term"),
        F.max("term").alias("last_term"),
        F.sum(F.length("term")).alias("n_chars"),
    )


def tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tfidf_topk(given.index(spark, sf_dir, "documents"), given.passage_queries(spark, sf_dir), 10, pad=False)


def tfidf_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tfidf_topk(given.index(spark, sf_dir, "parts"), supplier_queries(spark, sf_dir), 80)


def tfidf_stop_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left out of the index are left out of the queries too."""
    return tfidf_topk(given.index(spark, sf_dir, "parts-stops"), given.part_queries(spark, sf_dir), 40)


def index_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index built anew in place: what a reader of the first version and one of the second see, before and after removal."""
    path = fresh_path(spark, "index-rebuilt")
    old = build_index(given.bare_part_corpus(spark, sf_dir), path, keyword_only=True)
    new = build_index(given.part_corpus(spark, sf_dir), path, keyword_only=True)
    before = materialise(_facts(old, "old").unionByName(_facts(new, "new")), "versions")
    remove_versions(spark, path)
    return before.unionByName(_facts(open_index(spark, path), "opened"))


def _facts(index: Index, reader: str) -> DataFrame:
    postings = index.table("postings").agg(F.count("*").alias("n_postings"), F.sum("tf").alias("n_tokens"))
    return postings.select(F.lit(reader).alias("reader"), F.lit(index.n_docs).cast("bigint").alias("n_docs"), "n_postings", "n_tokens")


def tfidf_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = given.index(spark, sf_dir, "documents").table("vocab")
    return vocab.select("term", "df", "cf", rounded(F.col("idf")).alias("idf"))


def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = given.index(spark, sf_dir, "documents").table("weights")
    return weights.select("doc_id", "term", rounded(F.col("w")).alias("w"))


def vectors(query_block: int) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        stored = given.table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
        return vector_topk(stored, given.passage_vectors(spark, sf_dir), 20, query_block=query_block, doc_block=10 * query_block)

    return query


def l2_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored vectors stretched by their label, so that label 0 gives zero vectors."""
    stretched = F.transform("embedding", lambda x: (x.cast("double") * F.col("label")).cast("float"))
    stored = given.table(spark, sf_dir, "embeddings").select("vec_id", stretched.alias("embedding"))
    values = unit_vectors(stored).select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    return values.select("vec_id", "pos", rounded(F.col("x").cast("double")).alias("value"))


def vector_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dimension_check(given.table(spark, sf_dir, "embeddings"))


def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = given.index(spark, sf_dir, "documents").corpus
    texts = corpus.select("doc_id", tx.clean(F.col("koumoku_name_full")).alias("text"))
    values = embed(texts, "doc_id", "text", hashing_embedder(64)).select(
        "doc_id", F.posexplode("embedding").alias("pos", "x")
    )
    return values.filter("x <> 0").select("doc_id", "pos", rounded(F.col("x").cast("double")).alias("value"))


def fusion_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = materialise(valid_queries(given.passage_queries(spark, sf_dir)), "queries")
    return candidates(given.index(spark, sf_dir, "documents"), queries, 40)


def rerank_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = given.index(spark, sf_dir, "documents")
    queries = materialise(valid_queries(given.passage_queries(spark, sf_dir)), "queries")
    listed = materialise(bm25_topk(index, queries, 80, pad=False), "bm25-list")
    return reranked(index, listed, queries, 80, 40).select("query_id", "rank", "doc_id", "score", "rerank_score")


def hybrid(top_k: int, weight: float = 0.6, by_words: bool = True) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        index = given.index(spark, sf_dir, "documents")
        results = hybrid_search(index, given.passage_queries(spark, sf_dir), top_k, weight, reranked=by_words)
        return results if by_words else results.drop("rerank_score")

    return query


@_once("parts-results")
def hybrid_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = given.index(spark, sf_dir, "parts")
    return hybrid_search(index, given.part_queries(spark, sf_dir), facets.RESULTS_FOR_PROMPT)


@_once("parts-items")
def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.expand(hybrid_parts(spark, sf_dir), given.index(spark, sf_dir, "parts").corpus)


def facet_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.distribution(hybrid_parts(spark, sf_dir))


def facet_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.summary(items(spark, sf_dir))


def facet_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.details(items(spark, sf_dir))


def facet_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.totals(items(spark, sf_dir))


def prompt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.prompt_text(facet_summary(spark, sf_dir))


@_once("parts-responses")
def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = answers.prompts(given.part_queries(spark, sf_dir), prompt_text(spark, sf_dir))
    return answers.respond(asked, given.first_names_responder)


@_once("parts-answers")
def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.flatten(answers.parse(responses(spark, sf_dir)))


def answers_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.counts(answers.parse(responses(spark, sf_dir)))


@_once("parts-verified")
def answers_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.verified(answered(spark, sf_dir), given.index(spark, sf_dir, "parts").corpus)


def answer_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.cards(answers_verified(spark, sf_dir), given.REPORT, given.REPORT_COLUMN)


def lookup_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown names have no match and the id -1."""
    rows = lookup.find_rows(given.lookup_names(spark, sf_dir), given.part_corpus(spark, sf_dir))
    return rows.withColumn("doc_id", F.coalesce("doc_id", F.lit(-1).cast("bigint")))


def lookup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = given.lookup_names(spark, sf_dir).select(tx.strip(F.col("name")).alias("key")).distinct()
    return lookup.exact(keys, given.part_corpus(spark, sf_dir))


def lookup_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = given.index(spark, sf_dir, "documents")
    return lookup.find_names(given.passage_names(spark, sf_dir), index.corpus, buckets=index.meta["buckets"])


def lookup_fallback_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    pattern = F.concat(F.substring(name, 1, 2), F.lit(".*"), F.substring_index(name, " ", -1))
    keys = given.table(spark, sf_dir, "part").select(pattern.alias("key"))
    return lookup.containing(keys, given.part_corpus(spark, sf_dir), regex=True)


def catalogue_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given.part_corpus(spark, sf_dir).select(
        "doc_id",
        labels.path(F.col("bunya_name"), F.col("chuubunrui_name"), F.col("shoubunrui_name")).alias("path"),
        labels.named(F.col("koumoku_name_full"), F.col("bunya_name")).alias("label"),
        labels.link(given.REPORT, given.REPORT_COLUMN, F.col("koumoku_code")).alias("link"),
    )


def corpus_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue and definitions written as CSV files, then read and joined; saved as parquet and read."""
    path = fresh_path(spark, "csv")
    given.part_catalogue(spark, sf_dir).write.option("header", True).csv(f"{path}/catalogue")
    given.part_definitions(spark, sf_dir).write.option("header", True).csv(f"{path}/definitions")
    rows = catalogue.read_csv(spark, f"{path}/catalogue", catalogue.CATALOGUE_COLUMNS)
    definitions = catalogue.read_csv(spark, f"{path}/definitions", catalogue.DEFINITION_COLUMNS)
    corpus = catalogue.build_corpus(rows.fillna("", ["stat_name"]), definitions)
    return catalogue.save_corpus(corpus, f"{path}/corpus").drop("doc_id")


def corpus_csv_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of a corpus read from many CSV files, some codes of which are defined twice: by file, then place in the file."""
    path = fresh_path(spark, "csv-files")
    parts, suppliers = given.part_catalogue(spark, sf_dir), given.part_definitions(spark, sf_dir)
    again = suppliers.select("koumoku_code", F.concat(F.lit("again "), "definition").alias("definition"))
    parts.repartitionByRange(7, "p_partkey").sortWithinPartitions("p_partkey").write.option("header", True).csv(f"{path}/catalogue")
    for number, definitions in enumerate((suppliers, again)):
        ordered = definitions.coalesce(1).sortWithinPartitions("koumoku_code")
        ordered.write.option("header", True).csv(f"{path}/definitions/{number}")
    rows = catalogue.read_numbered_csv(spark, f"{path}/catalogue", catalogue.CATALOGUE_COLUMNS, multi_line=False)
    definitions = catalogue.read_numbered_csv(spark, f"{path}/definitions/*", catalogue.DEFINITION_COLUMNS, multi_line=False)
    return catalogue.build_corpus(rows, definitions).select("doc_id", "koumoku_code", "definition")


def clean_text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = given.table(spark, sf_dir, "documents").select("text")
    for name, column in (("conversations", "text"), ("pages", "html")):
        texts = texts.unionByName(given.table(spark, sf_dir, name).select(F.col(column).alias("text")))
    return catalogue.text_quality(texts, "text")


def row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.row_counts(
        catalogue=given.part_catalogue(spark, sf_dir), definitions=given.part_definitions(spark, sf_dir)
    )


def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = given.index(spark, sf_dir, "documents").table("meta")
    return meta.select(
        "total_records",
        "embedding_model",
        "vector_dimension",
        "n_vectors",
        "n_tokens",
        rounded(F.col("avg_length")).alias("avg_length"),
        rounded(F.col("avg_raw")).alias("avg_raw"),
        "n_terms",
    )


def json_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = given.table(spark, sf_dir, "pages").select(
        F.lit("pages").alias("source"), F.col("page_id").alias("id"), F.col("html").alias("text")
    )
    events = given.table(spark, sf_dir, "events").select(
        F.lit("events").alias("source"),
        F.col("event_id").alias("id"),
        F.format_string("Answer: %s (%s)", "props", "event_type").alias("text"),
    )
    return pages.unionByName(events).select("source", "id", answers.json_block(F.col("text")).alias("block"))


def trial_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials.per_query(given.event_trials(spark, sf_dir))


def trial_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials.per_model(given.event_trials(spark, sf_dir))


def trial_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials.fastest(trial_models(spark, sf_dir))


def _training_data():
    """The queries over training data, or None where that subpackage is not installed."""
    if importlib.util.find_spec("shiori.llm") is None or importlib.util.find_spec("shiori.llm.registered") is None:
        return None
    from shiori.llm import registered

    return registered


def _pipeline() -> tuple[dict[str, Query], dict[str, str]]:
    """The corpus pipeline and its SQL, where both it and its operators are installed."""
    if _training_data() is None or importlib.util.find_spec("corpus_pipeline") is None:
        return {}, {}
    import corpus_pipeline

    return {"pipeline": corpus_pipeline.run}, {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}


def queries() -> dict[str, Query]:
    extra = _training_data()
    return search_queries() | (extra.queries() if extra else {}) | _pipeline()[0]


def search_queries() -> dict[str, Query]:
    return {
        "bm25_topk": bm25,
        "bm25_topk_padded": bm25_padded,
        "bm25_conversations": bm25_conversations,
        "bm25_term_stats": bm25_term_stats,
        "bm25_term_spectrum": bm25_term_spectrum,
        "tfidf_topk": tfidf,
        "tfidf_topk_padded": tfidf_padded,
        "tfidf_stop_words": tfidf_stop_words,
        "tfidf_vocabulary": tfidf_vocabulary,
        "tfidf_weights": tfidf_weights,
        "vector_topk": vectors(4_096),
        "vector_topk_blocks": vectors(16),
        "l2_normalise": l2_normalise,
        "vector_dimension": vector_dimension,
        "hash_embed": hash_embed,
        "fusion_only": fusion_only,
        "rerank": rerank_only,
        "hybrid_search": hybrid(40),
        "hybrid_search_keywords": hybrid(50, 0.0),
        "hybrid_search_vectors": hybrid(50, 1.0),
        "hybrid_search_fused_order": hybrid(20, by_words=False),
        "hybrid_search_parts": hybrid_parts,
        "facet_distribution": facet_distribution,
        "facet_expand": items,
        "facet_summary": facet_summary,
        "facet_details": facet_details,
        "facet_totals": facet_totals,
        "prompt_text": prompt_text,
        "answers_flatten": answered,
        "answers_count": answers_count,
        "answers_verified": answers_verified,
        "answer_cards": answer_cards,
        "lookup_names": lookup_names,
        "lookup_exact": lookup_exact,
        "lookup_fallback": lookup_fallback,
        "lookup_fallback_regex": lookup_fallback_regex,
        "catalogue_labels": catalogue_labels,
        "corpus_build": given.document_corpus,
        "corpus_from_csv": corpus_from_csv,
        "corpus_csv_numbers": corpus_csv_numbers,
        "clean_text_stats": clean_text_stats,
        "row_counts": row_counts,
        "index_stats": index_stats,
        "index_rebuild": index_rebuild,
        "json_block": json_block,
        "trial_stats": trial_stats,
        "trial_models": trial_models,
        "trial_winner": trial_winner,
    }


def oracle_sql() -> dict[str, str]:
    extra = _training_data()
    return sql_checks.all_checks() | (extra.oracle_sql() if extra else {}) | _pipeline()[1]
