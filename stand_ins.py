"""The given tables seen as catalogues, queries, answers and trials."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiori.operators.trials import trial
from shiori.plans.index_build import build_index
from shiori.sources.catalogue import build_corpus
from shiori.sources.index_store import Index
from shiori.sources.workspace import fresh_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values, used by the SQL checks as well.
REPORT = "https://reports.example/open?mode=view"
REPORT_COLUMN = "catalogue/code"

STOP_WORDS = ["brand", "steel", "copper", "small"]

_indexes: dict[tuple[str, str, str], Index] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("doc_id").cast("string").alias("koumoku_code"),
        F.col("text").alias("koumoku_name_full"),
        F.col("lang").alias("bunya_name"),
        F.col("source").alias("chuubunrui_name"),
        F.lit("").alias("shoubunrui_name"),
        F.lit("").alias("stat_name"),
    )


def label_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("koumoku_code"),
        F.format_string("quality %d toxic %d", "quality", "toxic").alias("definition"),
    )


def part_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.col("p_partkey").cast("string").alias("koumoku_code"),
        F.col("p_name").alias("koumoku_name"),
        F.col("p_name").alias("koumoku_name_full"),
        F.col("p_brand").alias("bunya_name"),
        F.col("p_type").alias("chuubunrui_name"),
        F.col("p_size").cast("string").alias("shoubunrui_name"),
        F.lit("").alias("stat_name"),
    )


def part_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with a part's number describe it; the other parts have no definition."""
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("string").alias("koumoku_code"), F.col("s_name").alias("definition")
    )


def document_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_corpus(document_catalogue(spark, sf_dir), label_definitions(spark, sf_dir), "doc_id")


def bare_part_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts before anyone has described them."""
    return build_corpus(part_catalogue(spark, sf_dir), part_definitions(spark, sf_dir).limit(0), "p_partkey")


def part_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_corpus(part_catalogue(spark, sf_dir), part_definitions(spark, sf_dir), "p_partkey")


def index(spark: SparkSession, sf_dir: str, kind: str) -> Index:
    """The saved index of a corpus: built at first use, then read by every query of the session."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _indexes:
        corpus = {"documents": document_corpus, "parts": part_corpus, "parts-stops": part_corpus}[kind](spark, sf_dir)
        stop_words = STOP_WORDS if kind == "parts-stops" else ()
        _indexes[key] = build_index(corpus, fresh_path(spark, f"index-{kind}"), stop_words=stop_words)
    return _indexes[key]


def passage_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def conversation_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of every conversation as a query."""
    number = F.col("conv_id") * 1_000_000 + F.col("turn")
    return table(spark, sf_dir, "conversations").select(number.alias("query_id"), F.col("text").alias("query"))


def part_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct part name with its type and brand, numbered by the first part that has them."""
    named = table(spark, sf_dir, "part").groupBy("p_name", "p_type", "p_brand").agg(F.min("p_partkey").alias("query_id"))
    return named.select("query_id", F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("query"))


def passage_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored vector that goes with each benchmark item."""
    return (
        table(spark, sf_dir, "benchmark")
        .select(F.col("item_id").alias("query_id"))
        .join(table(spark, sf_dir, "embeddings"), F.col("query_id") == F.col("vec_id"))
        .select("query_id", "embedding")
    )


def lookup_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names to find among the parts: exact with blanks around, parts of names in capitals, unknown ones."""
    name = F.col("p_name")
    whole = F.concat(F.lit("　"), name, F.lit(" "))
    half = F.upper(F.substring_index(name, " ", -1))
    return table(spark, sf_dir, "part").select(F.explode(F.array(whole, half, F.concat(name, F.lit("?")))).alias("name"))


def passage_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("text").alias("name"))


def event_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as timing trials: errors are the failed ones."""
    events = table(spark, sf_dir, "events")
    valid = F.col("event_type") != "error"
    return events.select(
        F.col("event_type").alias("query"),
        F.concat(F.lit("model-"), F.pmod("user_id", F.lit(3))).alias("model"),
        *trial(valid, F.col("value"), F.from_json("props", "k INT")["k"]),
    )


def first_names_responder(systems: list[str], users: list[str]) -> list[str]:
    """Stands in for a model: recommends the first names of each field listed in the prompt.

    The first as listed, the second in capitals within blanks, the third misspelt; some keys are left out.
    """
    import json
    import re

    replies = []
    for system in systems:
        perspectives = []
        for field, names in re.findall(r"^【(.*?)】\(\d+件利用可能\): (.*)$", system, re.MULTILINE):
            listed = names.split(", ")
            chosen = [{"indicator_name": listed[0], "recommendation_reason": f"first of {field}"}]
            if len(listed) > 1:
                chosen.append({"indicator_name": f" {listed[1].upper()}　"})
            if len(listed) > 2:
                chosen.append({"indicator_name": listed[2] + "?", "recommendation_reason": "unknown"})
            perspectives.append({"perspective_title": field, "recommended_indicators": chosen})
        perspectives.append({"recommended_indicators": [{"indicator_name": "no such name"}]})
        body = json.dumps({"analysis_perspectives": perspectives}, ensure_ascii=False, indent=1)
        replies.append(f"Here you are:\n```json\n{body}\n```\nDone.")
    return replies
