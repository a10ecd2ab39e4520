"""From raw documents to packed training sequences; each stage is written and read again before the next.

A document goes if its language cannot be told, if a document with a smaller id stands for it, or if it holds a test
item. Lines that came earlier go from the texts, and texts of which nothing is left by that. ``n_chars`` follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiori.llm import decontaminate, language, line_dedup, ngram_join, packing
from shiori.sources.workspace import materialise

# Mean share of the best language below which a text has none.
LEAST_SCORE = 0.4

# The stages have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def tell_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.train(docs, F.lit(True))
    found = language.labelled(docs, model)
    return found.filter((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(docs, min_copy_chars=line_dedup.ALL_COPIES)
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"\S")
    found = found.filter(F.col("text").isNull() | ~emptied).select(docs.columns)
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else found


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs).select(docs.columns)


def drop_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminated(docs, items).filter(F.size("item_ids") == 0).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", tell_language),
    ("line_dedup", drop_lines),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_test_items),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
