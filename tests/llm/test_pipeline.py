"""The corpus pipeline, stage by stage and whole."""

import __spark_entry__ as registered
import corpus_pipeline
from shiori.llm import decontaminate

TABLES = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, TABLES)
        assert kept.columns == docs.columns, name
        kept = spark.createDataFrame(kept.collect(), docs.schema)
    ids = {r.doc_id for r in kept.collect()}
    items = spark.read.parquet(f"{TABLES}/benchmark.parquet")
    assert all(not r.item_ids for r in decontaminate.decontaminated(kept, items).collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, TABLES)
    assert {r.doc_id for r in packed.collect()} == ids
    assert 0.8 * docs.count() <= len(ids) <= docs.count()


def test_odd_documents_pass(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "the and of " * 30, "en", "s", 330), (3, "the and of " * 30, "en", "s", 330), (None, "to be or not", None, None, 1)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, TABLES).collect()


def test_registered():
    names = set(registered.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
