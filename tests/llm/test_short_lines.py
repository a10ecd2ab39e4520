"""Exact copies of short lines, in the operator, the registered query and the pipeline's stage."""

import hashlib

import corpus_pipeline
from shiori.llm import line_dedup, registered

LONG = "this is a line that is long enough for the edit join"
ROWS = [(1, f"Les.\n\n{LONG}\nLes."), (2, f"Les.\nLas.\n\n {LONG}"), (3, "\u00e9\n\u00e9\nx\n\nLas.")]
WANT = {1: f"Les.\n\n{LONG}", 2: "Las.\n", 3: "\u00e9\nx\n"}


def test_copies_of_short_lines_go(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df, min_copy_chars=line_dedup.ALL_COPIES).collect()}
    assert {i: r.text for i, r in got.items()} == WANT
    assert {i: (r.n_lines, r.n_removed) for i, r in got.items()} == {1: (4, 1), 2: (4, 2), 3: (5, 2)}


def test_query_and_stage_drop_them(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text_sha256 for r in registered.op9_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in WANT.items()}
    assert {r.doc_id: r.text for r in corpus_pipeline.drop_lines(spark, df, str(tmp_path)).collect()} == WANT
