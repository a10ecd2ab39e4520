import pytest

from shiori.sources import catalogue

COLUMNS = "koumoku_code string, koumoku_name_full string, bunya_name string, chuubunrui_name string, shoubunrui_name string, stat_name string"


def test_left_join_keeps_and_multiplies(spark):
    rows = spark.createDataFrame(
        [("1", "n1", "f", None, "s", "t"), ("2", "n2", "f", "m", "s", "t"), ("3", "n3", "f", "m", "s", "t")], COLUMNS
    ).coalesce(1)
    defs = spark.createDataFrame([("2", "first"), ("2", "second"), ("9", "unused")], "koumoku_code string, definition string").coalesce(1)
    got = catalogue.build_corpus(rows, defs).orderBy("doc_id").collect()
    assert [(r["koumoku_code"], r["definition"]) for r in got] == [("1", ""), ("2", "first"), ("2", "second"), ("3", "")]
    assert len({r["doc_id"] for r in got}) == 4
    assert got[0]["search_text"] == "n1 f  s  t"
    assert got[0]["koumoku_name"] == "n1"


def test_csv(spark, tmp_path):
    (tmp_path / "m.csv").write_text(
        'extra,koumoku_code,koumoku_name,koumoku_name_full,bunya_name,chuubunrui_name,shoubunrui_name,stat_name\n'
        'x,A1,short,"total, ""all""",人口,NA,,census\n'
        "y,A2,other,完全　名,人口,世帯,一般,census\n",
        encoding="utf-8",
    )
    rows = catalogue.read_csv(spark, str(tmp_path / "m.csv"), catalogue.CATALOGUE_COLUMNS, null_values=["NA"])
    assert rows.columns == catalogue.CATALOGUE_COLUMNS
    first, second = rows.collect()
    assert first["koumoku_name_full"] == 'total, "all"'
    assert first["chuubunrui_name"] is None and first["shoubunrui_name"] is None
    assert second["koumoku_name_full"] == "完全　名"
    assert catalogue.row_counts(a=rows, b=rows.limit(1)).collect() == [("a", 2), ("b", 1)]


def test_missing_column_fails(spark):
    df = spark.createDataFrame([("1",)], "koumoku_code string")
    with pytest.raises(ValueError, match="definition"):
        catalogue.take_columns(df, catalogue.DEFINITION_COLUMNS)
    kept = catalogue.take_columns(df, catalogue.DEFINITION_COLUMNS, optional=["definition"])
    assert kept.columns == ["koumoku_code"]


def test_corpus_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("1", "n1", "f", "m", "s", "t")], COLUMNS)
    defs = spark.createDataFrame([("1", "d")], "koumoku_code string, definition string")
    corpus = catalogue.build_corpus(rows, defs)
    assert catalogue.save_corpus(corpus, str(tmp_path / "c")).collect() == corpus.collect()


def test_text_quality(spark):
    df = spark.createDataFrame([(None,), ("",), ("　 ",), (" ab ",), ("統計指標",)], "t string")
    assert list(catalogue.text_quality(df, "t").first()) == [5, 1, 3, 4, 4 * 4 + 2]
