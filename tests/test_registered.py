"""Every registered query against its SQL in DuckDB, over the whole smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as registered
import sql_checks

TABLES = Path("/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in TABLES.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    tidy = (tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows)
    return sorted(repr(tuple(r[i] for i in order)) for r in tidy)


def test_every_query_has_sql():
    assert set(registered.search_queries()) == set(sql_checks.all_checks())
    assert set(sql_checks.all_checks()) <= set(registered.oracle_sql()) <= set(registered.queries())


def test_entry_is_the_flagship(spark):
    assert registered.entry(spark).columns == ["query_id", "doc_id", "score", "rk"]


@pytest.mark.parametrize("name", list(registered.search_queries()))
def test_same_rows(spark, duck, name):
    df = registered.search_queries()[name](spark, str(TABLES))
    relation = duck.sql(registered.oracle_sql()[name])
    assert sorted(df.columns) == sorted(relation.columns)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    want = rows_of(relation.columns, relation.fetchall())
    assert len(got) > 0 and got == want


def test_questions_in_one_call(spark):
    """The composed flow gives what its registered steps give."""
    import stand_ins as given
    from shiori.plans.questions import ask

    answered = ask(
        given.index(spark, str(TABLES), "parts"),
        given.part_queries(spark, str(TABLES)),
        given.first_names_responder,
        base_link=given.REPORT,
        link_column=given.REPORT_COLUMN,
    )
    steps = registered.queries()["answer_cards"](spark, str(TABLES))
    assert sorted(answered.cards.collect()) == sorted(steps.collect())
