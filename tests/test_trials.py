import pytest
from pyspark.sql import functions as F

from shiori.operators import trials

ROWS = [
    ("q1", "a", 2.0, 10),
    ("q1", "a", None, 0),
    ("q1", "a", 4.0, 20),
    ("q1", "b", 9.0, 6),
    ("q2", "a", 1.0, 5),
    ("q2", "b", None, 0),
    ("q3", "a", None, 0),
    ("q3", "b", 3.0, None),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "query string, model string, seconds double, n_indicators int")


def test_per_query(spark):
    got = {(r["query"], r["model"]): tuple(r)[2:] for r in trials.per_query(frame(spark)).collect()}
    assert got[("q1", "a")] == (3.0, 10.0, pytest.approx(66.666667))
    assert got[("q2", "b")] == (None, 0.0, 0.0)
    assert got[("q3", "b")] == (3.0, 0.0, 100.0)


def test_per_model_means_of_means(spark):
    got = {r["model"]: tuple(r)[1:] for r in trials.per_model(frame(spark)).collect()}
    assert got == {"a": (2.0, 7.5, pytest.approx(66.666667)), "b": (6.0, 3.0, pytest.approx(66.666667))}


def test_fastest(spark):
    assert tuple(trials.fastest(trials.per_model(frame(spark))).first()) == ("a", 2.0, pytest.approx(66.666667))
    assert trials.fastest(trials.per_model(frame(spark).filter("model = 'a'"))).count() == 0
    tie = spark.createDataFrame([("b", 1.0), ("a", 1.0)], "model string, avg_seconds double")
    assert tuple(trials.fastest(tie).first()) == ("a", 1.0, 0.0)


def test_trial_columns(spark):
    df = spark.createDataFrame([(True, 2.0, 5), (False, 3.0, 7)], "ok boolean, s double, n int")
    got = df.select(trials.trial(F.col("ok"), F.col("s"), F.col("n"))).collect()
    assert [tuple(r) for r in got] == [(2.0, 5), (None, 0)]
