"""Languages of texts without spaces, and of many languages."""

import random

from pyspark.sql import functions as F

from shiori.llm import language

SCHEMA = "doc_id long, text string, lang string"


def run(letters, n, seed):
    return "".join(random.Random(seed).choices(letters, k=n))


def test_a_run_is_read_to_its_end(spark):
    rows = [(i, run("uvwxyz" if i % 2 else "abcdef", 600, i), "yy" if i % 2 else "xx") for i in range(60)]
    model = language.train(spark.createDataFrame(rows, SCHEMA), F.lit(True))
    mixed = [(1, run("abcdef", 40, "a") + run("uvwxyz", 400, "b") + "abc"), (2, run("uvwxyz", 40, "c") + run("abcdef", 400, "d") + "xyz")]
    got = language.labelled(spark.createDataFrame(mixed, "doc_id long, text string"), model).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {1: "yy", 2: "xx"}


def test_every_labelled_language_is_learned(spark):
    names = [chr(97 + n // 10) + chr(107 + n % 10) for n in range(70)]
    rows = [(6 * n + i, f"{name * 3} {name * 2} " * 20, name) for n, name in enumerate(names) for i in range(6)]
    documents = spark.createDataFrame(rows, SCHEMA)
    model = language.train(documents, F.lit(True))
    assert model.languages == sorted(names)
    assert all(r.lang_pred == r.lang for r in language.labelled(documents, model).collect())
