import random
import re

from pyspark.sql import functions as F

from shiori.functions import labels
from shiori.functions import text as tx

SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0     　"


def samples():
    rng = random.Random(7)
    alphabet = SPACES + "aZ9_é統計,.-'😀"
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(25))) for _ in range(400)]
    return made + ["", " ", "　", "a　b", "　前後　", "x", None]


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")


def test_space_tokens_and_strip_follow_python(spark):
    rows = frame(spark, samples()).select("t", tx.space_tokens(F.col("t")).alias("k"), tx.strip(F.col("t")).alias("s"))
    for t, tokens, stripped in rows.collect():
        assert tokens == (t or "").split()
        assert stripped == (t.strip() if t is not None else None)


def test_every_bmp_space_is_known(spark):
    texts = [f"a{chr(c)}b" for c in range(1, 0xD800)]
    cut = frame(spark, texts).select("t", tx.space_tokens(F.col("t")).alias("k")).filter(F.size("k") != 1)
    assert {r["t"] for r in cut.collect()} == {t for t in texts if len(t.split()) == 2}


def test_word_tokens(spark):
    rows = frame(spark, samples()).select("t", tx.word_tokens(F.col("t")).alias("w"))
    for t, words in rows.collect():
        assert words == re.findall(r"\w\w+", (t or "").lower())


def test_stop_words(spark):
    got = frame(spark, ["The cat and the hat"]).select(tx.word_tokens(F.col("t"), ["the", "and"])).first()[0]
    assert got == ["cat", "hat"]


def test_ngrams(spark):
    rows = frame(spark, ["", "one", "one two", "one two three"]).select(tx.word_tokens(F.col("t")).alias("w"))
    got = [r[0] for r in rows.select(tx.ngrams(F.col("w"))).collect()]
    assert got == [[], ["one"], ["one", "two", "one two"], ["one", "two", "three", "one two", "two three"]]


def test_clean(spark):
    got = frame(spark, [None, "", " 　\n", "  x y "]).select(tx.clean(F.col("t"))).collect()
    assert [r[0] for r in got] == ["統計指標", "統計指標", "統計指標", "x y"]


def test_labels(spark):
    row = spark.createDataFrame([("A", None, "C", "7")], "a string, b string, c string, code string").select(
        labels.path(F.col("a"), F.col("b"), F.col("c")),
        labels.link("https://x.example/r?e=1", "t/c", F.col("code")),
        labels.named(F.col("a"), F.col("c")),
        labels.titled(F.col("b")),
        labels.described(F.col("b")),
        labels.reasoned(F.col("b")),
    ).first()
    assert list(row) == ["A >  > C", "https://x.example/r?e=1&filter=t/c eq '7'", "A (C)", "無題の観点", "", "理由なし"]
