"""Tables written between stages: what is discarded goes, and only that."""

import os

from pyspark.sql import functions as F

from shiori.sources.workspace import CLEAN_SHUFFLES, discard, materialise, shared_folder, together


def folders(spark, label):
    base = os.path.join(shared_folder(spark).removeprefix("file:"), "shiori")
    return [n for n in os.listdir(base) if n.startswith(label + "-")] if os.path.isdir(base) else []


def test_discarded_tables_are_removed_and_others_stay(spark):
    gone, kept = (materialise(spark.range(50), label) for label in ("goes", "stays"))
    assert len(folders(spark, "goes")) == len(folders(spark, "stays")) == 1
    plain = kept.filter("id > 3")
    discard(gone, gone, plain, spark.range(3))
    assert folders(spark, "goes") == []
    assert kept.count() == 50 and plain.count() == 46


def test_writes_side_by_side_put_the_setting_back(spark):
    before = spark.conf.get(CLEAN_SHUFFLES)
    make = lambda: materialise(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count(), "beside")
    for table in together(make, make, make):
        assert table.agg(F.sum("count")).first()[0] == 1000
        discard(table)
    assert spark.conf.get(CLEAN_SHUFFLES) == before
    assert folders(spark, "beside") == []
