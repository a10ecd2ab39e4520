"""Catalogue tables: reading them, joining the definitions, composing the search text, saving."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .workspace import materialise

# Column names of the data model and the field order of the search text.
CATALOGUE_COLUMNS = [
    "koumoku_code",
    "koumoku_name",
    "koumoku_name_full",
    "bunya_name",
    "chuubunrui_name",
    "shoubunrui_name",
    "stat_name",
]
DEFINITION_COLUMNS = ["koumoku_code", "definition"]
SEARCH_FIELDS = [
    "koumoku_name_full",
    "bunya_name",
    "chuubunrui_name",
    "shoubunrui_name",
    "definition",
    "stat_name",
]
FACET = "bunya_name"
NAME = "koumoku_name_full"

# Columns that say where a record stands: its number, and while that is worked out its file, split and place in the task.
ROW_NUMBER = "row_number"
FILE, BLOCK, SEQUENCE = "_file", "_file_block", "_sequence"
# Rows that are numbered together where codes are defined more than once.
NUMBERED_ROWS = 100_000


def read_csv(
    spark: SparkSession,
    path: str,
    columns: Sequence[str],
    *,
    null_values: Sequence[str] = (),
    multi_line: bool = True,
    optional: Sequence[str] = (),
    places: bool = False,
) -> DataFrame:
    """CSV with a header, as strings, cut to ``columns``; fails on a missing one unless it is optional.

    ``multi_line`` reads quoted line breaks and makes each file one task. Turn it off for big files whose records have none.
    """
    raw = spark.read.options(header=True, quote='"', escape='"', multiLine=multi_line).csv(path)
    if not places:
        return take_columns(raw, columns, null_values=null_values, optional=optional)
    place = [F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(BLOCK)]
    known = [c for c in columns if c in raw.columns]
    return take_columns(raw.select(*known, *place), [*columns, FILE], null_values=null_values, optional=optional, kept=[BLOCK])


def read_numbered_csv(spark: SparkSession, path: str, columns: Sequence[str], **options) -> DataFrame:
    """``read_csv`` with ``row_number``: the place of each record, counted from 0, by file name and place in the file.

    The number depends on the files alone: not on how Spark cuts them into splits, nor on how it packs splits into tasks.
    The rows are stored once with the split they came from. Records of a split lie one behind another, so a record's
    place is that of its split, a prefix sum over all splits, and its distance from the first record of the split.
    """
    rows = read_csv(spark, path, columns, places=True, **options)
    stored = materialise(rows.withColumn(SEQUENCE, F.monotonically_increasing_id()), "csv-rows")
    splits = stored.groupBy(FILE, BLOCK).agg(F.count("*").alias("_n"), F.min(SEQUENCE).alias("_first"))
    # A row per split: prefix sums within each file, then over the files.
    files = splits.groupBy(FILE).agg(F.sum("_n").alias("_in_file"))
    before_file = F.coalesce(F.sum("_in_file").over(Window.orderBy(FILE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before_split = F.coalesce(F.sum("_n").over(Window.partitionBy(FILE).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = splits.withColumn("_in", before_split).join(files.select(FILE, before_file.alias("_before")), FILE)
    numbered = stored.join(bases.select(FILE, BLOCK, "_first", (F.col("_before") + F.col("_in")).alias("_base")), [FILE, BLOCK])
    return numbered.select(*[c for c in columns if c in rows.columns], (F.col("_base") + F.col(SEQUENCE) - F.col("_first")).alias(ROW_NUMBER))


def take_columns(
    df: DataFrame,
    columns: Sequence[str],
    *,
    null_values: Sequence[str] = (),
    optional: Sequence[str] = (),
    kept: Sequence[str] = (),
) -> DataFrame:
    missing = [c for c in columns if c not in df.columns and c not in optional]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")

    def cell(name: str) -> Column:
        value = F.col(name).cast("string")
        return (F.when(~value.isin(list(null_values)), value) if null_values else value).alias(name)

    return df.select([cell(c) for c in columns if c in df.columns] + list(kept))


def row_counts(**tables: DataFrame) -> DataFrame:
    """One row per table with its number of rows."""
    parts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table"), "n_rows") for n, df in tables.items()]
    counts = parts[0]
    for part in parts[1:]:
        counts = counts.unionByName(part)
    return counts


def search_text(fields: Sequence[str] = SEARCH_FIELDS) -> Column:
    return F.concat_ws(" ", *[tx.or_blank(F.col(f)) for f in fields])


def _row_places(catalogue: DataFrame, definitions: DataFrame) -> DataFrame:
    """The catalogue joined with its definitions; ``doc_id`` counts the joined rows by catalogue row, then definition row.

    Where no code is defined twice that is the catalogue's row number. Each further definition of a row moves what follows by
    one: summed up per block of rows, then over the blocks, then inside each block.
    """

    def numbered(df: DataFrame, name: str) -> DataFrame:
        number = F.col(ROW_NUMBER) if ROW_NUMBER in df.columns else F.monotonically_increasing_id()
        return df.withColumn(name, number).drop(ROW_NUMBER)

    left, right = numbered(catalogue, "_row"), numbered(definitions, "_def_row")
    by_code = Window.partitionBy("koumoku_code")
    right = right.withColumn("_k", F.row_number().over(by_code.orderBy("_def_row")) - 1).withColumn("_times", F.count("*").over(by_code))
    joined = left.join(right, "koumoku_code", "left").withColumn("_k", F.coalesce("_k", F.lit(0)))
    more = F.when(F.col("_k") == 0, F.coalesce("_times", F.lit(1)) - 1).otherwise(0)
    joined = joined.withColumn("_block", F.floor(F.col("_row") / NUMBERED_ROWS)).withColumn("_more", more)
    blocks = materialise(joined.filter("_more > 0").groupBy("_block").agg(F.sum("_more").alias("_in")), "further-definitions")
    if blocks.isEmpty():
        return joined.withColumn("doc_id", F.col("_row"))
    every = joined.select("_block").distinct().join(blocks, "_block", "left")
    before = F.coalesce(F.sum("_in").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = Window.partitionBy("_block").orderBy("_row", "_k").rowsBetween(Window.unboundedPreceding, -1)
    placed = joined.withColumn("_moved", F.coalesce(F.sum("_more").over(inside), F.lit(0)))
    placed = placed.join(every.select("_block", before.alias("_before")), "_block")
    # What a row's own first definition adds lies before its further ones already.
    own = F.when(F.col("_k") > 0, F.col("_times") - 1).otherwise(0)
    return placed.withColumn("doc_id", F.col("_row") + F.col("_before") + F.col("_moved") - own + F.col("_k"))


def build_corpus(catalogue: DataFrame, definitions: DataFrame, id_column: str | None = None) -> DataFrame:
    """Catalogue rows with their definition ('' where there is none) and search text.

    Left join, so every catalogue row stays and a code defined twice gives two rows. With ``id_column`` the caller's unique
    id becomes ``doc_id``; otherwise rows are counted: by the ``row_number`` of both tables if they have one, as
    ``read_numbered_csv`` gives it, and then ids are the same however the files are split; else as read.
    """
    keep = [c for c in CATALOGUE_COLUMNS if c in catalogue.columns]
    if id_column is None:
        numbers = [ROW_NUMBER] if ROW_NUMBER in definitions.columns else []
        joined = _row_places(catalogue, definitions.select(*DEFINITION_COLUMNS, *numbers))
        doc_id = F.col("doc_id").cast("bigint")
    else:
        joined = catalogue.join(definitions.select(*DEFINITION_COLUMNS), "koumoku_code", "left")
        doc_id = F.col(id_column).cast("bigint")
    filled = joined.withColumn("definition", F.coalesce("definition", F.lit("")))
    if "koumoku_name" not in keep:
        filled = filled.withColumn("koumoku_name", F.col("koumoku_name_full"))
    return filled.select(
        doc_id.alias("doc_id"), *CATALOGUE_COLUMNS, "definition", search_text().alias("search_text")
    )


def text_quality(df: DataFrame, column: str) -> DataFrame:
    """How many raw texts are null or blank and how many keep their own text once cleaned."""
    raw = F.col(column)
    return df.agg(
        F.count("*").alias("n_texts"),
        F.count_if(raw.isNull()).alias("n_null"),
        F.count_if(tx.is_blank(raw)).alias("n_blank"),
        F.count_if(tx.clean(raw) == tx.BLANK_TEXT).alias("n_default"),
        F.sum(F.length(tx.clean(raw))).alias("n_clean_chars"),
    )


def save_corpus(corpus: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    corpus.write.mode(mode).parquet(path)
    return read_corpus(corpus.sparkSession, path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
