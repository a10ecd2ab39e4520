"""Grouping results by field, widening each group from the catalogue, prompt text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.scores import best
from ..sources.catalogue import FACET, NAME
from ..sources.workspace import materialise

# Search depth and how many names each part of the prompt shows.
RESULTS_FOR_PROMPT = 40
ADDED_NAMES = 10
SUMMARY_NAMES = 15
DETAIL_NAMES = 12

# Names of all fields that a task holds at once.
HELD_NAMES = 1_000_000


def distribution(results: DataFrame) -> DataFrame:
    """How many results of each query fall into each field."""
    return results.groupBy("query_id", F.col(FACET).alias("facet")).agg(F.count("*").alias("n_results"))


def _grouped_hits(results: DataFrame) -> DataFrame:
    """(query_id, facet, facet_pos, rank, name): fields numbered by their first hit."""
    hits = results.select("query_id", "rank", F.col(FACET).alias("facet"), F.col(NAME).alias("name"))
    first = hits.withColumn("first_rank", F.min("rank").over(Window.partitionBy("query_id", "facet")))
    number = F.dense_rank().over(Window.partitionBy("query_id").orderBy("first_rank"))
    return first.withColumn("facet_pos", number).drop("first_rank")


def first_names(rows: DataFrame, n: int) -> DataFrame:
    """(facet, name, doc_id): per task the first ``n`` distinct names of each field, with the first row of each.

    The first ``n`` names of all rows are among these: where a name's first row lies, fewer than ``n`` names come before it.
    """

    def cut(table: pa.Table) -> pa.Table:
        table = table.group_by(["facet", "name"], use_threads=False).aggregate([("doc_id", "min")]).rename_columns(["facet", "name", "doc_id"])
        field = table.column("facet").combine_chunks().dictionary_encode().indices.to_numpy()
        order = np.lexsort((table.column("doc_id").to_numpy(), field))
        place = np.arange(len(order)) - np.searchsorted(field[order], field[order], side="left")
        return table.take(pa.array(order[place < n]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = cut(new if held is None else pa.concat_tables([held, new.cast(held.schema)]))
            if held.num_rows > HELD_NAMES:
                # So many fields that they do not fit: what is known so far goes on as it is.
                yield from held.to_batches()
                held = None
        if held is not None:
            yield from held.to_batches()

    return rows.select("facet", "name", F.col("doc_id").cast("bigint").alias("doc_id")).mapInArrow(run, "facet string, name string, doc_id bigint")


def facet_heads(corpus: DataFrame, facets: DataFrame, hit_names: int, added: int = ADDED_NAMES) -> DataFrame:
    """(facet, name, doc_id): the only catalogue rows that can widen a group, a bounded number per field.

    Of one name at most ``added`` rows can be taken. At most ``hit_names`` names are excluded from a
    field, so the rows come from its first ``hit_names + added`` distinct names. Both cuts are made per
    task before anything is shuffled by field, so a field holding much of the corpus stays cheap.
    """
    rows = corpus.select(F.col(FACET).alias("facet"), F.col(NAME).alias("name"), "doc_id")
    rows = rows.filter(F.col("name").isNotNull()).join(facets, "facet", "left_semi")
    firsts = first_names(rows, hit_names + added).groupBy("facet", "name").agg(F.min("doc_id").alias("doc_id"))
    names = best(firsts, hit_names + added, ["facet"], [F.asc("doc_id")]).select("facet", "name")
    names = materialise(names, "facet-names")
    kept = rows.join(names, ["facet", "name"], "left_semi")
    return best(kept, added, ["facet", "name"], [F.asc("doc_id")]).drop("rk")


def expand(results: DataFrame, corpus: DataFrame, added: int = ADDED_NAMES) -> DataFrame:
    """(query_id, facet, facet_pos, item_pos, name, is_hit): hits by rank, then the added names.

    To each hit field come its first ``added`` catalogue rows, in corpus order, whose name is not among
    the field's hits; a name may come more than once. A null field gets none.
    """
    hits = materialise(_grouped_hits(results), "hits")
    most = hits.groupBy("query_id", "facet_pos").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    facets = hits.select("facet").filter(F.col("facet").isNotNull()).distinct()
    heads = materialise(facet_heads(corpus, facets, most, added), "facet-heads")
    groups = hits.select("query_id", "facet", "facet_pos").distinct()
    taken = hits.select("query_id", F.col("facet").alias("t_facet"), F.col("name").alias("t_name")).distinct()
    others = groups.join(heads, "facet").alias("o").join(
        taken.alias("t"),
        (F.col("o.query_id") == F.col("t.query_id"))
        & (F.col("o.facet") == F.col("t_facet"))
        & (F.col("o.name") == F.col("t_name")),
        "left_anti",
    )
    extra = best(others, added, ["query_id", "facet_pos"], [F.asc("doc_id")])
    both = hits.select(
        "query_id", "facet", "facet_pos", "name", F.lit(True).alias("is_hit"), F.col("rank").cast("bigint").alias("place")
    ).unionByName(
        extra.select(
            "query_id", "facet", "facet_pos", "name", F.lit(False).alias("is_hit"), F.col("rk").cast("bigint").alias("place")
        )
    )
    order = Window.partitionBy("query_id", "facet_pos").orderBy(F.desc("is_hit"), F.asc("place"))
    return both.withColumn("item_pos", F.row_number().over(order)).select(
        "query_id", "facet", "facet_pos", "item_pos", "name", "is_hit"
    )


def summary(items: DataFrame, shown: int = SUMMARY_NAMES) -> DataFrame:
    """One line per query and field: the field, how many names it has, the first ``shown`` of them."""
    # A group has at most the results of one query plus the added names.
    names = F.transform(
        F.array_sort(F.collect_list(F.when(F.col("item_pos") <= shown, F.struct("item_pos", "name")))),
        lambda s: s["name"],
    )
    grouped = items.groupBy("query_id", "facet_pos", "facet").agg(
        F.count("*").cast("int").alias("n_names"), F.array_join(names, labels.NAME_SEPARATOR).alias("names")
    )
    line = F.format_string(labels.SUMMARY_FORMAT, "facet", "n_names", "names")
    return grouped.select("query_id", "facet_pos", "facet", "n_names", line.alias("line"))


def details(items: DataFrame, shown: int = DETAIL_NAMES) -> DataFrame:
    """The first ``shown`` names of each field as 'name (field)', numbered through the query."""
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("facet_pos", "item_pos"))
    return items.filter(F.col("item_pos") <= shown).select(
        "query_id", number.alias("detail_pos"), labels.named(F.col("name"), F.col("facet")).alias("label")
    )


def totals(items: DataFrame) -> DataFrame:
    return items.groupBy("query_id").agg(
        F.count_distinct("facet_pos").alias("n_facets"), F.count("*").alias("n_names")
    )


def prompt_text(lines: DataFrame) -> DataFrame:
    """(query_id, available): the summary lines of a query, one below the other."""
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct("facet_pos", "line"))), lambda s: s["line"]
    )
    return lines.groupBy("query_id").agg(F.array_join(ordered, "\n").alias("available"))
