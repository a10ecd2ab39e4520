"""The saved index: parquet tables in a folder per version, those with rows per document bucketed by it.

A build writes into a new folder. The last thing it writes is a row of the manifest, and only versions named there can be
opened: a build that stopped half-way is never seen, one that succeeds takes the place of the version before, whose readers
go on with the folder they opened until it is removed.

Bucketing by ``doc_id`` puts all postings of a document into one task, so the sum of a document's term
scores needs no shuffle, and neither does any step of the build after the corpus is saved. Postings are
also split into term partitions, so a query reads only the partitions its terms fall into (dynamic
partition pruning against the broadcast query terms). The corpus is partitioned along its own buckets:
a few candidates read only their partitions, many are joined bucket by bucket.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .catalogue import CATALOGUE_COLUMNS

TERM_PART = "term_part"
DOC_PART = "doc_part"

# Table name -> (columns, partition column, bucketed by doc_id).
LAYOUT: dict[str, tuple[str, str | None, bool]] = {
    "corpus": (
        f"doc_id BIGINT, {', '.join(f'{c} STRING' for c in CATALOGUE_COLUMNS)}, definition STRING, doc_part INT",
        DOC_PART,
        True,
    ),
    "counted": (
        "doc_id BIGINT, dl INT, terms ARRAY<STRING>, tfs ARRAY<INT>, words ARRAY<STRING>, counts ARRAY<INT>,"
        " firsts ARRAY<INT>, seconds ARRAY<INT>, pair_counts ARRAY<INT>, embedding ARRAY<FLOAT>",
        None,
        True,
    ),
    "postings": ("doc_id BIGINT, term STRING, tf INT, dl INT, term_part INT", TERM_PART, True),
    "terms": ("term STRING, df BIGINT, cf BIGINT, raw DOUBLE, term_part INT", TERM_PART, False),
    "weights": ("doc_id BIGINT, term STRING, w DOUBLE, term_part INT", TERM_PART, True),
    "vocab": ("term STRING, df BIGINT, cf BIGINT, idf DOUBLE", None, False),
    "vectors": ("doc_id BIGINT, embedding ARRAY<FLOAT>", None, False),
    "meta": (
        "created_at TIMESTAMP, total_records BIGINT, embedding_model STRING, vector_dimension INT,"
        " n_vectors BIGINT, n_tokens BIGINT, avg_length DOUBLE, avg_raw DOUBLE, n_terms BIGINT,"
        " buckets INT, term_parts INT, head ARRAY<BIGINT>, stop_words ARRAY<STRING>",
        None,
        False,
    ),
}


MANIFEST = "number BIGINT, version STRING, published_at TIMESTAMP"


def term_part(term: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(parts)).cast("int")


def doc_part(doc_id: Column, buckets: int) -> Column:
    """The document's bucket number: Spark buckets a table by this same hash."""
    return F.pmod(F.hash(doc_id), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Index:
    """A version of a saved index and the one-row facts about it."""

    spark: SparkSession
    path: str
    version: str
    meta: dict[str, Any]

    @property
    def folder(self) -> str:
        return f"{self.path}/{self.version}"

    def table(self, name: str) -> DataFrame:
        columns, _, bucketed = LAYOUT[name]
        if bucketed:
            return self.spark.table(table_name(self.folder, name))
        return self.spark.read.schema(columns).parquet(f"{self.folder}/{name}")

    @property
    def corpus(self) -> DataFrame:
        return self.table("corpus")

    @property
    def n_docs(self) -> int:
        return self.meta["total_records"]

    def first_ids(self, n: int) -> list[int]:
        """The ``n`` lowest document ids; ``n`` is a search depth, not a data size."""
        if n <= HEAD_ROWS:
            return self.meta["head"][:n]
        return [r[0] for r in self.corpus.select("doc_id").orderBy("doc_id").limit(n).collect()]


HEAD_ROWS = 1000


def table_name(folder: str, name: str) -> str:
    return f"shiori_{hashlib.md5(folder.encode()).hexdigest()[:16]}_{name}"


def save_table(df: DataFrame, folder: str, name: str, buckets: int = 0) -> None:
    """Write one index table; a bucketed one is also entered in the session catalogue."""
    columns, partition, bucketed = LAYOUT[name]
    schema = T.StructType.fromDDL(columns)
    writer = df.select([F.col(f.name).cast(f.dataType) for f in schema]).write.format("parquet").option("compression", "zstd")
    if partition:
        writer = writer.partitionBy(partition)
    if bucketed:
        writer = writer.bucketBy(buckets, "doc_id")
        if partition:
            # The writer sorts by partition anyway; equal terms side by side compress well.
            writer = writer.sortBy("term" if partition == TERM_PART else "doc_id")
        writer.option("path", f"{folder}/{name}").saveAsTable(table_name(folder, name))
    else:
        writer.save(f"{folder}/{name}")


def published(spark: SparkSession, path: str) -> list[Row]:
    """The manifest's rows (number, version, published_at), the newest first; none if nothing was ever finished."""
    folder = f"{path.rstrip('/')}/manifest"
    # One row for each build ever finished here.
    rows = spark.read.schema(MANIFEST).parquet(folder).collect() if _exists(spark, folder) else []
    return sorted(rows, key=lambda r: (r["number"], r["published_at"], r["version"]), reverse=True)


def new_version(spark: SparkSession, path: str) -> tuple[int, str]:
    """Number and folder name of a build that starts now; two builds at a time have folders of their own."""
    known = published(spark, path)
    number = known[0]["number"] + 1 if known else 1
    return number, f"v{number:06d}-{uuid.uuid4().hex[:8]}"


def publish(spark: SparkSession, path: str, number: int, version: str) -> None:
    """Name a finished version in the manifest: one small file, added when all tables are written."""
    row = spark.range(1).select(F.lit(number).alias("number"), F.lit(version).alias("version"), F.current_timestamp().alias("published_at"))
    row.select([F.col(f.name).cast(f.dataType) for f in T.StructType.fromDDL(MANIFEST)]).coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def _hadoop_path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    found, files = _hadoop_path(spark, path)
    return files.exists(found)


def remove_versions(spark: SparkSession, path: str, keep: int = 1, unfinished: bool = False) -> list[str]:
    """Delete finished versions but the newest ``keep``; with ``unfinished`` also what stopped builds left. Their names.

    No reader may still use what is deleted, and with ``unfinished`` no build may be running.
    """
    path = path.rstrip("/")
    known = [r["version"] for r in published(spark, path)]
    folder, files = _hadoop_path(spark, path)
    names = sorted(s.getPath().getName() for s in files.listStatus(folder) if s.isDirectory() and s.getPath().getName() != "manifest")
    gone = [n for n in names if n in known[keep:] or (unfinished and n not in known)]
    for name in gone:
        _forget(spark, f"{path}/{name}")
        files.delete(_hadoop_path(spark, f"{path}/{name}")[0], True)
    return gone


def _forget(spark: SparkSession, folder: str) -> None:
    for name, (_, _, bucketed) in LAYOUT.items():
        if bucketed:
            spark.sql(f"DROP TABLE IF EXISTS {table_name(folder, name)}")


def forget(index: Index) -> None:
    """Take the bucketed tables out of the session catalogue; the files stay."""
    _forget(index.spark, index.folder)


def open_index(spark: SparkSession, path: str, version: str | None = None) -> Index:
    """Use a saved index again, in this or a later session: its newest finished version unless another is named."""
    path = path.rstrip("/")
    known = [r["version"] for r in published(spark, path)]
    if not known or version not in (None, *known):
        raise ValueError(f"no finished index {version or ''} under {path}")
    version = version or known[0]
    folder = f"{path}/{version}"
    meta = spark.read.schema(LAYOUT["meta"][0]).parquet(f"{folder}/meta").first().asDict()
    for name, (columns, partition, bucketed) in LAYOUT.items():
        table = table_name(folder, name)
        if not bucketed or spark.catalog.tableExists(table):
            continue
        parts = f"PARTITIONED BY ({partition})" if partition else ""
        spark.sql(
            f"CREATE TABLE {table} ({columns}) USING parquet {parts} "
            f"CLUSTERED BY (doc_id) INTO {meta['buckets']} BUCKETS LOCATION '{folder}/{name}'"
        )
        if partition:
            spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")
    return Index(spark, path, version, meta)
