"""Queries of the training-data operators, one for each, and the SQL that checks those SQL can express."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, chat, conversation, decontaminate, language, line_dedup, ngram_join, packing, quality, secrets, substring_dedup, topk_search, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk_search.topk(vectors, 10, is_query=F.col("vec_id") % 100 == 0)


def _remainder(n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held = _remainder(4) == 2
    return language.labelled(documents.select("doc_id", "text"), language.train(documents, ~held)).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _remainder(5) == 0
    found = quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held)
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == secrets.KINDS.index(kind))).cast("long")
    return found.select(
        "doc_id",
        *[of(kind).alias(f"n_{kind}") for kind in secrets.KINDS[:3]],
        F.sha2(secrets.written(F.col("base")), 256).alias("base_sha256"),
        secrets.written(F.array_sort(F.concat("base", "linked"))).alias("spans"),
    )


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the test items that it holds."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.decontaminated(documents, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_ids", (F.size("item_ids") > 0).alias("contaminated"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are made of control strings."""
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.formatted(rows))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("payload", "url")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its lines counted and what stays of its text."""
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_copy_chars=line_dedup.ALL_COPIES)
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    documents = table(spark, sf_dir, "documents")
    return packing.packed_documents(documents, public_tokenizers.path("byte_bpe_50k.json"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.damage_and_repair(table(spark, sf_dir, "conversations"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the digest of its token groups and how common its links are."""
    import public_tokenizers

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return align.alignment_digest(documents, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_topk_search": op1_topk_search,
        "op2_language": op2_language,
        "op3_quality": op3_quality,
        "op4_secret_scan": op4_secret_scan,
        "op5_ngram_join": op5_ngram_join,
        "op6_decontamination": op6_decontamination,
        "op7_chat": op7_chat,
        "op8_warc": op8_warc,
        "op9_line_dedup": op9_line_dedup,
        "op10_best_fit_packing": op10_best_fit_packing,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_substring_dedup": op12_substring_dedup,
        "op13_tokenizer_alignment": op13_tokenizer_alignment,
    }


OP1_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id
)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from s qualify rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_topk_search": OP1_SQL}
