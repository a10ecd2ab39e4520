"""Model answers: asking a pluggable responder, taking the JSON out, flattening and checking it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import labels
from .lookup import find_names

# (system prompts, user prompts) in, one response text per pair out.
Responder = Callable[[list[str], list[str]], list[str]]

# Keys of the answer object.
ANSWER_SCHEMA = (
    "analysis_perspectives ARRAY<STRUCT<perspective_title STRING, perspective_description STRING, "
    "recommended_indicators ARRAY<STRUCT<indicator_name STRING, recommendation_reason STRING>>>>"
)

# What a failed call returns as its text.
FAILURE_PREFIX = "No answer: "

SYSTEM_PROMPT = """統計の専門家として質問に答え、関連する統計指標を観点ごとに挙げてください。
指標名は次の一覧にあるものを、表記を変えずに使ってください。
{available}
答えは次の形のJSONだけにしてください。
{{"analysis_perspectives": [{{"perspective_title": "", "perspective_description": "",
"recommended_indicators": [{{"indicator_name": "", "recommendation_reason": ""}}]}}]}}"""
USER_PROMPT = "次の質問に関連する統計指標を挙げてください。\n\n{query}"


def _filled(template: str, field: str, value: Column) -> Column:
    """The template with one field filled in; doubled braces stand for single ones."""
    before, after = template.split("{" + field + "}")
    plain = [part.replace("{{", "{").replace("}}", "}") for part in (before, after)]
    return F.concat(F.lit(plain[0]), value, F.lit(plain[1]))


def prompts(
    queries: DataFrame, available: DataFrame, system: str = SYSTEM_PROMPT, user: str = USER_PROMPT
) -> DataFrame:
    """(query_id, system_prompt, user_prompt)."""
    return queries.join(available, "query_id").select(
        "query_id",
        _filled(system, "available", F.col("available")).alias("system_prompt"),
        _filled(user, "query", F.col("query")).alias("user_prompt"),
    )


def _answered(responder: Responder, systems: list[str], users: list[str]) -> list[str]:
    """One text per prompt; if the call fails, prompt by prompt, so that only those that fail carry their error."""
    try:
        texts = responder(systems, users)
    except Exception as error:
        if len(users) == 1:
            return [FAILURE_PREFIX + str(error)]
        return [_answered(responder, [s], [u])[0] for s, u in zip(systems, users, strict=True)]
    if len(texts) != len(users):
        raise ValueError(f"responder gave {len(texts)} texts for {len(users)} prompts")
    return texts


def respond(asked: DataFrame, responder: Responder, batch_size: int = 100) -> DataFrame:
    """(query_id, response): the responder's text per prompt; a failed prompt gives its error as text.

    Save the result before using it twice, so that the responder runs once.
    """
    schema = T.StructType([asked.schema["query_id"], T.StructField("response", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, batch_size):
                part = batch.slice(start, batch_size)
                texts = _answered(responder, part.column(1).to_pylist(), part.column(2).to_pylist())
                columns = [part.column(0), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "response"])

    return asked.select("query_id", "system_prompt", "user_prompt").mapInArrow(run, schema)


def json_block(text: Column) -> Column:
    """From the first '{' to the last '}', line breaks included; null without such a pair."""
    start = F.instr(text, "{")
    end = F.length(text) - F.instr(F.reverse(text), "}") + 1
    found = (start > 0) & (F.instr(text, "}") > 0) & (end > start)
    return F.when(found, F.substring(text, start, end - start + 1))


def strict_json(block: Column) -> Column:
    """The block if it is exactly one valid JSON value, else null.

    The parser by itself lets trailing text and cut objects pass; inside brackets neither does.
    """
    bracketed = F.concat(F.lit("["), block, F.lit("]"))
    whole = (F.json_array_length(bracketed) == 1) & F.try_parse_json(bracketed).isNotNull()
    return F.when(whole, block)


def parse(responses: DataFrame) -> DataFrame:
    """(query_id, answer): the answer struct, null where there is no valid JSON or no perspectives in it."""
    parsed = responses.withColumn("block", strict_json(json_block(F.col("response")))).withColumn(
        "answer", F.from_json("block", ANSWER_SCHEMA)
    )
    usable = F.col("answer.analysis_perspectives").isNotNull()
    return parsed.select("query_id", F.when(usable, F.col("answer")).alias("answer"))


def recommended_count(answer: Column) -> Column:
    """Indicators in an answer; null for no answer or a perspective without an indicator list."""
    sizes = F.transform(answer["analysis_perspectives"], lambda p: F.size(p["recommended_indicators"]))
    complete = F.forall(answer["analysis_perspectives"], lambda p: p["recommended_indicators"].isNotNull())
    return F.when(answer.isNotNull() & complete, F.aggregate(sizes, F.lit(0), lambda a, b: a + b))


def counts(answers: DataFrame) -> DataFrame:
    """(query_id, is_valid, n_indicators): an answer counts as valid if all its perspectives have an indicator list."""
    n = recommended_count(F.col("answer"))
    return answers.select("query_id", n.isNotNull().alias("is_valid"), n.alias("n_indicators"))


def flatten(answers: DataFrame) -> DataFrame:
    """One row per recommended indicator with 1-based positions; empty perspectives keep one row."""
    perspectives = answers.filter(F.col("answer").isNotNull()).select(
        "query_id", F.posexplode("answer.analysis_perspectives").alias("p", "perspective")
    )
    indicators = perspectives.select(
        "query_id", "p", "perspective", F.posexplode_outer("perspective.recommended_indicators").alias("i", "indicator")
    )
    return indicators.select(
        "query_id",
        (F.col("p") + 1).alias("perspective_pos"),
        labels.titled(F.col("perspective.perspective_title")).alias("title"),
        labels.described(F.col("perspective.perspective_description")).alias("description"),
        (F.col("i") + 1).alias("indicator_pos"),
        F.col("indicator.indicator_name").alias("name"),
        labels.reasoned(F.col("indicator.recommendation_reason")).alias("reason"),
    )


def verified(flat: DataFrame, corpus: DataFrame, regex: bool = False) -> DataFrame:
    """Indicators found in the catalogue with their details; perspectives without any are gone.

    ``n_verified`` is how many indicators of the perspective were found.
    """
    found = find_names(flat.select("name"), corpus, regex)
    joined = flat.filter(F.col("name").isNotNull()).join(found, "name")
    per_perspective = Window.partitionBy("query_id", "perspective_pos")
    return joined.withColumn("n_verified", F.count("*").over(per_perspective).cast("bigint"))


def cards(checked: DataFrame, base_link: str, link_column: str) -> DataFrame:
    """Display rows: name, code, reason, classification path, report link."""
    return checked.select(
        "query_id",
        "perspective_pos",
        "title",
        "description",
        "n_verified",
        "indicator_pos",
        F.col("koumoku_name_full").alias("found_name"),
        F.col("koumoku_code").alias("code"),
        "reason",
        labels.path(F.col("bunya_name"), F.col("chuubunrui_name"), F.col("shoubunrui_name")).alias("path"),
        labels.link(base_link, link_column, F.col("koumoku_code")).alias("link"),
    )
