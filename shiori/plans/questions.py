"""From questions to checked recommendations: search, prompt, model answer, catalogue check."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from ..operators import answers, facets
from ..operators.term_blocks import valid_queries
from ..operators.vectors import Embedder, hashing_embedder
from ..sources.index_store import Index
from ..sources.workspace import materialise
from .hybrid import hybrid_search


class Answered(NamedTuple):
    """What each step found; all but ``cards`` are saved tables."""

    results: DataFrame
    items: DataFrame
    responses: DataFrame
    checked: DataFrame
    cards: DataFrame


def ask(
    index: Index,
    queries: DataFrame,
    responder: answers.Responder,
    *,
    base_link: str,
    link_column: str,
    top_k: int = facets.RESULTS_FOR_PROMPT,
    vector_weight: float = 0.6,
    embedder: Embedder = hashing_embedder(64),
    system: str = answers.SYSTEM_PROMPT,
    user: str = answers.USER_PROMPT,
) -> Answered:
    """Every question at once. The responder runs once per question: its texts are saved before use."""
    queries = materialise(valid_queries(queries), "questions")
    results = materialise(hybrid_search(index, queries, top_k, vector_weight, embedder=embedder), "results")
    items = materialise(facets.expand(results, index.corpus), "items")
    available = facets.prompt_text(facets.summary(items))
    responses = materialise(answers.respond(answers.prompts(queries, available, system, user), responder), "responses")
    flat = materialise(answers.flatten(answers.parse(responses)), "answers")
    checked = materialise(answers.verified(flat, index.corpus), "checked")
    return Answered(results, items, responses, checked, answers.cards(checked, base_link, link_column))
