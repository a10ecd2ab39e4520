"""Finding catalogue rows by name: exact, else by containment, first in corpus order."""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterable, Iterator
from re import _constants as C
from re import _parser as parser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.catalogue import NAME
from ..sources.index_store import DOC_PART, doc_part
from ..sources.workspace import materialise

# The columns of a looked-up row.
DETAIL_COLUMNS = ["koumoku_name_full", "bunya_name", "chuubunrui_name", "shoubunrui_name", "koumoku_code"]

# Characters of names searched for in one scan of the catalogue; a task's automaton takes about 60 MB.
NAME_CHARACTERS = 1_000_000
# Texts that meet a split of more names than that.
BLOCK_TEXTS = 20_000


def exact(names: DataFrame, corpus: DataFrame) -> DataFrame:
    """(key, doc_id): the first row whose stripped name equals each stripped ``key``."""
    rows = corpus.select(tx.strip(F.col(NAME)).alias("key"), "doc_id")
    # However often a name occurs, each task passes on one row for it.
    return rows.join(names, "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("doc_id"))


def folded(text: str) -> str:
    """One character for each, equal for characters that a pattern takes for the same when case is ignored."""
    return text.translate(_FOLD)


class _Fold(dict):
    def __missing__(self, point: int) -> int:
        char = chr(point)
        fold = "i" if char in "ıİ" else char.casefold()
        found = self[point] = ord(fold) if len(fold) == 1 else ord(char.lower()[0])
        return found


_FOLD = _Fold()


def required_literal(pattern: str) -> str:
    """The longest run of characters, folded, that every match of ``pattern`` holds; empty if none is sure.

    Alternatives, classes and optional parts hold nothing for sure. A repeated part is there at least once.
    """
    best = ""

    def walk(items, run: str) -> str:
        nonlocal best
        for op, value in items:
            if op is C.LITERAL and len(chr(value).casefold()) == 1:
                run += folded(chr(value))
            else:
                best, run = max(best, run, key=len), ""
                if op is C.SUBPATTERN and not value[1] and not value[2]:
                    run = walk(value[3], "")
                elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and value[0] >= 1:
                    inner = walk(value[2], "")
                    best = max(best, inner, key=len)
                elif op is C.ATOMIC_GROUP:
                    run = walk(value, "")
        return run

    last = walk(parser.parse(pattern, re.IGNORECASE), "")
    return max(best, last, key=len)


class LiteralFinder:
    """All keys in one automaton."""

    def __init__(self, keys: list[str]):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for key in keys:
            self.machine.add_word(key, key)
        if keys:
            self.machine.make_automaton()
        self.any = bool(keys)

    def found(self, text: str, first: dict[str, int], doc_id: int) -> Iterator[str]:
        return (hit for _, hit in self.machine.iter(text)) if self.any else iter(())


class PatternFinder:
    """Patterns by a literal they require: one automaton finds the literals, and a pattern runs on texts that hold its own.

    Patterns without a literal take the slow path: each runs on every text until it has matched before. Invalid ones match nothing.
    """

    def __init__(self, keys: list[str]):
        self.by_literal: dict[str, list[tuple[str, re.Pattern]]] = {}
        self.slow: list[tuple[str, re.Pattern]] = []
        self.runs = 0
        for key in keys:
            try:
                compiled = re.compile(key, re.IGNORECASE)
            except re.error:
                continue
            literal = required_literal(key)
            (self.by_literal.setdefault(literal, []) if literal else self.slow).append((key, compiled))
        self.literals = LiteralFinder(list(self.by_literal))

    def found(self, text: str, first: dict[str, int], doc_id: int) -> Iterator[str]:
        held = set(self.literals.found(folded(text), first, doc_id))
        for key, pattern in itertools.chain(*[self.by_literal[h] for h in held], self.slow):
            # A pattern that has a smaller row already need not run.
            if doc_id < first.get(key, doc_id + 1):
                self.runs += 1
                if pattern.search(text):
                    yield key


def first_rows(finder: LiteralFinder | PatternFinder, batches: Iterable[tuple[list[int], list[str]]]) -> dict[str, int]:
    """The smallest row of each key that is found in a text."""
    first: dict[str, int] = {}
    for ids, texts in batches:
        for doc_id, text in zip(ids, texts, strict=True):
            for hit in finder.found(text, first, doc_id):
                if doc_id < first.get(hit, doc_id + 1):
                    first[hit] = doc_id
    return first


FOUND = "found string, doc_id bigint"


def _found(first: dict[str, int]) -> pa.Table:
    return pa.table([pa.array(list(first), pa.string()), pa.array(list(first.values()), pa.int64())], names=["found", "doc_id"])


def containing(names: DataFrame, corpus: DataFrame, regex: bool = False, characters: int = NAME_CHARACTERS) -> DataFrame:
    """(key, doc_id): the first row whose name contains each ``key``, ignoring case.

    A task runs through each text once for all names together and hands on one row per name found. Names up to
    ``characters`` go to every task, and the catalogue is not shuffled; more are split, and the number of the split is a key of the same job, so
    that blocks of texts meet splits of names and the catalogue is still scanned once. ``regex`` reads the keys as patterns.
    """
    low = F.col("key") if regex else F.lower("key")
    names = materialise(names.select("key").filter(F.col("key") != "").distinct().withColumn("wanted", low), "names")
    total = names.agg(F.sum(F.length("key"))).first()[0] or 0
    texts = corpus.select("doc_id", F.col(NAME).alias("text") if regex else F.lower(NAME).alias("text")).filter(
        F.col("text").isNotNull()
    )
    finder = PatternFinder if regex else LiteralFinder
    if total <= characters:
        shared = corpus.sparkSession.sparkContext.broadcast([r[0] for r in names.select("wanted").distinct().collect()])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            columns = ((b.column(0).to_pylist(), b.column(1).to_pylist()) for b in batches)
            yield from _found(first_rows(finder(shared.value), columns)).to_batches()

        hits = texts.mapInArrow(run, FOUND)
    else:
        # A quarter more splits than needed leave room for chance.
        splits, blocks = math.ceil(total / characters * 1.25), max(1, math.ceil(texts.count() / BLOCK_TEXTS))

        def every(n: int):
            return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

        left = texts.withColumn("d", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int")).withColumn("q", every(splits))
        right = names.select("wanted").distinct().withColumn("q", F.pmod(F.xxhash64("wanted"), F.lit(splits)).cast("int"))
        right = right.withColumn("d", every(blocks))

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            columns = [(left.column("doc_id").to_pylist(), left.column("text").to_pylist())]
            return _found(first_rows(finder(right.column("wanted").to_pylist()), columns))

        hits = left.groupBy("d", "q").cogroup(right.groupBy("d", "q")).applyInArrow(meet, FOUND)
    firsts = hits.groupBy("found").agg(F.min("doc_id").alias("doc_id"))
    return names.join(firsts, F.col("wanted") == F.col("found")).select("key", "doc_id")


def find_rows(names: DataFrame, corpus: DataFrame, regex: bool = False) -> DataFrame:
    """(name, key, matched, doc_id) for every distinct name: 'exact', 'contains' or null.

    Blank names match nothing.
    """
    distinct = materialise(
        names.select("name", tx.strip(F.col("name")).alias("key")).filter(F.col("name").isNotNull()).distinct(), "asked"
    )
    keys = distinct.select("key").filter(F.col("key") != "").distinct()
    by_name = materialise(exact(keys, corpus), "exact")
    by_part = containing(keys.join(by_name, "key", "left_anti"), corpus, regex)
    hits = by_name.withColumn("matched", F.lit("exact")).unionByName(by_part.withColumn("matched", F.lit("contains")))
    return distinct.join(hits, "key", "left").select("name", "key", "matched", "doc_id")


def find_names(names: DataFrame, corpus: DataFrame, regex: bool = False, buckets: int | None = None) -> DataFrame:
    """(name, matched, doc_id, detail columns) of the names that were found.

    With the ``buckets`` of an index's corpus, details are read from the partitions that hold a found row.
    """
    hits = materialise(find_rows(names, corpus, regex).filter(F.col("doc_id").isNotNull()).drop("key"), "found")
    if buckets and DOC_PART in corpus.columns:
        hits = hits.withColumn(DOC_PART, doc_part(F.col("doc_id"), buckets))
        found = hits.join(corpus.select("doc_id", DOC_PART, *DETAIL_COLUMNS), ["doc_id", DOC_PART])
        return found.select("name", "matched", "doc_id", *DETAIL_COLUMNS)
    return hits.join(corpus.select("doc_id", *DETAIL_COLUMNS), "doc_id").select("name", "matched", "doc_id", *DETAIL_COLUMNS)
