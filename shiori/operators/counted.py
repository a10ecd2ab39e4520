"""The counted-token table: what the index needs of every text, from one pass over it.

A row per document holds its white-space tokens with their counts, its words with theirs, and its neighbouring words as pairs of
numbers into its own word list. Document and corpus frequencies, vocabulary, postings and weights are all read from it, and so
are the vectors where an embedder is given.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.runs import point_table, runs_of, spaces
from .vectors import BATCH, Embedder, embedded

COUNTED = (
    "doc_id bigint, dl int, terms array<string>, tfs array<int>, words array<string>, counts array<int>,"
    " firsts array<int>, seconds array<int>, pair_counts array<int>"
)

# Documents whose counts are passed on together, and the characters that they may have (one document may have more).
DOCUMENTS, CHARACTERS = 500, 250_000
# Words whose pairs are counted by numbers in the tasks: as many may be sent to each of them.
NUMBERED_WORDS = 100_000
# Distinct pairs that a task holds before it passes them on.
HELD_PAIRS = 1_000_000


def _lists(number: np.ndarray, n: int, *values: np.ndarray | pa.Array) -> list[pa.ListArray]:
    """Lists of ``values``, which lie in order of the ``number`` of their text."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(number, minlength=n))]).astype(np.int32))
    arrays = [v.cast(pa.string()) if isinstance(v, pa.Array) else pa.array(v.astype(np.int32)) for v in values]
    return [pa.ListArray.from_arrays(offsets, v) for v in arrays]


def count_texts(texts: list[str], space: np.ndarray, word: np.ndarray, stop_words: frozenset[str]) -> list[pa.Array]:
    """The columns of ``COUNTED`` but ``doc_id`` of many texts at once; each token is a number while it is counted."""
    n = len(texts)
    number, tokens = runs_of(texts, ~space, 1)
    coded = tokens.dictionary_encode()
    known, times = np.unique(number * max(1, len(coded.dictionary)) + coded.indices.to_numpy(), return_counts=True)
    text, term = np.divmod(known, max(1, len(coded.dictionary)))
    columns = [pa.array(np.bincount(number, minlength=n).astype(np.int32)), *_lists(text, n, coded.dictionary.take(pa.array(term)), times)]

    number, words = runs_of([t.lower() for t in texts], word, 2)
    if stop_words:
        kept = ~pc.is_in(words, value_set=pa.array(sorted(stop_words), words.type)).to_numpy(zero_copy_only=False)
        number, words = number[kept], words.filter(pa.array(kept))
    coded = words.dictionary_encode()
    known, place, times = np.unique(number * max(1, len(coded.dictionary)) + coded.indices.to_numpy(), return_inverse=True, return_counts=True)
    text, term = np.divmod(known, max(1, len(coded.dictionary)))
    columns += _lists(text, n, coded.dictionary.take(pa.array(term)), times)

    # A word of a text has a place of its own, so two of them also tell the text.
    beside = number[1:] == number[:-1]
    pairs, times = np.unique(place[:-1][beside] * max(1, len(known)) + place[1:][beside], return_counts=True)
    a, b = np.divmod(pairs, max(1, len(known)))
    first = np.searchsorted(text, np.arange(n))
    text = text[a]
    return columns + _lists(text, n, a - first[text], b - first[text], times)


def _parts(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Texts in bounded groups, with the place of the first."""
    low, group, size = 0, [], 0
    for at, text in enumerate(column.to_pylist()):
        if group and (len(group) == DOCUMENTS or size + len(text) > CHARACTERS):
            yield low, group
            low, group, size = at, [], 0
        group.append(text)
        size += len(text)
    if group:
        yield low, group


def counted_tokens(texts: DataFrame, stop_words: Sequence[str] = (), embedder: Embedder | None = None) -> DataFrame:
    """The counted-token table of (doc_id, search_text); with ``embedder`` also the ``embedding`` of each cleaned text."""
    columns = [F.col("doc_id").cast("bigint").alias("doc_id"), tx.or_blank(F.col("search_text")).alias("text")]
    # The same white space, word characters and default text as in ``functions.text``.
    blanks, blank_text, letters, stops = tx.WHITE_SPACE, tx.BLANK_TEXT, tx.WORD.removesuffix("{2,}+"), frozenset(stop_words)
    names = [c.split()[0] for c in COUNTED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, word = spaces(), point_table(letters)
        for whole in batches:
            for low, group in _parts(whole.column(1)):
                arrays = [whole.column(0).slice(low, len(group)), *count_texts(group, space, word, stops)]
                if embedder is not None:
                    arrays.append(embedded([t.strip(blanks) or blank_text for t in group], embedder, BATCH))
                yield pa.RecordBatch.from_arrays(arrays, names=names + ["embedding"] * (embedder is not None))

    return texts.select(columns).mapInArrow(run, COUNTED + (", embedding array<float>" if embedder is not None else ""))


def _numbers(words: pa.Array, known: pa.Array) -> np.ndarray:
    """The place of each word in ``known``, or -1."""
    return pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def postings(counted: DataFrame) -> DataFrame:
    """(doc_id, term, tf, dl); rows of a batch come by term, so that little is left to sort where they are written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, tfs = batch.column(2).flatten(), batch.column(3).flatten()
            document = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False))
            coded = terms.dictionary_encode()
            rank = np.empty(len(coded.dictionary), np.int64)
            rank[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(rank))
            order = np.argsort(rank[coded.indices.to_numpy()], kind="stable")
            at, of = pa.array(order), pa.array(document[order])
            columns = [batch.column(0).take(of), terms.take(at), tfs.take(at), batch.column(1).take(of)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "term", "tf", "dl"])

    return counted.select("doc_id", "dl", "terms", "tfs").mapInArrow(run, "doc_id bigint, term string, tf int, dl int")


def word_counts(counted: DataFrame) -> DataFrame:
    """(term, df, cf) of single words; a batch passes on each of its words once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(0).flatten().dictionary_encode()
            place, n = coded.indices.to_numpy(), len(coded.dictionary)
            cf = np.bincount(place, batch.column(1).flatten().to_numpy(), n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(np.bincount(place, minlength=n)), pa.array(cf)], names=["term", "df", "cf"])

    rows = counted.select("words", "counts").mapInArrow(run, "term string, df bigint, cf bigint")
    return rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def pair_rows(counted: DataFrame) -> DataFrame:
    """(a, b, tf): neighbouring words of each document."""
    cells = F.explode(F.arrays_zip("firsts", "seconds", "pair_counts")).alias("p")
    at = lambda c: F.element_at("words", F.col(c) + 1)
    return counted.select("words", cells).select(at("p.firsts").alias("a"), at("p.seconds").alias("b"), F.col("p.pair_counts").alias("tf"))


def pair_counts(counted: DataFrame, least: int, words: DataFrame | None = None) -> DataFrame:
    """(term, df, cf) of neighbouring words that occur ``least`` times; of those in ``words`` (term) only, if it is given.

    Up to ``NUMBERED_WORDS`` words go to every task, which counts pairs by their numbers. More are joined.
    """
    if words is None or words.count() > NUMBERED_WORDS:
        pairs = pair_rows(counted)
        if words is not None:
            for side in ("a", "b"):
                pairs = pairs.join(words.withColumnRenamed("term", side), side, "left_semi")
        sums = pairs.groupBy("a", "b").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
        return sums.filter(F.col("cf") >= least).select(F.concat_ws(" ", "a", "b").alias("term"), "df", "cf")
    shared = counted.sparkSession.sparkContext.broadcast(words.toArrow().column("term").combine_chunks())

    def added(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        key, place = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        return key, *(np.bincount(place, np.concatenate([h[c] for h in held]), len(key)).astype(np.int64) for c in (1, 2))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held = ["pair", "df", "cf"], []
        for batch in batches:
            words, firsts, seconds, times = (batch.column(c).flatten() for c in range(4))
            n_words, n_pairs = (pc.list_value_length(batch.column(c)).to_numpy(zero_copy_only=False) for c in (0, 1))
            shift = np.repeat(np.cumsum(n_words) - n_words, n_pairs)
            number = _numbers(words, shared.value)
            a, b = number[firsts.to_numpy() + shift], number[seconds.to_numpy() + shift]
            known = (a >= 0) & (b >= 0)
            held = [added([*held, (a[known] * len(shared.value) + b[known], np.ones(int(known.sum())), times.to_numpy()[known])])]
            if len(held[0][0]) > HELD_PAIRS:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in held.pop()], names=names)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], names=names)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (shared.value.take(pa.array(x)) for x in np.divmod(batch.column(0).to_numpy(), max(1, len(shared.value))))
            yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(a, b, " "), batch.column(1), batch.column(2)], names=["term", "df", "cf"])

    rows = counted.select("words", "firsts", "seconds", "pair_counts").mapInArrow(count, "pair bigint, df bigint, cf bigint")
    sums = rows.groupBy("pair").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).filter(F.col("cf") >= least)
    return sums.mapInArrow(named, "term string, df bigint, cf bigint")


class VocabularyRows:
    """Finds the terms of a vocabulary among the words and word pairs of many documents at once."""

    def __init__(self, terms: pa.Array, idf: np.ndarray):
        self.terms, self.idf = terms, idf
        self.rank = np.empty(len(terms), np.int64)
        self.rank[pc.sort_indices(terms).to_numpy()] = np.arange(len(terms))
        halves = [(t.split(" "), k) for k, t in enumerate(terms.to_pylist()) if " " in t]
        self.pair_words = pa.array(sorted({w for pair, _ in halves for w in pair}), pa.string())
        number = {w: k for k, w in enumerate(self.pair_words.to_pylist())}
        keys = np.array([number[a] * len(number) + number[b] for (a, b), _ in halves], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_terms = keys[order], np.array([k for _, k in halves], np.int64)[order]

    def rows(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """(doc_id, term, w) of a batch (doc_id, words, counts, firsts, seconds, pair_counts), by term."""
        words, counts, firsts, seconds, pair_counts = (batch.column(c).flatten() for c in range(1, 6))
        n_words, n_pairs = (pc.list_value_length(batch.column(c)).to_numpy(zero_copy_only=False) for c in (1, 3))
        document = np.arange(batch.num_rows)
        term = _numbers(words, self.terms)
        one = term >= 0
        # Places in a document's own word list become places in all words.
        shift = np.repeat(np.cumsum(n_words) - n_words, n_pairs)
        half = _numbers(words, self.pair_words)
        a, b = half[firsts.to_numpy() + shift], half[seconds.to_numpy() + shift]
        key = a * len(self.pair_words) + b
        place = np.minimum(np.searchsorted(self.pair_keys, key), max(0, len(self.pair_keys) - 1))
        two = (a >= 0) & (b >= 0) & (self.pair_keys[place] == key) if len(self.pair_keys) else np.zeros(len(a), bool)
        document = np.concatenate([np.repeat(document, n_words)[one], np.repeat(document, n_pairs)[two]])
        term = np.concatenate([term[one], self.pair_terms[place[two]] if two.any() else np.empty(0, np.int64)])
        raw = np.concatenate([counts.to_numpy()[one], pair_counts.to_numpy()[two]]) * self.idf[term]
        norm = np.sqrt(np.bincount(document, raw * raw, batch.num_rows))
        order = np.argsort(self.rank[term], kind="stable")
        document, term, raw = document[order], term[order], raw[order]
        columns = [batch.column(0).take(pa.array(document)), self.terms.take(pa.array(term)), pa.array(raw / norm[document])]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "term", "w"])


def unit_rows(counted: DataFrame, vocab: DataFrame) -> DataFrame:
    """(doc_id, term, w): tf * idf of the vocabulary's terms, each document's row at unit length.

    ``vocab`` (term, idf) has a fixed cap and goes to every task.
    """
    table = vocab.select("term", "idf").toArrow()
    shared = counted.sparkSession.sparkContext.broadcast((table.column("term").combine_chunks(), table.column("idf").to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = VocabularyRows(*shared.value)
        for batch in batches:
            for low in range(0, batch.num_rows, DOCUMENTS):
                yield found.rows(batch.slice(low, DOCUMENTS))

    columns = ["doc_id", "words", "counts", "firsts", "seconds", "pair_counts"]
    return counted.select(columns).mapInArrow(run, "doc_id bigint, term string, w double")
