"""Language of texts by a linear-chain conditional random field over their words.

A word has features: itself (a lexicon of the sample's words), its affixes and the n-grams of its letters. A
run longer than ``WORD_CHARS`` counts as consecutive words of that length, so scripts without spaces are read whole. Emission
weights and transitions between languages are learned together, on chains that switch language: snippets of labelled
documents set one after the other. A text is cut into chains of ``CHAIN`` words; forward-backward gives each word its
share of every language, and a text gets the language with the largest mean share.

Labels are learned from about ``SAMPLE_DOCS`` documents of each labelled language, taken by a hash of their id; every whole text
is labelled.

Defined results: ``und`` with score 0 if the text is null or has no letter, or if nothing could be learned. Ties go to
the first language in alphabetical order. Rows with the same id are labelled each for itself. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain as joined
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Documents of each language to learn from, and words taken from a document in snippets.
SAMPLE_DOCS, SNIPPETS, SNIPPET = 250, 6, 12
CHAIN = 32
WORD_CHARS = 40
# With more languages than these, fewer words are held at a time.
FULL_BATCH_LANGUAGES = 64
BATCH_WORDS = 200_000
REMEMBERED_WORDS = 300_000
EPOCHS, RATE, MIN_COUNT = 12, 0.15, 2
UNDETERMINED = "und"
LETTER = re.compile(r"[^\W\d_]")


def words_of(text: str) -> Iterator[str]:
    for run in text.split():
        if len(run) <= WORD_CHARS:
            yield run
        else:
            yield from (run[i : i + WORD_CHARS] for i in range(0, len(run), WORD_CHARS))


def word_features(word: str) -> set[str]:
    """Lexicon entry, affixes of up to three letters, n-grams of two and three letters."""
    w = word.strip("\"'.,;:!?()[]{}|*#$%&<>-_").lower()
    if not w or not LETTER.search(w):
        return set()
    out = {"=" + w}
    for n in (1, 2, 3):
        out.add("^" + w[:n])
        out.add(w[-n:] + "$")
    out.update(w[i : i + n] for n in (2, 3) for i in range(len(w) - n + 1))
    return out


def forward_backward(scores: np.ndarray, step: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Shares (chains x words x languages) from emission scores; words past a chain's length have no meaning.

    ``step`` and ``start`` are probabilities' like weights, not logarithms. All chains go side by side.
    """
    n, t, k = scores.shape
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    e[np.arange(t)[None, :] >= lengths[:, None]] = 1.0
    alpha = np.empty_like(e)
    a = start * e[:, 0]
    alpha[:, 0] = a / a.sum(1, keepdims=True)
    for i in range(1, t):
        a = (alpha[:, i - 1] @ step) * e[:, i]
        alpha[:, i] = a / a.sum(1, keepdims=True)
    beta = np.ones((n, k), e.dtype)
    for i in range(t - 2, -1, -1):
        # Past the end of a chain nothing is known, so beta stays 1 there.
        b = (beta * e[:, i + 1]) @ step.T
        b /= b.sum(1, keepdims=True)
        beta = np.where((i + 1 < lengths)[:, None], b, 1.0).astype(e.dtype)
        alpha[:, i] *= beta
        alpha[:, i] /= alpha[:, i].sum(1, keepdims=True)
    return alpha


class Crf:
    def __init__(self, languages: list[str]):
        self.languages = languages
        self.vocabulary: dict[str, int] = {}
        k = len(languages)
        self.weights, self.step, self.start = np.zeros((1, k), np.float32), np.zeros((k, k)), np.zeros(k)

    def rows(self, word: str) -> list[int]:
        return [i for f in word_features(word) if (i := self.vocabulary.get(f)) is not None]

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of each word, one row of weights after the other added up."""
        lists = [self.rows(w) for w in words]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter(joined.from_iterable(lists), np.int64, int(sizes.sum()))
        out = np.zeros((len(words), len(self.languages)), np.float32)
        filled = sizes > 0
        if len(flat):
            out[filled] = np.add.reduceat(self.weights[flat], (np.cumsum(sizes) - sizes)[filled], axis=0)
        return out

    def fit(self, texts: list[list[tuple[list[str], int]]], seed: int = 7) -> Crf:
        """``texts``: snippets (words, language number) of each document."""
        counts: dict[str, int] = {}
        snippets = [s for t in texts for s in t if s[0]]
        for words, _ in snippets:
            for w in words:
                for f in word_features(w):
                    counts[f] = counts.get(f, 0) + 1
        self.vocabulary = {f: i for i, f in enumerate(sorted(f for f, c in counts.items() if c >= MIN_COUNT))}
        k, v = len(self.languages), len(self.vocabulary)
        self.weights = np.zeros((v, k), np.float32)
        if not v:
            return self
        rng = np.random.default_rng(seed)
        squares = np.full((v, k), 1e-3, np.float32)
        step_squares, start_squares = np.full((k, k), 1e-3), np.full(k, 1e-3)
        known = {w: self.rows(w) for words, _ in snippets for w in words}
        t = 3 * SNIPPET
        for _ in range(EPOCHS):
            order = rng.permutation(len(snippets))
            chains = [order[i : i + 3] for i in range(0, len(order), 3)]
            for begin in range(0, len(chains), 128):
                some = chains[begin : begin + 128]
                words = [[w for s in c for w in snippets[s][0]] for c in some]
                gold = [[snippets[s][1] for s in c for _ in snippets[s][0]] for c in some]
                lengths = np.array([len(w) for w in words])
                lists = [known[w] for ws in words for w in ws]
                sizes = np.array([len(x) for x in lists])
                flat = np.fromiter(joined.from_iterable(lists), np.int64, int(sizes.sum()))
                owner = np.repeat(np.arange(len(lists)), sizes)
                em = np.zeros((len(lists), k))
                np.add.at(em, owner, self.weights[flat])
                at = (np.repeat(np.arange(len(some)), lengths), np.concatenate([np.arange(n) for n in lengths]))
                scores = np.zeros((len(some), t, k))
                scores[at] = em
                shares = forward_backward(scores, np.exp(self.step), np.exp(self.start), lengths)
                truth = np.zeros_like(shares)
                truth[(*at, np.concatenate(gold))] = 1
                error = (truth - shares)[at]
                grad = np.zeros((v, k), np.float32)
                np.add.at(grad, flat, error[owner].astype(np.float32))
                grad /= len(some)
                squares += grad**2
                self.weights += RATE * grad / np.sqrt(squares)
                # Expected transitions from neighbouring shares, the usual pairwise marginals of the chain.
                e = np.exp(scores - scores.max(2, keepdims=True))
                inside = np.arange(1, t)[None, :] < lengths[:, None]
                step, left, right = np.exp(self.step), shares[:, :-1][inside], (shares[:, 1:] * e[:, 1:])[inside]
                pair = step * ((left / ((left @ step) * right).sum(1, keepdims=True)).T @ right)
                gs = (np.einsum("nti,ntj->ij", truth[:, :-1] * inside[..., None], truth[:, 1:]) - pair) / len(some)
                step_squares += gs**2
                self.step += RATE * gs / np.sqrt(step_squares)
                gb = (truth[:, 0] - shares[:, 0]).mean(0)
                start_squares += gb**2
                self.start += RATE * gb / np.sqrt(start_squares)
        return self


class Labeller:
    """Labels of texts; emission scores of words are remembered up to a bound."""

    def __init__(self, model: Crf):
        self.model, self.row = model, {}
        share = min(1.0, FULL_BATCH_LANGUAGES / max(1, len(model.languages)))
        self.batch, self.remembered = int(BATCH_WORDS * share), int(REMEMBERED_WORDS * share)
        self.table = np.zeros((0, len(model.languages)), np.float32)
        self.step, self.start = np.exp(model.step).astype(np.float32), np.exp(model.start).astype(np.float32)

    def scores(self, words: list[str]) -> np.ndarray:
        if len(self.row) > self.remembered:
            self.row, self.table = {}, self.table[:0]
        if new := [w for w in dict.fromkeys(words) if w not in self.row]:
            self.row.update(zip(new, range(len(self.row), len(self.row) + len(new)), strict=True))
            self.table = np.concatenate([self.table, self.model.emissions(new)])
        return self.table[np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))]

    def shares(self, words: list[str], lengths: np.ndarray) -> np.ndarray:
        """Sum of the shares of each chain's words."""
        k = len(self.model.languages)
        padded = np.zeros((len(lengths), CHAIN, k), np.float32)
        inside = np.arange(CHAIN)[None, :] < lengths[:, None]
        padded[inside] = self.scores(words)
        found = forward_backward(padded, self.step, self.start, lengths)
        # A word without any known feature says nothing.
        known = inside & (np.abs(padded).sum(2) > 0)
        return (found * known[..., None]).sum(1)

    def texts(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.model.vocabulary:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        totals = np.zeros((len(texts), len(self.model.languages)))
        words: list[str] = []
        lengths: list[int] = []
        owners: list[int] = []

        def put() -> None:
            if lengths:
                np.add.at(totals, owners, self.shares(words, np.array(lengths)))
                words.clear(), lengths.clear(), owners.clear()

        for i, text in enumerate(texts):
            of = words_of(text or "")
            while part := list(islice(of, CHAIN)):
                words += part
                lengths.append(len(part))
                owners.append(i)
                if len(words) >= self.batch:
                    put()
        put()
        sums = totals.sum(1)
        best = totals.argmax(1)
        labels, scores = [], []
        for i, text in enumerate(texts):
            if not text or not LETTER.search(text):
                labels.append(UNDETERMINED)
                scores.append(0.0)
            else:
                labels.append(self.model.languages[best[i]])
                scores.append(min(1.0, float(totals[i, best[i]] / sums[i])) if sums[i] else 1 / len(self.model.languages))
        return labels, scores


def train(documents: DataFrame, learn: Column, docs: int = SAMPLE_DOCS) -> Crf:
    """Fit on about ``docs`` documents of each language."""
    known = documents.filter(learn).filter("lang is not null and text is not null")
    counts = known.groupBy("lang").count().collect()
    languages = sorted(r["lang"] for r in counts)
    model = Crf(languages)
    if not languages:
        return model
    shares = documents.sparkSession.createDataFrame([(r["lang"], 1.5 * docs / r["count"]) for r in counts], "lang string, share double")
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    rows = known.join(F.broadcast(shares), "lang").filter(drawn < F.col("share")).select("lang", "text", drawn.alias("drawn"))

    def snippets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1):
                words = list(words_of(text.as_py()))
                starts = range(0, len(words), max(SNIPPET, len(words) // SNIPPETS))
                out.append([" ".join(words[s : s + SNIPPET]) for s in islice(starts, SNIPPETS)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string())), batch.column(2)], names=["lang", "snippets", "drawn"])

    found = rows.mapInArrow(snippets, "lang string, snippets array<string>, drawn double").collect()
    number = {lang: i for i, lang in enumerate(languages)}
    taken = {lang: 0 for lang in languages}
    texts = []
    for r in sorted(found, key=lambda r: (r["drawn"], r["lang"], r["snippets"])):
        if taken[r["lang"]] < docs:
            taken[r["lang"]] += 1
            texts.append([(s.split(), number[r["lang"]]) for s in r["snippets"]])
    return model.fit(texts)


def labelled(documents: DataFrame, model: Crf) -> DataFrame:
    """The rows of ``documents`` with ``lang_pred`` and ``score``."""
    rows = documents.drop("lang_pred", "score")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", lang_pred string, score double"
    sent, names, at = documents.sparkSession.sparkContext.broadcast(model), rows.columns, rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(sent.value)
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                labels, scores = labeller.texts(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"])

    return rows.mapInArrow(run, schema)
