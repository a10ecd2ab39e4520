"""Quality classifier: a generalised additive model with pairwise interactions.

Each text gives a row of numbers (``FEATURES``). Cyclic boosting fits a shallow tree on one feature's bins after the
other and adds it to that feature's table; then the pairs with most left to explain get tables of their own. A score is
the intercept plus one table value for each feature and pair, through the logistic function.

Labels are learned from at most ``SAMPLE_ROWS`` labelled rows, taken by a hash of their id; features are worked out,
and scores given, for all texts.

Defined results: a null text is an empty one; empty texts get the score of their features like any other. A document
labelled more than once counts with its highest label. Without labels of both kinds every score is the share of label
1, or 0.5 without any. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import materialise

SAMPLE_ROWS = 20_000
BINS, PAIR_BINS = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS = 150, 60, 6
RATE, RIDGE = 0.15, 2.0

FEATURES = (
    "log_chars", "log_words", "word_chars", "upper", "digit", "mark", "symbol", "bar", "exclaim", "stop",
    "distinct_words", "line_chars", "distinct_lines", "non_ascii", "marked_words", "worst_part",
)

# Classes of bytes: letters in upper case, digits, sentence marks, other signs, the bar, exclamation, full stop, non-ASCII.
_CLASS = np.zeros(256, np.uint8)
for _i, _signs in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b",;:?\"'()-", b"#$%&*+/<=>@[\\]^_`{}~", b"|", b"!", b"."), 1):
    _CLASS[list(_signs)] = _i
_CLASS[128:] = 8
# A text is also looked at in this many parts, for signs that gather in one of them.
_PARTS = 8


def features(text: str) -> tuple[float, ...]:
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    kinds = _CLASS[data]
    counts = np.bincount(kinds, minlength=9) / max(1, len(data))
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    odd = (kinds == 4) | (kinds == 5) | (kinds == 6) | (kinds == 1)
    edges = np.linspace(0, len(data), _PARTS + 1).astype(int)
    sums = np.concatenate([[0], np.cumsum(odd, dtype=np.int64)])
    parts = (sums[edges[1:]] - sums[edges[:-1]]) / np.maximum(1, np.diff(edges))
    return (
        np.log1p(len(text)), np.log1p(len(words)), len(text) / n, *counts[1:7], counts[7],
        len(set(words)) / n, np.log1p(len(text) / len(lines)), len(set(lines)) / len(lines), counts[8],
        float(odd.sum()) / n, float(parts.max()),
    )


def measured(documents: DataFrame) -> DataFrame:
    """(doc_id, x array<float>)."""
    schema = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t.as_py() or "") for t in batch.column(1)]
            x = pa.array(np.array(rows, np.float32).reshape(len(rows), len(FEATURES)).tolist(), schema.types[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), x], schema=schema)

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, x array<float>")


def _steps(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The leaf values of a tree of depth two on one axis, over bins with gradients g and weights h."""
    out = np.zeros(len(g))

    def split(a: int, b: int, depth: int) -> None:
        if depth and b - a > 1:
            gs, hs = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            gr, hr = g[a:b].sum() - gs, h[a:b].sum() - hs
            gain = gs**2 / (hs + RIDGE) + gr**2 / (hr + RIDGE)
            at = a + 1 + int(np.argmax(gain))
            split(a, at, depth - 1)
            split(at, b, depth - 1)
        else:
            out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)

    split(0, len(g), 2)
    return out


def _squares(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """One cut on each axis: the values of the four parts, and how much they explain."""
    gs, hs = (np.pad(a, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for a in (g, h))
    G, H = gs[-1, -1], hs[-1, -1]
    part = lambda s, total: (s, s[:, -1:] - s, s[-1:, :] - s, total - s[:, -1:] - s[-1:, :] + s)
    gain = sum(a**2 / (b + RIDGE) for a, b in zip(part(gs, G), part(hs, H), strict=True))
    i, j = np.unravel_index(np.argmax(gain), gain.shape)
    out = np.zeros_like(g)
    for rows in (slice(0, i), slice(i, None)):
        for cols in (slice(0, j), slice(j, None)):
            out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + RIDGE)
    return out, float(gain[i, j] - G**2 / (H + RIDGE))


class AdditiveModel:
    """Tables of one and of two features, and the edges of their bins."""

    def __init__(self):
        self.intercept, self.edges, self.tables, self.pairs = 0.0, [], [], []

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])] if len(x) else []
        share = y.mean() if len(y) else 0.5
        if share in (0.0, 1.0) or not len(y):
            self.intercept = float(np.log((share + 1e-9) / (1 - share + 1e-9)))
            self.edges, self.tables = [], []
            return self
        self.intercept = float(np.log(share / (1 - share)))
        b = self.bins(x)
        sizes = [len(e) + 1 for e in self.edges]
        self.tables = [np.zeros(n) for n in sizes]
        z = np.full(len(y), self.intercept)
        for _ in range(ROUNDS):
            for f, n in enumerate(sizes):
                p = 1 / (1 + np.exp(-z))
                step = RATE * _steps(np.bincount(b[:, f], y - p, n), np.bincount(b[:, f], p * (1 - p), n))
                self.tables[f] += step
                z += step[b[:, f]]
        coarse = b * PAIR_BINS // np.array(sizes)

        def grid(f: int, g: int, w: np.ndarray) -> np.ndarray:
            return np.bincount(coarse[:, f] * PAIR_BINS + coarse[:, g], w, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)

        p = 1 / (1 + np.exp(-z))
        pairs = [(f, g) for f in range(len(sizes)) for g in range(f)]
        gains = [_squares(grid(f, g, y - p), grid(f, g, p * (1 - p)))[1] for f, g in pairs]
        self.pairs = [(*pairs[i], np.zeros((PAIR_BINS, PAIR_BINS))) for i in np.argsort(gains)[::-1][:PAIRS]]
        for _ in range(PAIR_ROUNDS):
            for f, g, table in self.pairs:
                p = 1 / (1 + np.exp(-z))
                step = RATE * _squares(grid(f, g, y - p), grid(f, g, p * (1 - p)))[0]
                table += step
                z += step[coarse[:, f], coarse[:, g]]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        if self.tables:
            b = self.bins(x)
            for f, table in enumerate(self.tables):
                z += table[b[:, f]]
            coarse = b * PAIR_BINS // np.array([len(t) for t in self.tables])
            for f, g, table in self.pairs:
                z += table[coarse[:, f], coarse[:, g]]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def train(rows: DataFrame, labels: DataFrame, learn: Column, sample_rows: int = SAMPLE_ROWS) -> AdditiveModel:
    """Fit on at most ``sample_rows`` labelled rows of ``rows`` (doc_id, x), those with the smallest hashes."""
    marked = labels.filter("quality is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("quality").alias("y"))
    known = rows.filter(learn).join(marked, "doc_id")
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).select("x", "y").toArrow()
    x = np.array(sample.column("x").to_pylist(), np.float64).reshape(-1, len(FEATURES))
    return AdditiveModel().fit(x, (sample.column("y").to_numpy() > 0).astype(np.float64))


def scored(documents: DataFrame, labels: DataFrame, learn: Column, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, score) of every document."""
    rows = materialise(measured(documents), "features")
    model = train(rows, labels, learn, sample_rows)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().astype(np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], schema=schema)

    return rows.mapInArrow(run, "doc_id bigint, score double")
