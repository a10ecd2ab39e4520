"""Keeping the best documents of many queries inside one task."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa

from ..functions.scores import SCALE

# Scores computed at once inside a task (16 MB of doubles).
SCORE_CELLS = 2_000_000


# Candidates that wait before they are merged with what is known.
WAITING = 200_000


class TaskBest:
    """The k best (score, lower id first) documents of each query among those seen by one task.

    Candidates wait until there are about as many as known rows, so that a merge costs in proportion to what it takes in.
    """

    def __init__(self, n_queries: int, k: int, floor: float | np.ndarray = -np.inf):
        self.k = k
        self.query = np.empty(0, dtype=np.int64)
        self.doc = np.empty(0, dtype=np.int64)
        self.score = np.empty(0)
        self.floor = np.full(n_queries, floor)
        self._waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._n_waiting = 0

    def add(self, ids: np.ndarray, scores: np.ndarray, queries: np.ndarray | None = None) -> None:
        """Take in a block of scores, documents x queries; ``queries`` are the columns' numbers, if not all of them."""
        floor = self.floor if queries is None else self.floor[queries]
        many = False
        # A score just below the floor can be rounded up to it.
        hits = scores >= floor - 1 / SCALE
        if len(ids) > self.k and np.count_nonzero(hits) > 2 * self.k * scores.shape[1]:
            many = True
            cut = len(ids) - self.k
            # Numbers only: a score that is none takes no place.
            hits &= scores >= np.partition(np.where(np.isnan(scores), -np.inf, scores), cut, axis=0)[cut] - 1 / SCALE
        doc, query = np.nonzero(hits)
        self.take(query if queries is None else queries[query], ids[doc], scores[doc, query])
        if many:
            self.merge()  # better floors from here on

    def take(self, query: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        """Take in scores of single documents."""
        score = np.rint(score * SCALE) / SCALE
        kept = score >= self.floor[query]
        if not kept.any():
            return
        self._waiting.append((query[kept], doc[kept], score[kept]))
        self._n_waiting += int(kept.sum())
        if self._n_waiting > max(WAITING, len(self.query)):
            self.merge()

    def merge(self) -> None:
        """Rank what is known and what has waited."""
        if not self._waiting:
            return
        held = [(self.query, self.doc, self.score), *self._waiting]
        query, doc, score = (np.concatenate(c) for c in zip(*held, strict=True))
        self._waiting, self._n_waiting = [], 0
        order = np.lexsort((doc, -score, query))
        query, doc, score = query[order], doc[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query, side="left")
        last = place == self.k - 1
        self.floor[query[last]] = score[last]
        keep = place < self.k
        self.query, self.doc, self.score = query[keep], doc[keep], score[keep]

    def table(self, query_ids: pa.Array, names: list[str]) -> pa.Table:
        self.merge()
        return pa.table(
            [query_ids.take(pa.array(self.query)), pa.array(self.doc), pa.array(self.score)], names=names
        )


def matrix_of(lists: pa.Array | pa.ChunkedArray, dimension: int) -> np.ndarray:
    flat = lists.flatten() if isinstance(lists, pa.Array) else pa.chunked_array(lists.chunks).combine_chunks().flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    if values.size != len(lists) * dimension:
        raise ValueError("vectors of different dimensions")
    return values.reshape(len(lists), dimension)


def search_rows(
    batches: Iterable[tuple[np.ndarray, pa.Array | pa.ChunkedArray]],
    queries: np.ndarray,
    k: int,
    floor: float | np.ndarray = -np.inf,
) -> TaskBest:
    """The k best documents of each query among those of the batches (ids, vectors)."""
    found = TaskBest(len(queries), k, floor)
    rows = max(1, SCORE_CELLS // max(1, len(queries)))
    for ids, lists in batches:
        for start in range(0, len(ids), rows):
            matrix = matrix_of(lists.slice(start, rows), queries.shape[1])
            found.add(ids[start : start + rows], matrix @ queries.T)
    return found
