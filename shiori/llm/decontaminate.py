"""Benchmark decontamination: BM25 over test items with block-max WAND, then verification of question and answer.

The test items form an inverted index, sent to every task; items come in blocks of at most ``INDEX_BYTES`` of text, so
what is sent is bounded however many items there are. Counts and mean lengths are those of all items, whatever the blocks.

Passages. Items are indexed by size, those of up to 16, 32, 64, ... words each in an index of their own. Every passage of
every text is a query: windows of twice that size, half of it further each time, so that each stretch of an item's length
lies whole in some window.

What counts. The first half of an item's words is taken as its question, the second as its answer. A passage holds an item
if it has ``OVERLAP`` of the distinct five-word shingles of either half, or ``WHOLE`` of those of the whole item, so that
excerpts from its middle count too. Items with a half under five words are held by ``OVERLAP`` of the whole item's shingles.

Retrieval. Each item has its own threshold: the least BM25 mass of any passage that verification would accept, found by
a small dynamic programme over the shingles that such a passage may lack. Impacts are stored over that threshold, so one
floor, 1, serves all items. Terms of a window are taken from the lightest on while their maxima stay below the floor together;
an item without any of the heavier ones can't reach it (the pivot). Blocks of ``BLOCK`` items that the heavier terms touch
are held against the sum of block maxima, and only items of blocks that reach the floor are scored. What is retrieved is verified.

Defined results: null and empty texts are clean. Items without words are left out; items under five words count as one
shingle. Equal items are found each for itself. Rows with the same id are searched each for itself. Other columns stay.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import materialise

K1, B = 1.2, 0.75
BLOCK = 16
OVERLAP, WHOLE, WORDS = 0.8, 0.5, 5
INDEX_BYTES = 4 << 20
# Least size of an index's windows, and the words of texts that are searched at once.
LEAST_SIZE, CHUNK_WORDS = 16, 60_000
# Scores and thresholds are sums in different orders.
NEARLY = 1 - 1e-6
WORD = re.compile(r"\w+")
MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def rolled(numbers: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each ``k`` consecutive word numbers."""
    n = max(0, len(numbers) - k + 1)
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = (out ^ (numbers[i : i + n].astype(np.uint64) + np.uint64(1))) * MIX
        out ^= out >> np.uint64(29)
    return out


def scopes(n: int) -> list[tuple[int, int, float]]:
    """(start, end, share) of the parts of an item of ``n`` words; a passage with that share of one part's shingles holds it."""
    half = n // 2
    if half < WORDS:
        return [(0, n, OVERLAP)]
    return [(0, half, OVERLAP), (half, n, OVERLAP), (0, n, WHOLE)]


def heaviest_loss(weights: np.ndarray, drops: int, k: int) -> float:
    """Most weight that can go uncovered if ``drops`` of the runs of ``k`` consecutive positions are left out.

    A gap at either end of length g takes g of them, one inside takes g + k - 1.
    """
    n = len(weights)
    if drops <= 0:
        return 0.0
    before = np.concatenate([[0.0], np.cumsum(weights)])
    closed, inside = np.zeros(drops + 1), np.full(drops + 1, -np.inf)
    best = 0.0
    for i in range(n + 1):
        if i <= drops:
            closed[i:] = np.maximum(closed[i:], before[i])
        np.maximum(closed, inside, out=closed)
        if n - i <= drops:
            best = max(best, closed[drops - (n - i)] + before[n] - before[i])
        if i < n:
            grown = np.full(drops + 1, -np.inf)
            grown[1:] = inside[:-1]
            if k <= drops:
                grown[k:] = np.maximum(grown[k:], closed[: drops + 1 - k])
            inside = grown + weights[i]
    return float(best)


class Sized:
    """The items of one size: normalised postings, block maxima, shingles."""

    def __init__(self, size: int, items: list[tuple[int, list[str]]], number: dict[str, int], idf: np.ndarray, mean: float):
        self.size, self.ids = size, [i for i, _ in items]
        self.parts: list[list[tuple[int, float, np.ndarray]]] = []
        item_of, term_of, impact_of = [], [], []
        for n, (_, words) in enumerate(items):
            numbers = np.array([number[w] for w in words], np.int64)
            terms, place, tf = np.unique(numbers, return_inverse=True, return_counts=True)
            impact = idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean))
            parts, least = [], np.inf
            for start, end, share in scopes(len(words)):
                k = min(WORDS, end - start)
                distinct, copies = np.unique(rolled(numbers[start:end], k), return_counts=True)
                parts.append((k, share, distinct))
                # Shingles that an accepted passage may lack, and the places they stand at.
                lack = int(len(distinct) * (1 - share) + 1e-9)
                drops = int(np.sort(copies)[len(copies) - lack :].sum()) if lack else 0
                here, at, times = np.unique(place[start:end], return_inverse=True, return_counts=True)
                mass = impact[here].sum()
                least = min(least, mass - heaviest_loss((impact[here] / times)[at], drops, k))
            self.parts.append(parts)
            item_of.append(np.full(len(terms), n))
            term_of.append(terms)
            # A threshold near 0 retrieves whatever shares a term.
            impact_of.append(impact / max(least, 1e-9 * impact.sum()))
        item, term, impact = np.concatenate(item_of), np.concatenate(term_of), np.concatenate(impact_of)
        order = np.lexsort((item, term))
        self.item, self.impact, term = item[order], impact[order], term[order]
        self.blocks = -(-len(items) // BLOCK)
        # One entry for each block of each term: its key, where its postings start, the largest impact.
        key = term * self.blocks + self.item // BLOCK
        self.key, first = np.unique(key, return_index=True)
        self.first = np.append(first, len(key))
        self.block_max = np.maximum.reduceat(self.impact, first)
        n_terms = len(number)
        self.term_first = np.searchsorted(self.key, np.arange(n_terms + 1) * self.blocks)
        self.top = np.zeros(n_terms)
        np.maximum.at(self.top, self.key // self.blocks, self.block_max)

    def retrieve(self, window: np.ndarray, term: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of the items that reach their threshold; (window, term) are distinct, by window, of ``n`` windows."""
        none = np.empty(0, np.int64)
        # Windows whose terms can't reach the floor together are passed over.
        known = (self.top[term] > 0) & (np.bincount(window, self.top[term], minlength=n) >= NEARLY)[window]
        window, term = window[known], term[known]
        if not len(window):
            return none, none
        order = np.lexsort((self.top[term], window))
        window, term = window[order], term[order]
        top = self.top[term]
        total = np.cumsum(top)
        size = np.bincount(window, minlength=n)
        start = (np.cumsum(size) - size)[window]
        sums = total - total[start] + top[start]
        heavy = sums >= NEARLY
        if not heavy.any():
            return none, none
        light = np.bincount(window[~heavy], top[~heavy], minlength=n)
        # Blocks touched by heavy terms, with room for all light ones.
        entry, owner = _spread(self.term_first[term[heavy]], self.term_first[term[heavy] + 1])
        pair = window[heavy][owner] * self.blocks + self.key[entry] % self.blocks
        pairs, at = np.unique(pair, return_inverse=True)
        reach = np.bincount(at, self.block_max[entry]) + light[pairs // self.blocks]
        pairs = pairs[reach >= NEARLY]
        if not len(pairs):
            return none, none
        # Those blocks with all terms of their windows: sums of block maxima, then of the items themselves.
        last = np.cumsum(size)[pairs // self.blocks]
        place, owner = _spread(last - size[pairs // self.blocks], last)
        wanted = term[place] * self.blocks + pairs[owner] % self.blocks
        entry = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
        there = self.key[entry] == wanted
        entry, owner = entry[there], owner[there]
        enough = np.bincount(owner, self.block_max[entry], minlength=len(pairs)) >= NEARLY
        entry, owner = entry[enough[owner]], owner[enough[owner]]
        posting, of = _spread(self.first[entry], self.first[entry + 1])
        found = (pairs[owner[of]] // self.blocks) * len(self.ids) + self.item[posting]
        found, at = np.unique(found, return_inverse=True)
        found = found[np.bincount(at, self.impact[posting], minlength=len(found)) >= NEARLY]
        return found // len(self.ids), found % len(self.ids)

    def holds(self, item: int, numbers: np.ndarray) -> bool:
        """Whether a passage of these words has the wanted share of some part's shingles."""
        hashes: dict[int, np.ndarray] = {}
        for k, share, wanted in self.parts[item]:
            have = hashes[k] if k in hashes else hashes.setdefault(k, rolled(numbers, k))
            if np.isin(wanted, have).sum() >= share * len(wanted) - 1e-9:
                return True
        return False


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges first..last, and the range that each belongs to."""
    size = last - first
    owner = np.repeat(np.arange(len(size)), size)
    return np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size), owner


def windows(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, over all texts one behind the other, of windows of twice ``size``, ``size`` further each time."""
    begin = np.cumsum(lengths) - lengths
    count = np.where(lengths > 0, np.maximum(1, -(-lengths // size) - 1), 0)
    step, owner = _spread(np.zeros_like(count), count)
    starts = begin[owner] + step * size
    return starts, np.minimum(starts + 2 * size, (begin + lengths)[owner])


class Index:
    """Test items by size. ``df``, ``total`` and ``mean`` are those of all items; by default of the given ones."""

    def __init__(self, items: Iterable[tuple[int, str]], df: dict[str, int] | None = None, total: int = 0, mean: float = 0.0):
        found = [(i, words_of(t)) for i, t in sorted(items)]
        found = [(i, w) for i, w in found if w]
        if df is None:
            df, total = Counter(t for _, w in found for t in set(w)), len(found)
            mean = sum(len(w) for _, w in found) / max(1, len(found))
        # The last number stands for all words that no item holds.
        self.number = {t: k for k, t in enumerate(sorted({t for _, w in found for t in w}))}
        seen = np.array([df[t] for t in self.number], float)
        idf = np.log1p((total - seen + 0.5) / (seen + 0.5))
        by_size: dict[int, list[tuple[int, list[str]]]] = {}
        for i, w in found:
            by_size.setdefault(max(LEAST_SIZE, 1 << (len(w) - 1).bit_length()), []).append((i, w))
        self.none = len(self.number)
        numbers = self.number | {"": self.none}
        self.sized = [Sized(size, part, numbers, np.append(idf, 0.0), mean) for size, part in sorted(by_size.items())]

    def matches(self, texts: list[str]) -> list[list[int]]:
        """Ids of the items that each text holds, in order."""
        out: list[set[int]] = [set() for _ in texts]
        held: list[tuple[int, np.ndarray]] = []
        total = 0
        for n, text in enumerate(texts):
            words = words_of(text)
            numbers = np.fromiter(map(self.number.get, words, repeat(self.none)), np.int64, len(words))
            held.append((n, numbers))
            total += len(numbers)
            if total >= CHUNK_WORDS:
                self._search(held, out)
                held, total = [], 0
        self._search(held, out)
        return [sorted(x) for x in out]

    def _search(self, held: list[tuple[int, np.ndarray]], out: list[set[int]]) -> None:
        if not held:
            return
        numbers = np.concatenate([x for _, x in held])
        lengths = np.array([len(x) for _, x in held])
        ends_of = np.cumsum(lengths)
        # Where each word stood last, so that a window counts its words once.
        order = np.argsort(numbers, kind="stable")
        before = np.full(len(numbers), -1)
        same = numbers[order[1:]] == numbers[order[:-1]]
        before[order[1:][same]] = order[:-1][same]
        for sized in self.sized:
            starts, ends = windows(lengths, sized.size)
            mass = np.concatenate([[0.0], np.cumsum(sized.top[numbers])])
            may = mass[ends] - mass[starts] >= NEARLY
            starts, ends = starts[may], ends[may]
            # A very long text's windows are taken some at a time.
            per = max(1, CHUNK_WORDS // sized.size)
            for a in range(0, len(starts), per):
                s, e = starts[a : a + per], ends[a : a + per]
                place, owner = _spread(s, e)
                once = before[place] < s[owner]
                w, items = sized.retrieve(owner[once], numbers[place[once]], len(s))
                for x, item in zip(w.tolist(), items.tolist(), strict=True):
                    into = out[held[int(np.searchsorted(ends_of, s[x], side="right"))][0]]
                    if sized.ids[item] not in into and sized.holds(item, numbers[s[x] : e[x]]):
                        into.add(sized.ids[item])


def _terms(items: DataFrame) -> DataFrame:
    """(block, term, size): distinct terms of each item, and a row with null term and its number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, terms, sizes = [], [], []
            for block, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(text.as_py())
                own = [None, *sorted(set(words))] if words else []
                blocks += [block] * len(own)
                terms += own
                sizes += [len(words)] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(terms, pa.string()), pa.array(sizes, pa.int64())], names=["block", "term", "size"])

    return items.select("block", "text").mapInArrow(run, "block bigint, term string, size bigint")


def indexes(items: DataFrame, index_bytes: int = INDEX_BYTES) -> Iterator[Index]:
    """Indexes of the test items, a bounded block at a time, with the counts of all items."""
    rows = items.filter("item_id is not null and text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // index_bytes))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    terms = materialise(_terms(rows), "item-terms")
    count, words = terms.filter("term is null").agg(F.count("*"), F.sum("size")).first()
    if not count:
        return
    df = terms.filter("term is not null").groupBy("term").agg(F.count("*").alias("df"))
    if n > 1:
        df = materialise(df, "item-term-counts")
    for k in range(n):
        block = [(r[0], r[1]) for r in rows.filter(F.col("block") == k).select("item_id", "text").collect()]
        own = terms.filter((F.col("block") == k) & F.col("term").isNotNull()).select("term").distinct()
        counts = {r[0]: r[1] for r in df.join(own, "term").collect()}
        yield Index(block, counts, count, words / count)


def decontaminated(documents: DataFrame, items: DataFrame, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """The rows of ``documents`` with ``item_ids``: the test items that each text holds, none if it is clean."""
    rows = documents.drop("item_ids") if "item_ids" in documents.columns else documents
    names = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", item_ids array<bigint>"
    out = rows.withColumn("item_ids", F.array().cast("array<bigint>"))
    for index in indexes(items, index_bytes):
        sent = documents.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            at = names.index("text")
            for batch in batches:
                before = batch.column(len(names)).to_pylist()
                found = sent.value.matches([t or "" for t in batch.column(at).to_pylist()])
                found = [sorted({*b, *x}) for b, x in zip(before, found, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(pa.int64()))], names=[*names, "item_ids"])

        out = out.mapInArrow(run, schema)
    return out
