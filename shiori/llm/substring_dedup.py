"""Removal of repeated passages: windows of words that also start in a document with a smaller id.

Every window of ``window`` consecutive words is assigned the least of the word runs of ``ANCHOR`` words inside it (by a mixed hash),
its anchor; windows with equal words have equal anchors at equal places. Neighbouring windows with one anchor are a piece of a
document, so there is about one piece per dozen words, and only pieces whose anchor lies in two documents or more are
looked at further. Of pieces with equal words one stands for all, with the smallest id of their documents.

Pieces are dealt by anchor to shards of bounded size. A shard holds a compressed index of its pieces: the
Burrows-Wheeler transform in a wavelet matrix of bit vectors with block counts, and for each suffix the document it comes from. The pieces
are then streamed backwards through it, all of a shard in step: each word takes one backward extension, so that the matching
statistic, cut at the threshold, is known at each place; a match that reaches the threshold is reported with the smallest document in its interval and
gives up its last word before it goes on. An anchor with more than ``HOT_PIECES`` different pieces (a common passage in
changing surroundings) is not put into one shard: its windows get longer anchors, cut to the left or to the right of the old
one, which differ wherever the surroundings do, and this is repeated until groups are small or the anchor is the whole window, of which there is one.

Words are told apart by 64-bit hashes, and so are runs of words. Everything is judged on the given texts.

Defined results: a null text has no words. Rows with equal ids are separate documents that do not affect each other. A row
with a null id is left as it is and affects no other. Documents of fewer words than a window stay. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import materialise

WINDOW = 50
# Words of the first anchors; what is left of the window is what an anchor can move in.
ANCHOR = 20
# Different pieces of one anchor that may meet in one shard, and the words of a shard.
HOT_PIECES = 256
SHARD_WORDS = 400_000
# Words whose pieces are made, or removed, in one go.
BATCH_WORDS = 1_000_000

# White space, odd multiplier of the polynomial hash with its inverse modulo 2^64, constants of the finisher.
SPACE = r"[\x20\x09-\x0D]+"
BASE = 0x9E3779B97F4A7C15
MIXERS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on all bits of ``x``; one to one."""
    x = (x ^ (x >> U(30))) * U(MIXERS[0])
    x = (x ^ (x >> U(27))) * U(MIXERS[1])
    return x ^ (x >> U(31))


class Runs:
    """Hashes of runs of words of any length in constant time: differences of a running sum, shifted to one place."""

    def __init__(self, words: np.ndarray):
        n = len(words) + 1
        self.up = np.full(n, BASE, U)
        self.up[0] = 1
        self.up = np.cumprod(self.up, dtype=U)
        down = np.full(n, pow(BASE, -1, 2**64), U)
        down[0] = 1
        down = np.cumprod(down, dtype=U)
        self.sums = np.concatenate([np.zeros(1, U), np.cumsum(words.astype(U) * down[:-1], dtype=U)])

    def hashes(self, start: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        return mixed((self.sums[start + length] - self.sums[start]) * self.up[start] + np.asarray(length).astype(U))


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first least value in each run of ``width`` values."""
    place = np.arange(len(values))
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        n = len(place) - step
        a, b = place[:n], place[step:]
        place = np.where(values[b] < values[a], b, a)
        reach += step
    return place


def cut_pieces(words: np.ndarray, ends: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(document, first window, last window, anchor's place, anchor's hash, hash of the piece) of all pieces.

    ``words`` are those of all documents in a row, ``ends`` where each one ends. Places count from the start of ``words``.
    """
    empty = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64, U, U))
    if len(words) < window:
        return empty
    runs = Runs(words)
    least = least_places(runs.hashes(np.arange(len(words) - anchor + 1), anchor), window - anchor + 1)
    starts = np.arange(len(words) - window + 1)
    document = np.searchsorted(ends, starts, side="right")
    inside = starts + window <= ends[document]
    starts, document, least = starts[inside], document[inside], least[starts[inside]]
    if not len(starts):
        return empty
    new = np.flatnonzero(np.concatenate([[True], (document[1:] != document[:-1]) | (least[1:] != least[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    first, last = starts[new], starts[np.concatenate([new[1:], [len(starts)]]) - 1]
    place = least[new]
    content = mixed(runs.hashes(first, last + window - first) ^ mixed((place - first).astype(U)))
    return document[new], first, last, place, runs.hashes(place, anchor), content


class BitVector:
    """Bits in 64-bit words with a count per word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(U)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))]).astype(np.int32)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """How many of the first ``i`` bits are set."""
        block = i >> 6
        below = (U(1) << (i & 63).astype(U)) - U(1)
        return self.before[block] + np.bitwise_count(self.words[block] & below)


class WaveletMatrix:
    """Ranks of symbols in a sequence, a bit vector per bit of a symbol."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels: list[tuple[int, BitVector, int]] = []
        order = symbols
        for bit in range(max(1, (size - 1).bit_length()) - 1, -1, -1):
            bits = ((order >> bit) & 1).astype(np.uint8)
            zeros = int(len(bits) - bits.sum())
            self.levels.append((bit, BitVector(bits), zeros))
            order = np.concatenate([order[bits == 0], order[bits == 1]])
        # Where the run of each symbol begins in the lowest level.
        self.begin = np.zeros(size, np.int64)
        present, first = np.unique(order, return_index=True)
        self.begin[present] = first

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often ``symbol`` is among the first ``i``; it must occur somewhere."""
        for bit, vector, zeros in self.levels:
            ones = vector.ones(i)
            i = np.where(((symbol >> bit) & 1) == 1, zeros + ones, i - ones)
        return i - self.begin[symbol]


class Index:
    """Compressed index of the pieces of a shard: backward search, and the smallest document of an interval.

    Suffixes are sorted by their first words, ``depth`` of them or more, as patterns are never longer.
    """

    def __init__(self, words: np.ndarray, lengths: np.ndarray, documents: np.ndarray, depth: int):
        size = int(words.max()) + 2
        # Each piece is followed by 0, which no pattern holds.
        ends = np.cumsum(lengths + 1)
        self.starts = ends - lengths - 1
        text = np.zeros(ends[-1], np.int64)
        keep = np.ones(ends[-1], bool)
        keep[ends - 1] = False
        text[keep] = words + 1
        self.text = text
        ranks = [text]
        while (1 << (len(ranks) - 1)) < depth:
            ranks.append(self._doubled(ranks[-1], 1 << (len(ranks) - 1)))
        order = np.argsort(ranks[-1], kind="stable")
        self.matrix = WaveletMatrix(text[order - 1], size)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        owner = np.repeat(np.arange(len(lengths)), lengths + 1)
        self.document = documents[owner[order]]
        self.order, self.ranks = order, ranks
        self.groups: dict[int, np.ndarray] = {}

    @staticmethod
    def _doubled(rank: np.ndarray, step: int) -> np.ndarray:
        after = np.zeros_like(rank)
        if step < len(rank):
            after[:-step] = rank[step:]
        return np.unique(rank * (int(rank.max()) + 2) + after, return_inverse=True)[1].astype(np.int64)

    def widened(self, low: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The interval of the first ``length`` words of the suffix at ``low``."""
        if length not in self.groups:
            n = len(self.order)
            changed = np.zeros(n, bool)
            changed[0] = True
            at = 0
            for power in range(len(self.ranks) - 1, -1, -1):
                if length >> power & 1:
                    place = self.order + at
                    values = np.where(place < n, self.ranks[power][np.minimum(place, n - 1)], -1)
                    changed[1:] |= values[1:] != values[:-1]
                    at += 1 << power
            self.groups[length] = np.append(np.flatnonzero(changed), n)
        bounds = self.groups[length]
        group = np.searchsorted(bounds, low, side="right") - 1
        return bounds[group], bounds[group + 1]

    def extended(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the matches with one word more in front."""
        base = self.first[symbol]
        return base + self.matrix.rank(symbol, low), base + self.matrix.rank(symbol, high)

    def least_documents(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Smallest document of each interval; intervals of matches of one length are equal or apart."""
        lows, place = np.unique(low, return_inverse=True)
        highs = np.zeros(len(lows), np.int64)
        highs[place] = high
        bounds = np.column_stack([lows, highs]).ravel()
        inside = bounds[-1] < len(self.document)
        least = np.minimum.reduceat(self.document, bounds if inside else bounds[:-1])[::2]
        return least[place]


def matched(words: np.ndarray, lengths: np.ndarray, documents: np.ndarray, window: int) -> np.ndarray:
    """For each window of each piece the smallest document that holds it, in the order of pieces and windows.

    ``words`` numbers the words of all pieces in a row, ``documents`` has one for each piece, which is at least a window
    long. All pieces go backwards through their common index in step, so every extension finds at least the piece itself.
    """
    index = Index(words, lengths, documents, window)
    by_length = np.argsort(-lengths, kind="stable")
    ends = index.starts[by_length] + lengths[by_length]
    longest = lengths[by_length]
    low, high = np.zeros(len(lengths), np.int64), np.full(len(lengths), len(index.text), np.int64)
    reported: list[tuple[np.ndarray, ...]] = []
    for step in range(1, int(longest[0]) + 1):
        active = int(np.searchsorted(-longest, -step, side="right"))
        symbol = index.text[ends[:active] - step]
        low, high = index.extended(symbol, low[:active], high[:active])
        if step >= window:
            reported.append((by_length[:active], longest[:active] - step, low, high))
            low, high = index.widened(low, window - 1)
    piece, at, low, high = (np.concatenate(x) for x in zip(*reported, strict=True))
    return index.least_documents(low, high)[np.lexsort((at, piece))]


def plain_rows(documents: DataFrame) -> DataFrame:
    """(doc_id, text_hash, text): rows with equal id and text have equal passages."""
    text = F.col("text").cast("string")
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def hashed_words(documents: DataFrame) -> DataFrame:
    """(doc_id, text_hash, words): 64-bit hashes of the words of each document that can take part."""
    words = F.filter(F.split(F.col("text"), SPACE), lambda w: w != "")
    rows = plain_rows(documents).filter("doc_id is not null and text is not null")
    return rows.select("doc_id", "text_hash", F.transform(words, lambda w: F.xxhash64(w)).alias("words"))


def _bundles(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of batches of bounded size with the list elements of a column in a row and where each row's end."""
    for batch in batches:
        offsets = batch.column(column).offsets.to_numpy()
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + BATCH_WORDS, side="right")) - 1)
            part = batch.slice(low, high - low)
            yield part, part.column(column).flatten().to_numpy(zero_copy_only=False), offsets[low + 1 : high + 1].astype(np.int64) - offsets[low]
            low = high


PIECES = "doc_id bigint, text_hash bigint, anchor bigint, content bigint, first int, last int, place int"


def pieces_of(words: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, text_hash, anchor, content, first, last, place): pieces by word numbers in their document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, flat, ends in _bundles(batches, 2):
            document, first, last, place, key, content = cut_pieces(flat, ends, window, anchor)
            begin = np.concatenate([[0], ends])[document]
            columns = [part.column(c).take(pa.array(document)) for c in (0, 1)]
            columns += [pa.array(x.view(np.int64)) for x in (key, content)]
            columns += [pa.array((x - begin).astype(np.int32)) for x in (first, last, place)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "anchor", "content", "first", "last", "place"])

    return words.filter(F.size("words") >= window).mapInArrow(run, PIECES)


# A piece that stands for its equals: its words, the smallest and the largest document that holds it, its anchor with
# place and length. ``source`` and ``offset`` say what piece it was cut from and where it begins there.
STANDING = "source bigint, offset int, content bigint, anchor bigint, place int, length int, document bigint, most bigint, text string"


def _standing_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
    columns = zip(*rows, strict=True) if rows else [[] for _ in types]
    names = [c.split()[0] for c in STANDING.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _standing(documents: DataFrame, pieces: DataFrame, window: int, anchor: int) -> DataFrame:
    """The standing pieces with their words, which are read from the smallest document that holds each."""
    place = F.struct("doc_id", "text_hash", "first", "last", "place", "anchor")
    chosen = pieces.groupBy("content").agg(F.min(place).alias("s"), F.max("doc_id").alias("most")).select("content", "most", "s.*")
    held = F.collect_list(F.struct("content", "anchor", "first", "last", "place", "most")).alias("pieces")
    both = plain_rows(documents).join(chosen.groupBy("doc_id", "text_hash").agg(held), ["doc_id", "text_hash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = re.compile(r"[^ \t-\r]+").findall
        for batch in batches:
            for document, text, pieces in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                document, words, out = document.as_py(), split(text.as_py()), []
                for p in pieces.as_py():
                    low, content = p["first"], p["content"]
                    kept = " ".join(words[low : p["last"] + window])
                    out.append((content, 0, content, p["anchor"], p["place"] - low, anchor, document, p["most"], kept))
                yield _standing_batch(out)

    return both.select("doc_id", "text", "pieces").mapInArrow(run, STANDING)


def _hash(words: list[str]) -> int:
    return int.from_bytes(hashlib.blake2b(" ".join(words).encode(), digest_size=8).digest(), "little", signed=True)


def longer_anchors(n_words: int, place: int, length: int, window: int) -> list[tuple[int, int, int, int]]:
    """(first word, end, place, length) of the one or two pieces, with longer anchors, that a piece is cut into.

    Windows with ``h`` words or more to the left of the anchor have these in the longer one, the others as many to its
    right as they then must have. Which of the two it is depends on the words of the window alone.
    """
    slack, last = window - length, n_words - window
    h = (slack + 1) // 2
    both = ((0, min(last, place - h), place - h, length + h), (max(0, place - h + 1), last, place, length + slack - h + 1))
    return [(first, low + window, at, size) for first, low, at, size in both if first <= low]


def _lengthened(standing: DataFrame, window: int) -> DataFrame:
    """Pieces cut in two by longer anchors; ``source`` is the piece they come from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, _, source, _, place, length, document, most, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                words = text.split(" ")
                for first, end, at, size in longer_anchors(len(words), place, length, window):
                    content, anchor = _hash([str(at - first), *words[first:end]]), _hash([str(size), *words[at : at + size]])
                    out.append((source, first, content, anchor, at - first, size, document, most, " ".join(words[first:end])))
            yield _standing_batch(out)

    return standing.mapInArrow(run, STANDING)


FOUND = "content bigint, offset int, least array<bigint>"


def _in_shards(standing: DataFrame, shards: int, window: int) -> DataFrame:
    """(content, offset, least): for each window of a piece, from ``offset`` on, the smallest document that holds it.

    Pieces of which no window occurs before the last of their documents are left out.
    """

    def run(group: pa.Table) -> pa.Table:
        place = np.unique(group.column("content").to_numpy(), return_index=True)[1]
        group = group.take(pa.array(place))
        lists = pc.split_pattern(group.column("text").combine_chunks(), " ")
        lengths = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        words = lists.flatten().dictionary_encode().indices.to_numpy().astype(np.int64)
        least = matched(words, lengths, group.column("document").to_numpy(), window)
        bounds = np.concatenate([[0], np.cumsum(lengths - window + 1)])
        needed = np.minimum.reduceat(least, bounds[:-1]) < group.column("most").to_numpy()
        rows = np.flatnonzero(needed)
        lists = pa.array([least[bounds[r] : bounds[r + 1]] for r in rows], pa.list_(pa.int64()))
        return pa.table([group.column("content").take(pa.array(rows)), pa.array(np.zeros(len(rows), np.int32)), lists], names=["content", "offset", "least"])

    dealt = standing.select("content", "document", "most", "text", F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"))
    return dealt.groupBy("shard").applyInArrow(run, FOUND)


def _resolved(standing: DataFrame, window: int, hot_pieces: int, shard_words: int) -> DataFrame:
    """(content, offset, least) of the stored standing pieces, those of hot anchors by way of longer anchors."""
    n_words = F.sum(F.length("text") - F.length(F.replace("text", F.lit(" "))) + 1)
    sizes = standing.groupBy("anchor").agg(F.count_distinct("content").alias("n"))
    hot = materialise(sizes.filter(F.col("n") > hot_pieces).select("anchor"), "hot-anchors")
    if hot.isEmpty():
        total = standing.agg(n_words).first()[0] or 0
        return _in_shards(standing, max(1, -(-total // shard_words)), window)
    cool = standing.join(hot, "anchor", "left_anti")
    total = cool.agg(n_words).first()[0] or 0
    found = _in_shards(cool, max(1, -(-total // shard_words)), window)
    cut = materialise(_lengthened(standing.join(hot, "anchor", "left_semi").select(standing.columns), window), "longer-anchors")
    rest = F.struct("document", "source", "offset", "anchor", "place", "length", "text")
    lower = cut.groupBy("content").agg(F.min(rest).alias("s"), F.max("most").alias("most")).select("content", "most", "s.*")
    below = materialise(_resolved(materialise(lower.select(standing.columns), "cut-pieces"), window, hot_pieces, shard_words), "cut-found")
    parts = cut.select("source", F.col("offset").alias("begin"), "content").distinct()
    back = parts.join(below, "content").select(F.col("source").alias("content"), (F.col("begin") + F.col("offset")).cast("int").alias("offset"), "least")
    return found.unionByName(back)


def repeated_windows(
    documents: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, hot_pieces: int = HOT_PIECES, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """(doc_id, text_hash, starts): the first words of all windows that also start in a document with a smaller id."""
    pieces = materialise(pieces_of(hashed_words(documents), window, anchor), "pieces")
    spread = pieces.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    # Stored, so that the join has an exchange of its own on both sides and a common anchor's pieces can be split.
    shared = materialise(spread.filter("low < high").select("anchor"), "shared-anchors")
    repeated = materialise(pieces.join(shared, "anchor", "left_semi"), "repeated-pieces")
    standing = materialise(_standing(documents, repeated, window, anchor), "standing-pieces")
    found = materialise(_resolved(standing, window, hot_pieces, shard_words), "found")
    held = repeated.select("doc_id", "text_hash", "content", "first").join(found, "content")
    numbered = F.transform("least", lambda low, k: F.when(low < F.col("doc_id"), F.col("first") + F.col("offset") + k))
    starts = held.select("doc_id", "text_hash", F.filter(numbered, lambda x: x.isNotNull()).alias("starts")).filter(F.size("starts") > 0)
    return starts.groupBy("doc_id", "text_hash").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("starts")))).alias("starts"))


DEDUPED = "doc_id bigint, n_words bigint, n_removed bigint, text string"


def deduplicated(documents: DataFrame, window: int = WINDOW, **limits: int) -> DataFrame:
    """(doc_id, n_words, n_removed, text): every row with the words that stay, joined by one space."""
    starts = repeated_windows(documents, window, **limits)
    both = plain_rows(documents).join(starts, ["doc_id", "text_hash"], "left").select("doc_id", "text", "starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = re.compile(r"[^ \t-\r]+").findall
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[] for _ in types]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "n_words", "n_removed", "text"])

        for batch in batches:
            rows, held = [], 0
            for doc_id, text, begins in zip(*batch.columns, strict=True):
                words = split(text.as_py() or "")
                n = len(words)
                if begins.is_valid:
                    change = np.zeros(n + 1, np.int64)
                    first = begins.values.to_numpy()
                    change[first] += 1
                    change[first + window] -= 1
                    words = list(compress(words, (np.cumsum(change[:-1]) == 0).tolist()))
                rows.append((doc_id.as_py(), n, n - len(words), " ".join(words)))
                held += n
                if held >= BATCH_WORDS:
                    yield batch_of(rows)
                    rows, held = [], 0
            yield batch_of(rows)

    return both.mapInArrow(run, DEDUPED)
