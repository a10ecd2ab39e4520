"""N-gram Jaccard join: classes of documents linked by shared five-word shingles, by T-occurrence search.

1. Each text becomes its set of hashed shingles. Documents with equal sets are one node from then on.
2. Prefixes: two sets similar enough share one of their first n - ceil(0.8 n) + 1 shingles in any one order of all
   shingles. The order here puts frequent ones last, by counts of hash cells over all texts, so that a passage that many
   documents share stays out of their prefixes. Nodes that share no prefix shingle with another have no link.
3. T-occurrence search: nodes that share an early prefix shingle meet in bounded groups. There inverted lists are merged
   with DivideSkip (short lists through a heap, long ones probed by binary search), and a node that reaches the
   required overlap with one already there is linked to it and not indexed itself.
4. Groups are bounded and linked nodes not indexed, so links between classes can be missed there. Nodes that share a
   prefix shingle but not a class are sent to each other's class, after filters by size, position and parity marks that
   lose none, and search its inverted lists in the same way. A node that reaches one member is linked with the class.
   First each node meets only its neighbours in the lists of its shingles, as many pairs as postings; classes that these
   links join have no pairs with each other when all others are met.

A group of copies of any size is one node; near copies cost a link each, not a pair for each two.

Defined results: null texts and texts without words have no shingles and are linked with nothing. Texts of fewer than
five words are one shingle. Sets and shingles are told apart by 64-bit hashes. Rows with the same id count as documents of
that id. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workspace import discard, materialise

WORDS = 5
# Similarity, in hundredths.
PERCENT = 80
# Cells of the frequency table; sent to every task, 512 KiB.
CELLS = 1 << 16
# Early shared prefix shingles by which a node looks for others, and the most nodes that meet in one group.
SEARCH_KEYS, GROUP_NODES = 1, 2_048
# Sets that go to classes at once, as a share of all sets; more are sent in passes, so that the disk they take stays bounded.
PASS_SHARE = 0.5
# Bits of a set's parities, by which most pairs are ruled out before sets are moved; so many go with each posting, 64 to a long.
BITS, MARKS = 2_048, 8
# Turns in which nodes meet their neighbours only.
TURNS = 2
# Nodes that a task remembers having met.
REMEMBERED_NODES = 400_000
# Texts hashed at once, in bytes; a longer one is hashed alone.
CHUNK_BYTES = 1 << 18
# Documents whose ids may be sent to every task; beyond it they are joined by a shuffle.
BROADCAST_IDS = 100_000


MIX = np.uint64(0x9E3779B97F4A7C15)
# A word's hash is a polynomial of its bytes' values, modulo 2^64; this is its base, odd so that it has an inverse.
BASE = 0xD6E8FEB86659FD93
VALUES = np.random.default_rng(5).integers(1, 1 << 64, 256, dtype=np.uint64)
VALUES[65:91] = VALUES[97:123]
WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


class Shingler:
    """Sorted distinct shingle hashes of texts, worked out for a chunk of texts at once."""

    def __init__(self):
        self.power, self.inverse = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def of(self, texts: pa.Array) -> Iterator[np.ndarray]:
        texts = texts.fill_null("").cast(pa.large_binary())
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        start = 0
        while start < len(texts):
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + CHUNK_BYTES, side="right")) - 1)
            yield from self._chunk(data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start])
            start = end

    def _words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and the number of the first word of each text."""
        size = len(data)
        if len(self.power) <= size:
            self.power, self.inverse = (
                np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, x, np.uint64), dtype=np.uint64)]) for x in (BASE, pow(BASE, -1, 1 << 64))
            )
        # Borders of words: where white space or a text begins or ends.
        inside = np.zeros(size + 2, bool)
        inside[1:-1] = ~WHITE[data]
        border = np.zeros(size + 1, bool)
        border[offsets] = True
        start = np.flatnonzero(inside[1:] & (border | ~inside[:-1]))
        end = np.flatnonzero(inside[:-1] & (border | ~inside[1:]))
        total = np.zeros(size + 1, np.uint64)
        np.cumsum(VALUES[data] * self.power[:size], out=total[1:])
        h = (total[end] - total[start]) * self.inverse[start] + (end - start).astype(np.uint64)
        h ^= h >> np.uint64(32)
        h *= MIX
        h ^= h >> np.uint64(29)
        return h, np.searchsorted(start, offsets)

    def _chunk(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        h, first = self._words(data, offsets)
        whole = self._shingles(h, WORDS)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if not a < b:
                yield h[:0]
                continue
            s = np.sort(whole[a : b - WORDS + 1] if b - a >= WORDS else self._shingles(h[a:b], b - a))
            fresh = s[1:] != s[:-1]
            yield s if fresh.all() else s[np.concatenate([[True], fresh])]

    @staticmethod
    def _shingles(h: np.ndarray, k: int) -> np.ndarray:
        n = max(0, len(h) - k + 1)
        out = np.full(n, k, np.uint64)
        for i in range(k):
            out = (out ^ h[i : i + n]) * MIX
            out ^= out >> np.uint64(29)
        return out


def cells_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(48)).astype(np.int64) % CELLS


def prefix_size(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


def in_order(hashes: np.ndarray, frequency: np.ndarray) -> np.ndarray:
    """The sorted hashes, rare ones first; one order for all texts."""
    return hashes[np.argsort(frequency[cells_of(hashes)], kind="stable")]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def parities(hashes: np.ndarray) -> tuple[bytes, bytes]:
    """Whether the number of hashes in each of ``BITS`` cells is odd; and the same for the few cells that go with postings."""
    bits, few = ((np.bincount((hashes % np.uint64(size)).astype(np.int64), minlength=size) & 1).astype(np.uint8) for size in (BITS, 64 * MARKS))
    return np.packbits(bits).tobytes(), np.packbits(few).tobytes()


def may_be_similar(a: bytes, b: bytes, n: int, m: int) -> bool:
    """Each bit that differs stands for a shingle of one set alone, so sets with many such bits overlap too little."""
    differ = (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count()
    return (n + m - differ) // 2 >= needed(n, m)


def needed(n: int, m: int) -> int:
    """Least overlap of similar sets of n and m."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


def measured(documents: DataFrame) -> DataFrame:
    """(doc_id, n, node, cells): size and hash of each set; one row of each task carries counts by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, cells = Shingler(), np.zeros(CELLS, np.int64)
        for batch in batches:
            sizes, nodes, waiting, n_waiting = [], [], [], 0
            for s in shingler.of(batch.column(1)):
                waiting.append(s)
                n_waiting += len(s)
                if n_waiting >= CELLS:
                    cells += np.bincount(cells_of(np.concatenate(waiting)), minlength=CELLS)
                    waiting, n_waiting = [], 0
                sizes.append(len(s))
                nodes.append(xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63))
            if waiting:
                cells += np.bincount(cells_of(np.concatenate(waiting)), minlength=CELLS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.nulls(len(nodes), pa.binary())],
                names=["doc_id", "n", "node", "cells"],
            )
        if cells.any():
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64()), pa.array([-1], pa.int64()), pa.array([0], pa.int64()), pa.array([cells.tobytes()], pa.binary())],
                names=["doc_id", "n", "node", "cells"],
            )

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id bigint, n bigint, node bigint, cells binary")


def frequencies(rows: DataFrame) -> np.ndarray:
    """The tasks' tables added up, first in groups of tasks, then together."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_py(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["cells"])

    tables = rows.filter("n = -1").select("cells").repartition(8).mapInArrow(add, "cells binary")
    return sum((np.frombuffer(r[0], np.int64) for r in tables.toLocalIterator()), np.zeros(CELLS, np.int64))


def postings(documents: DataFrame, frequency) -> DataFrame:
    """(h, node, n, pos): the prefix shingles of each set; a task leaves out sets that it met lately."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, met = Shingler(), set()
        for batch in batches:
            columns: list[list[np.ndarray]] = [[], [], [], []]
            for s in shingler.of(batch.column(0)):
                node = xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63)
                if not len(s) or node in met:
                    continue
                if len(met) >= REMEMBERED_NODES:
                    met.clear()
                met.add(node)
                first = in_order(s, frequency.value)[: prefix_size(len(s))]
                for column, x in zip(columns, (first.view(np.int64), np.full(len(first), node), np.full(len(first), len(s), np.int32), np.arange(len(first), dtype=np.int32))):
                    column.append(x)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=["h", "node", "n", "pos"])

    return documents.select("text").mapInArrow(run, "h bigint, node bigint, n int, pos int")


def shared_postings(documents: DataFrame, frequency) -> DataFrame:
    """The prefix postings of shingles that more than one node has, with the number of nodes that have it."""
    once = postings(documents, frequency).repartition("h").dropDuplicates(["h", "node"])
    listed = once.withColumn("df", F.count("*").over(Window.partitionBy("h"))).filter("df > 1")
    # The nearest sizes in the list tell whether any other node in it is of a fitting size.
    by_size = Window.partitionBy("h").orderBy("n")
    n, less, more = F.col("n"), F.lag("n").over(by_size), F.lead("n").over(by_size)
    fits = (100 * less >= PERCENT * n) | (100 * n >= PERCENT * more)
    return listed.withColumn("fits", fits).filter("fits").drop("fits")


def sets_of(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, n, s, bits, marks): the sets of the documents in ``ids`` (doc_id, node), their sizes and parities."""
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(ids, "doc_id").select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, met = Shingler(), set()
        for batch in batches:
            found = []
            for node, s in zip(batch.column(0).to_pylist(), shingler.of(batch.column(1)), strict=True):
                # Rows repeated with their id and text are one set; rows of that id with other texts are other nodes.
                if node in met or xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) != node:
                    continue
                if len(met) >= REMEMBERED_NODES:
                    met.clear()
                met.add(node)
                bits, few = parities(s)
                found.append((node, len(s), s.tobytes(), bits, np.frombuffer(few, np.int64).tolist()))
            types = {"node": pa.int64(), "n": pa.int64(), "s": pa.binary(), "bits": pa.binary(), "marks": pa.list_(pa.int64())}
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate(types.values())], names=list(types))

    return texts.mapInArrow(run, "node bigint, n bigint, s binary, bits binary, marks array<bigint>")


class Occurrences:
    """Inverted lists of ascending set numbers, searched with DivideSkip."""

    def __init__(self):
        self.lists: dict[int, list[int]] = {}
        self.sizes: list[int] = []

    def add(self, hashes: list[int]) -> None:
        number = len(self.sizes)
        self.sizes.append(len(hashes))
        for h in hashes:
            self.lists.setdefault(h, []).append(number)

    def search(self, hashes: list[int]) -> Iterator[int]:
        """Numbers of the sets that reach the required overlap with ``hashes``."""
        n = len(hashes)
        lists = sorted((x for h in hashes if (x := self.lists.get(h))), key=len)
        least = -(-PERCENT * n // 100) if not self.sizes else needed(n, min(self.sizes))
        least = max(1, min(least, n))
        if len(lists) < least:
            return
        # So many of the longest lists are set aside; what is left must hold the rest of the overlap.
        aside = min(len(lists) - 1, least - 1, int(least / (0.01 * np.log2(len(lists[-1]) + 1) + 1)))
        short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
        # Lists of one set are counted together; a heap of iterators merges the others.
        last, count = -1, 0
        for number in heapq.merge(*short):
            if number == last:
                count += 1
                continue
            if last >= 0 and self._reaches(last, count, n, least - aside, long):
                yield last
            last, count = number, 1
        if last >= 0 and self._reaches(last, count, n, least - aside, long):
            yield last

    def _reaches(self, number: int, count: int, n: int, rest: int, long: list[list[int]]) -> bool:
        if count < rest:
            return False
        want = needed(n, self.sizes[number])
        for i, x in enumerate(long):
            if count >= want or count + len(long) - i < want:
                break
            at = bisect_left(x, number)
            count += at < len(x) and x[at] == number
        return count >= want


def _grouped_sets(members: DataFrame, sets: DataFrame, *key: str) -> DataFrame:
    """``members`` (node and key columns) with their sets; members are few numbers, so each set is moved to its groups only."""
    return members.join(sets.select("node", "s"), "node").groupBy(*key)


def searched(shared: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v): links found by T-occurrence search in bounded groups of nodes that share an early prefix shingle."""
    rank = F.row_number().over(Window.partitionBy("node").orderBy("pos"))
    keys = shared.withColumn("k", rank).filter(F.col("k") <= SEARCH_KEYS)
    salt = F.pmod(F.col("node"), F.ceil(F.col("df") / GROUP_NODES).cast("bigint"))
    members = keys.select("h", salt.alias("salt"), "node").withColumn("met", F.count("*").over(Window.partitionBy("h", "salt")))
    members = materialise(members.filter("met > 1").drop("met"), "search-groups")

    def search(group: pa.Table) -> pa.Table:
        index, names, u, v = Occurrences(), [], [], []
        rows = sorted((len(s), node, s) for node, s in zip(group.column("node").to_pylist(), group.column("s").to_pylist(), strict=True))
        for _, node, s in rows:
            hashes = np.frombuffer(s, np.uint64).tolist()
            hit = next(index.search(hashes), None)
            if hit is None:
                index.add(hashes)
                names.append(node)
            else:
                u.append(node)
                v.append(names[hit])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    links = materialise(_grouped_sets(members, sets, "h", "salt").applyInArrow(search, "u bigint, v bigint"), "links")
    discard(members)
    return links


def components(edges: DataFrame) -> DataFrame:
    """(node, label): contraction to smallest neighbours, again and again; ids are hashes, so a constant share goes each time."""
    edges = materialise(edges.filter("u <> v").distinct(), "edges")
    labels = materialise(edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct().withColumn("label", F.col("node")), "labels")
    turn = 0
    while not edges.isEmpty():
        turn += 1
        both = edges.union(edges.select("v", "u"))
        # Neighbours are compared by another hash each time, so that no order of ids makes long chains.
        key = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("x"), F.col(c).alias("id"))  # noqa: E731, B023
        parent = materialise(both.groupBy("u").agg(F.min(key("v")).alias("m")).select(F.col("u").alias("node"), F.least("m", key("u")).getField("id").alias("p")), "parents")
        to = lambda c: parent.select(F.col("node").alias(c), F.col("p").alias(f"p{c}"))  # noqa: E731, B023
        old = labels, edges
        labels = materialise(labels.join(to("label"), "label", "left").select("node", F.coalesce("plabel", "label").alias("label")), "labels")
        edges = materialise(
            edges.join(to("u"), "u").join(to("v"), "v").select(F.col("pu").alias("u"), F.col("pv").alias("v")).filter("u <> v").distinct(), "edges"
        )
        discard(parent, *old)
    discard(edges)
    return labels


def mixed_lists(listed: DataFrame, labels: DataFrame) -> DataFrame:
    """The postings ``listed`` of shingles that nodes of several classes have, with the class of each node as ``label``."""
    known = listed.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    of = Window.partitionBy("h")
    return known.withColumns({"lo": F.min("label").over(of), "hi": F.max("label").over(of)}).filter("lo < hi").drop("lo", "hi")


def _alike():
    """Whether sets with n and n2 shingles, a common one at pos and pos2, and marks and marks2 can be similar."""
    least = F.ceil(PERCENT * (F.col("n") + F.col("n2")) / (100 + PERCENT))
    most = F.least("pos", "pos2") + F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2"))
    differ = [F.bit_count(F.col("marks")[k].bitwiseXOR(F.col("marks2")[k])) for k in range(MARKS)]
    sizes = 100 * F.least("n", "n2") >= PERCENT * F.greatest("n", "n2")
    return sizes & (most >= least) & (F.col("n") + F.col("n2") - sum(differ[1:], differ[0]) >= 2 * least)


def neighbour_pairs(mixed: DataFrame, turn: int) -> DataFrame:
    """Pairs of a node with the one before it in a list and with the list's first: two for a posting, however long the list."""
    order = ["n", "node"] if not turn else [F.xxhash64(F.lit(turn), "node"), "node"]
    lists = Window.partitionBy("h").orderBy(*order)
    own = F.struct("node", "n", "pos", "label", "marks")
    met = mixed.select(own.alias("x"), F.array(F.lag(own).over(lists), F.first(own).over(lists)).alias("ys"))
    met = met.select("x", F.explode("ys").alias("y"))
    pairs = met.filter("x.label <> y.label").select("x.*", *[F.col(f"y.{c}").alias(f"{c}2") for c in ("node", "n", "pos", "label", "marks")]).filter(_alike())
    # The smaller class comes first.
    turned = F.col("label") > F.col("label2")
    names = [("node", "node2"), ("label", "label2"), ("node2", "node"), ("label2", "label"), ("n", "n2"), ("n2", "n")]
    return pairs.select(*[F.when(turned, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in names])


def all_pairs(mixed: DataFrame) -> DataFrame:
    """Pairs of all nodes of different classes that have a shingle in common and may be similar."""
    other = mixed.select("h", *[F.col(c).alias(f"{c}2") for c in ("node", "n", "pos", "label", "marks")])
    pairs = mixed.join(other, "h").filter((F.col("label") < F.col("label2")) & _alike())
    return pairs.select("node", "label", "node2", "label2", "n", "n2")


def likely_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, label, node2, label2, n, n2): the distinct ``pairs`` that may be similar by all parities of their sets."""
    pairs = materialise(pairs.distinct(), "met-pairs")
    bits = sets.select("node", "bits")
    mapped = pairs.join(bits, "node").join(bits.select(F.col("node").alias("node2"), F.col("bits").alias("bits2")), "node2")

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [may_be_similar(p, q, n, m) for n, m, p, q in zip(*(c.to_pylist() for c in batch.columns[4:]), strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:6]], names=batch.schema.names[:6])

    columns = mapped.select("node", "label", "node2", "label2", "n", "n2", "bits", "bits2")
    likely = materialise(columns.mapInArrow(sieve, "node bigint, label bigint, node2 bigint, label2 bigint, n int, n2 int"), "likely-pairs")
    discard(pairs)
    return likely


def linked(links: DataFrame, shared: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, label): the classes of ``links`` and of all links between them."""
    classes = components(links)
    marked = shared.select("h", "node", "n", "pos").join(sets.select("node", "marks"), "node")
    mixed = materialise(mixed_lists(marked, classes), "mixed")
    for turn in range(TURNS + 1):
        likely = likely_pairs(neighbour_pairs(mixed, turn) if turn < TURNS else all_pairs(mixed), sets)
        more = joined(likely, sets)
        discard(likely)
        if not more.isEmpty():
            old = links, more, classes
            links = materialise(links.union(more), "links")
            classes = components(links)
            discard(*old)
            if turn < TURNS:
                before, mixed = mixed, materialise(mixed_lists(mixed.drop("label"), classes), "mixed")
                discard(before)
        else:
            discard(more)
    discard(mixed, links)
    return classes


def joined(likely: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v): links between classes, by T-occurrence search of each likely partner in the lists of the class.

    The nodes of a class that have likely partners are indexed, in slices of bounded size; each node that a slice may hold a
    partner of looks for it there, once however many members it may be similar to. Lookers are sliced as well.
    """
    of_class = likely.select("label", "node").distinct().groupBy("label").agg(F.ceil(F.count("*") / GROUP_NODES).cast("bigint").alias("slices"))
    placed = materialise(likely.join(of_class, "label").withColumn("slice", F.pmod(F.xxhash64("node"), "slices")), "class-slices")
    lookers = placed.select("label", "slice", F.col("node2").alias("node"), F.col("n2").alias("n")).distinct()
    parts = lookers.groupBy("label", "slice").agg(F.ceil(F.count("*") / GROUP_NODES).cast("bigint").alias("parts"))
    lookers = lookers.join(parts, ["label", "slice"]).select("label", "slice", F.pmod(F.xxhash64("node"), "parts").alias("part"), "node", "n", F.lit(True).alias("looks"))
    part = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part")
    indexed = placed.select("label", "slice", "node", "n").distinct().join(parts, ["label", "slice"]).select("label", "slice", part, "node", "n", F.lit(False).alias("looks"))
    members = materialise(indexed.union(lookers), "class-groups")

    def search(group: pa.Table) -> pa.Table:
        index, names, u, v = Occurrences(), [], [], []
        rows = sorted(zip(group.column("looks").to_pylist(), group.column("node").to_pylist(), group.column("s").to_pylist(), strict=True))
        for looks, node, s in rows:
            hashes = np.frombuffer(s, np.uint64).tolist()
            if not looks:
                index.add(hashes)
                names.append(node)
            elif (hit := next(index.search(hashes), None)) is not None:
                u.append(node)
                v.append(names[hit])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    size = lambda table: table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    passes = max(1, -int(-size(members) // max(1, PASS_SHARE * size(sets))))
    number = F.pmod(F.xxhash64("label", "slice", "part"), F.lit(passes))
    found = []
    for i in range(passes):
        groups = _grouped_sets(members.filter(number == i).drop("n"), sets, "label", "slice", "part")
        found.append(materialise(groups.applyInArrow(search, "u bigint, v bigint"), "pass-links"))
    links = materialise(reduce(DataFrame.union, found), "more-links")
    discard(members, placed, *found)
    return links


def ngram_components(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    spark = documents.sparkSession
    rows = materialise(measured(documents), "shingle-sets")
    sent = spark.sparkContext.broadcast(frequencies(rows))
    docs = rows.filter("n >= 0").select("doc_id", "n", "node")
    shared = materialise(shared_postings(documents, sent), "shared-shingles")
    first = docs.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    ids = materialise(first.join(shared.select("node").distinct(), "node", "left_semi"), "shared-ids")
    sets = materialise(sets_of(documents, ids), "sets")
    links = searched(shared, sets)
    labels = linked(links, shared, sets)
    discard(shared, ids, sets, links)
    classed = docs.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = classed.filter("n > 0").groupBy("label").agg(F.min("doc_id").alias("least"))
    return classed.join(least, "label", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id")
    )


def one_of_each(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` without those that a document with a smaller id stands for.

    Of rows with the same id and equal texts one stays; a null id is a document that stays.
    """
    classes = materialise(ngram_components(documents.select("doc_id", "text")), "classes")
    losers = classes.filter("doc_id > component_id").select(F.col("doc_id").alias("_id")).distinct()
    repeated = classes.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("_id"))
    repeated = materialise(repeated, "repeated-ids")
    same = lambda ids: documents["doc_id"].cast("bigint") == ids["_id"]
    rows = documents.join(losers, same(losers), "left_anti")
    if repeated.isEmpty():
        return rows
    once = rows.join(repeated, same(repeated), "left_semi").dropDuplicates(["doc_id", "text"])
    return rows.join(repeated, same(repeated), "left_anti").unionByName(once)
