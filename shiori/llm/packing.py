"""Packing of tokenised documents into sequences: best fit, then swap-based local search.

Documents become pieces of at most ``capacity`` tokens. Full pieces are sequences of their own. The others are spread
by hash over groups of bounded size; inside a group each piece goes to the fullest bin that takes it, and then pieces
are moved between bins that are not full (one moves, one for one, or two for one) wherever that increases the sum of
squared fills, until bins run empty or no exchange helps.

Defined results: a null text is an empty one (one end token). Rows with the same id are separate documents of that id;
their pieces are told apart by ``start``, ``piece`` and where they lie. Other columns of the input are ignored.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..sources.workspace import materialise

CAPACITY = 2048
# Pieces packed together in one task.
GROUP_PIECES = 20_000
# Words whose ids a worker remembers; the memory is emptied when it is full.
REMEMBERED_WORDS = 600_000
# Texts given to the worker's tokenizer before their ids are passed on, in characters.
BATCH_CHARS = 4_000_000

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids binary"


class Pieces(dict):
    """Ids of what the tokenizer's pattern makes of a text, remembered."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenize = tokenizer.model.tokenize
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        # The byte-level alphabet: printable bytes stand for themselves, the others for letters from U+0100 on.
        self.letters = str.maketrans({chr(b): chr(256 + i) for i, b in enumerate(others)})

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        plain = piece.replace(" ", "Ġ").replace("\n", "Ċ") if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.tokenize(plain)]
        found = self[piece] = struct.pack(f"<{len(ids)}I", *ids)
        return found


class WordIds(dict):
    """Ids of whole texts from the ids of their words; a text of plain characters is split by the tokenizer's own pattern at once.

    A byte-level BPE splits a text before each single space and never merges over such a split, so a text without
    doubled white space is its first word followed by ' ' + word for each other one. A plain word is split by the
    tokenizer's own pattern, and each part is looked up or given to its model; all else goes to the tokenizer whole, and so
    does a text that holds an added token: the tokenizer finds those before it splits.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        kind = json.loads(self.tokenizer.to_str())
        split = kind["pre_tokenizer"] or {}
        self.by_word = kind["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split["add_prefix_space"]
        self.added = [t["content"] for t in kind["added_tokens"]]
        self.pieces = Pieces(self.tokenizer)
        self.doubled = re.compile(r"\s\s")
        self.plain = re.compile(r" ?[!-~À-ÖØ-öø-ÿ\n]+")
        self.plain_text = re.compile(r"[ -~À-ÖØ-öø-ÿ\n]+")
        # Fixed value: the splitting pattern of byte-level BPE, here for plain characters only.
        self.parts = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        if self.plain.fullmatch(word):
            found = b"".join(map(self.pieces.__getitem__, self.parts(word)))
        else:
            found = self.whole(word)
        self[word] = found
        return found

    def text(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.by_word or any(a in text for a in self.added):
            return self.whole(text)
        if self.plain_text.fullmatch(text):
            return b"".join(map(self.pieces.__getitem__, self.parts(text)))
        if self.doubled.search(text):
            return self.whole(text)
        first, *words = text.split(" ")
        head = self[first] if first else b""
        return head + b"".join(map(self.__getitem__, [" " + w for w in words]))


def tokenised(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids): little-endian 32-bit ids of each piece, the end token included.

    Only documents longer than ``capacity`` are cut. All pieces but the first are ``capacity`` long.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(tokenizer_path)

        def cut(rows: list[tuple]) -> pa.RecordBatch:
            out: list[list] = [[], [], [], [], []]
            for doc_id, ids in rows:
                n = len(ids) // 4
                first = n % capacity or capacity
                begins = [0, *range(first, n, capacity)] if n > capacity else [0]
                for piece, (a, b) in enumerate(zip(begins, [*begins[1:], n], strict=True)):
                    for column, value in zip(out, (doc_id, piece, a, b - a, ids[4 * a : 4 * b]), strict=True):
                        column.append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, types, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids"],
            )

        for batch in batches:
            rows, chars = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                rows.append((doc_id, words.text(text) + end))
                chars += len(text)
                if chars >= BATCH_CHARS:
                    yield cut(rows)
                    rows, chars = [], 0
            if rows:
                yield cut(rows)

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, PIECES)


class Bins:
    """The bin of each piece and the fill of each bin of one group."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        self.lengths, self.capacity = lengths.astype(np.int64), capacity
        self.bin = np.zeros(len(lengths), np.int64)
        self.fill = np.zeros(0, np.int64)

    def best_fit(self) -> None:
        """Longest piece first, into the fullest bin that takes it."""
        of_fill: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        fills: list[int] = []
        for i in np.argsort(-self.lengths, kind="stable"):
            x = int(self.lengths[i])
            fill = next((f for f in range(self.capacity - x, 0, -1) if of_fill[f]), 0)
            if fill:
                b = of_fill[fill].pop()
            else:
                b = len(fills)
                fills.append(0)
            fills[b] += x
            of_fill[fills[b]].append(b)
            self.bin[i] = b
        self.fill = np.array(fills, np.int64)

    def local_search(self) -> int:
        """Exchanges out of the emptiest bins while one increases the sum of squared fills and a bin fewer is possible.

        Returns the number of exchanges.
        """
        made, fewest = 0, -(-int(self.lengths.sum()) // self.capacity)
        while (excess := int((self.fill > 0).sum()) - fewest) > 0:
            sources = np.argsort(np.where(self.fill > 0, self.fill, self.capacity + 1), kind="stable")[: 8 + 4 * excess]
            for small in sources:
                if 0 < self.fill[small] < self.capacity and self._improve(int(small)):
                    made += 1
                    break
            else:
                break
        return made

    def _improve(self, small: int) -> bool:
        """The exchange that helps most, if any does: one or two pieces leave ``small``, none or one comes back from their new bin.

        Every exchange made increases the sum of squared fills, so the search ends.
        """
        own = np.flatnonzero(self.bin == small)
        room = self.capacity - self.fill
        room[small] = -1
        room[self.fill == 0] = -1
        pieces = np.flatnonzero(room[self.bin] > 0)  # those that may come back
        home = self.bin[pieces]
        gap, space, gain = self.fill[home] - self.fill[small], room[home], self.lengths[pieces]
        outs = [(i,) for i in own] + [(i, j) for n, i in enumerate(own) for j in own[n + 1 :]]
        best, found = 0, None
        for out in outs:
            x = int(self.lengths[list(out)].sum())
            if len(out) == 1 and (room >= x).any():
                b = int(np.argmax(np.where(room >= x, self.fill, -1)))
                if (value := x * int(self.fill[b] - self.fill[small] + x)) > best:
                    best, found = value, (out, b, None)
            more = x - gain
            value = np.where((more > 0) & (more <= space), more * (gap + more), 0)
            if len(value) and value[y := int(np.argmax(value))] > best:
                best, found = int(value[y]), (out, int(home[y]), int(pieces[y]))
        return bool(found) and self._exchange(small, *found)

    def _exchange(self, small: int, out: tuple, b: int, back: int | None) -> bool:
        moved = int(self.lengths[list(out)].sum()) - (int(self.lengths[back]) if back is not None else 0)
        self.bin[list(out)] = b
        if back is not None:
            self.bin[back] = small
        self.fill[b] += moved
        self.fill[small] -= moved
        return True


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each piece."""
    bins = Bins(lengths, capacity)
    bins.best_fit()
    bins.local_search()
    order = np.argsort(bins.bin, kind="stable")
    before = np.cumsum(bins.lengths[order]) - bins.lengths[order]
    first = np.searchsorted(bins.bin[order], bins.bin[order], side="left")
    offset = np.empty(len(lengths), np.int64)
    offset[order] = before - before[first] if len(order) else before
    return bins.bin, offset


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """The given rows, which need doc_id, start and length, with ``sequence_id`` and ``offset``.

    ``pieces`` is read twice: once to count what is to be packed.
    """
    short = pieces.filter(F.col("length") < capacity)
    n_groups = max(1, -(-short.count() // group_pieces))
    keyed = short.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "start"), F.lit(n_groups)))

    def fill(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("length", "ascending")])
        number, offset = pack_lengths(group.column("length").to_numpy(), capacity)
        # Odd numbers are full pieces; those of a group follow each other in steps of the number of groups.
        ids = 2 * (number * n_groups + group.column("pack_group").to_numpy())
        return group.drop_columns("pack_group").append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offset))

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    packed = keyed.groupBy("pack_group").applyInArrow(fill, f"{columns}, sequence_id bigint, offset bigint")
    full = (
        pieces.filter(F.col("length") >= capacity)
        .withColumn("sequence_id", 2 * F.monotonically_increasing_id() + 1)
        .withColumn("offset", F.lit(0).cast("bigint"))
    )
    return packed.unionByName(full)


def packed_documents(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): the place of every piece.

    The ids themselves are not stored; ``sequences`` makes them again beside these places.
    """
    cut = tokenised(documents, tokenizer_path, capacity, end_id)
    measured = materialise(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    return pack(measured, capacity, group_pieces)


def sequences(documents: DataFrame, packed: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(sequence_id, ids array<int>): the token sequences that ``packed_documents`` laid out.

    Documents need unique, non-null ids here.
    """
    ids = tokenised(documents, tokenizer_path, capacity, end_id).select("doc_id", "piece", "ids")
    placed = packed.select("doc_id", "piece", "sequence_id", "offset").join(ids, ["doc_id", "piece"])
    parts = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.frombuffer(b"".join(x), "<u4").astype(np.int32) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int32()))], names=["sequence_id", "ids"])

    return parts.select("sequence_id", "parts.ids").mapInArrow(decoded, "sequence_id bigint, ids array<int>")
