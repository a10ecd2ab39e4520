"""Alignment of two tokenizers over the same texts by diagonal run skipping, and how often token pairs end together.

Every text is encoded twice, as bytes of a space and the text: by a byte-level BPE (A) and by a sentence piece model (B).
Where tokens of both end at the same byte, the text is cut into groups. The two arrays of ends are compared at the current
index shift: exponential probing finds how far they agree, and such a stretch is a row of one-to-one groups. Where they
differ, both are walked to their next common end, which is one irregular group and sets the new shift.

A link is a pair of tokens that end together, the last ones of a group. The bytes of one are then the end of the bytes of
the other, so the number of different linked pairs is bounded by the two vocabularies (``Vocabularies.pair_bound``)
whatever the corpus. The table of pair counts is sent to the tasks on that ground. Texts are never shuffled.

Defined results: texts that are null or empty, or that a tokenizer does not give back byte by byte, have no tokens: zeros
and empty groups. Strings of special tokens are ordinary text. Every row has its own result, rows with equal ids or texts
and null ids too. Other columns of the input are ignored.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import materialise

# Pieces of texts whose ids a worker remembers; the memory is emptied when it is full.
REMEMBERED = 600_000
# Results passed on together, in characters of text.
BATCH_CHARS = 2_000_000

ALIGNED = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups string, links binary"


def byte_letters() -> dict[str, int]:
    """The byte that each letter of the byte-level alphabet stands for: printable ones for themselves, others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabularies:
    """Both tokenizers with the bytes of each of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = byte_letters()
        entries = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, number in entries.items():
            if all(c in letters for c in entry):
                self.a_bytes[number] = bytes(letters[c] for c in entry)
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        if len(self.a_bytes) * len(self.b_bytes) > 2**32:
            raise ValueError("pairs of these vocabularies do not fit into 32 bits")

    def _piece(self, number: int) -> bytes:
        piece = self.b.id_to_piece(number)
        return bytes([int(piece[3:-1], 16)]) if self.b.is_byte(number) else piece.replace("▁", " ").encode()

    @cached_property
    def by_piece(self) -> bool:
        """Whether A splits texts by the pattern of byte-level BPE and by nothing else."""
        kind = json.loads(self.a.to_str())
        split = kind["pre_tokenizer"] or {}
        return bool(kind["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split["add_prefix_space"])

    def pair_bound(self) -> int:
        """How many pairs can be linked at most: pairs of which one is the end of the other."""
        a, b = Counter(self.a_bytes), Counter(self.b_bytes)
        ends_in = sum(n * b[x[k:]] for x, n in a.items() for k in range(len(x)))
        return ends_in + sum(n * a[x[k:]] for x, n in b.items() for k in range(1, len(x)))


class Encoder:
    """Ids of a text under both tokenizers; None where its bytes are not given back.

    A text of plain characters is split by A's own pattern, and the ids of its pieces are remembered. All else A encodes whole.
    """

    def __init__(self, vocabularies: Vocabularies):
        self.v = vocabularies
        # Fixed value: the splitting pattern of byte-level BPE, here for plain characters only.
        self.split = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall
        self.plain = re.compile(r"[ -~À-ÖØ-öø-ÿ\n]+").fullmatch
        self.letters = str.maketrans({chr(b): c for c, b in byte_letters().items()})
        self.pieces: dict[str, list[int]] = {}

    def _a(self, text: str) -> list[int]:
        if not (self.v.by_piece and self.plain(text)):
            return self.v.a.encode(text, add_special_tokens=False).ids
        ids: list[int] = []
        pieces = self.pieces
        for piece in self.split(text):
            found = pieces.get(piece)
            if found is None:
                if len(pieces) >= REMEMBERED:
                    pieces.clear()
                entry = piece.replace(" ", "Ġ").replace("\n", "Ċ") if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
                found = pieces[piece] = [t.id for t in self.v.a.model.tokenize(entry)]
            ids += found
        return ids

    def text(self, text: str | None) -> tuple[list[int], list[int]] | None:
        if not text:
            return None
        a, b = self._a(" " + text), self.v.b.encode(text)
        want = (" " + text).encode()
        same = want == b"".join(map(self.v.a_bytes.__getitem__, a)) == b"".join(map(self.v.b_bytes.__getitem__, b))
        return (a, b) if same else None


def common_ends(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """For each group the place of its last token in ``a`` and in ``b``, two lists of ascending ends with the same last one."""
    last_a: list[int] = []
    last_b: list[int] = []
    i = j = 0
    n = len(a)
    while i < n:
        if a[i] == b[j]:
            shift, k, step = j - i, i + 1, 1
            # The probe doubles while both agree, then halves to where they part.
            while k + step <= n and a[k : k + step] == b[k + shift : k + shift + step]:
                k += step
                step *= 2
            while step > 1:
                step //= 2
                if k + step <= n and a[k : k + step] == b[k + shift : k + shift + step]:
                    k += step
            last_a += range(i, k)
            last_b += range(j, k + shift)
            i, j = k, k + shift
        else:
            while a[i] != b[j]:
                if a[i] < b[j]:
                    i += 1
                else:
                    j += 1
            last_a.append(i)
            last_b.append(j)
            i += 1
            j += 1
    return last_a, last_b


class Written:
    """``a1,a2|b1;a3|b2,b3``: the ids of each group."""

    def __init__(self, ids: int):
        self.ids = ids
        self.strings = np.array([f"{i}{mark}" for mark in ",|;" for i in range(ids)], dtype=object)

    def __call__(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> str:
        """Ids and, for each group, the places of its last ones."""
        out = np.empty(len(a) + len(b), np.int64)
        mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        mark_a[last_a], mark_b[last_b] = self.ids, 2 * self.ids
        # A token stands behind all tokens of its own side before it and those of the other side in earlier groups.
        before_a = np.concatenate([[0], last_b[:-1] + 1])
        out[np.arange(len(a)) + np.repeat(before_a, np.diff(last_a, prepend=-1))] = a + mark_a
        out[np.arange(len(b)) + np.repeat(last_a + 1, np.diff(last_b, prepend=-1))] = b + mark_b
        return "".join(self.strings[out].tolist())[:-1]


def aligned(documents: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups, links) of every row of ``documents`` (doc_id, text).

    ``links`` holds one little-endian 32-bit number per group: id of A times the size of B plus id of B.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabularies(a_path, b_path)
        encoder = Encoder(v)
        size_a, size_b = (np.array([len(x) for x in side], np.int64) for side in (v.a_bytes, v.b_bytes))
        written = Written(max(len(size_a), len(size_b)))

        def one(doc_id: int | None, text: str | None) -> tuple:
            ids = encoder.text(text)
            if ids is None:
                return doc_id, 0, 0, 0, "", b""
            a, b = (np.array(x, np.int64) for x in ids)
            last_a, last_b = map(np.array, common_ends(np.cumsum(size_a[a]).tolist(), np.cumsum(size_b[b]).tolist()))
            links = (a[last_a] * len(size_b) + b[last_b]).astype("<u4")
            return doc_id, len(a), len(b), len(last_a), written(a, b, last_a, last_b), links.tobytes()

        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        header = ["doc_id", "n_a", "n_b", "n_groups", "groups", "links"]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=header)

        for batch in batches:
            rows, chars = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                rows.append(one(doc_id, text))
                chars += len(text or "")
                if chars >= BATCH_CHARS:
                    yield batch_of(rows)
                    rows, chars = [], 0
            if rows:
                yield batch_of(rows)

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, ALIGNED)


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, n): how often each pair is linked in the column ``links``; every task passes on one row per pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            seen, n = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4"), return_counts=True)
            pairs, place = np.unique(np.concatenate([pairs, seen]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([counts, n]), len(pairs)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], names=["pair", "n"])

    return links.select("links").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def with_link_counts(rows: DataFrame, counts: DataFrame, size_b: int, bound: int) -> DataFrame:
    """The given rows with n_links, n_best and count_sum in the place of ``links``.

    ``counts`` is ``pair_counts`` of all rows: at most ``bound`` rows, by the vocabularies.
    """
    table = counts.orderBy("pair").limit(bound + 1).toArrow()
    if table.num_rows > bound:
        raise ValueError(f"more than {bound} different linked pairs")
    pairs, n = table.column("pair").to_numpy(), table.column("n").to_numpy()
    highest = np.zeros(size_b, np.int64)
    np.maximum.at(highest, pairs % size_b, n)
    shared = rows.sparkSession.sparkContext.broadcast((pairs, n, n == highest[pairs % size_b]))
    kept = [f for f in rows.schema.fields if f.name != "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = shared.value
        for batch in batches:
            held = [np.frombuffer(x, "<u4") for x in batch.column("links").to_pylist()]
            sums = []
            for links in held:
                place = np.searchsorted(pairs, links)
                sums.append((len(links), int(best[place].sum()), int(n[place].sum())) if len(links) else (0, 0, 0))
            columns = [batch.column(f.name) for f in kept] + [pa.array(c, pa.int64()) for c in zip(*sums, strict=True)] if sums else []
            if sums:
                yield pa.RecordBatch.from_arrays(columns, names=[*[f.name for f in kept], "n_links", "n_best", "count_sum"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(run, f"{columns}, n_links bigint, n_best bigint, count_sum bigint")


def alignment_digest(documents: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups_sha256, n_links, n_best, count_sum); links are stored once, groups only as a digest."""
    v = Vocabularies(a_path, b_path)
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    rows = materialise(aligned(documents, a_path, b_path).withColumn("groups_sha256", digest).drop("groups"), "aligned")
    return with_link_counts(rows, pair_counts(rows), len(v.b_bytes), v.pair_bound())
