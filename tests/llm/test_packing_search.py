"""The local search of packing: it ends, never loses a piece, and empties bins that best fit cannot."""

from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shiori.llm import packing, registered

TABLES = Path("/root/testdata/sf0.001")


class Watched(packing.Bins):
    """Every exchange must increase the sum of squared fills."""

    def _exchange(self, small, out, b, back):
        before = int((self.fill**2).sum())
        done = super()._exchange(small, out, b, back)
        assert int((self.fill**2).sum()) > before and (self.fill <= self.capacity).all()
        assert (np.bincount(self.bin, self.lengths, len(self.fill)) == self.fill).all()
        return done


@pytest.mark.parametrize("seed", range(40))
def test_search_ends_and_only_gains(seed):
    rng = np.random.default_rng(seed)
    lengths = np.array([882, 1396, 1359, 378]) if seed == 0 else rng.integers(*[(700, 1500), (300, 1100), (1, 2048)][seed % 3], 100)
    bins = Watched(lengths, 2048)
    bins.best_fit()
    best_fit = int((bins.fill > 0).sum())
    bins.local_search()
    assert -(-int(lengths.sum()) // 2048) <= int((bins.fill > 0).sum()) <= best_fit


def test_fewer_bins_than_best_fit():
    rng = np.random.default_rng(11)
    won = 0
    for _ in range(200):
        lengths = rng.integers(300, 1100, 60)
        bins = Watched(lengths, 2048)
        bins.best_fit()
        before = int((bins.fill > 0).sum())
        bins.local_search()
        won += int((bins.fill > 0).sum()) < before
    assert won > 20


@pytest.mark.skipif(not TABLES.exists(), reason="no test data")
def test_registered_pieces_equal_a_fresh_tokenizer(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    import zlib

    want = set()
    for doc_id, text in registered.table(spark, str(TABLES), "documents").select("doc_id", "text").collect():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 or 2048
        starts = [0, *range(first, len(ids), 2048)] if len(ids) > 2048 else [0]
        for piece, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
            want.add((doc_id, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    rows = registered.op10_best_fit_packing(spark, str(TABLES)).collect()
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    placed = {}
    for r in rows:
        placed.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in placed.values():
        ends = 0
        for offset, length in sorted(parts):
            assert offset == ends
            ends += length
        assert ends <= 2048
