"""Removal of repeated passages against a table of all windows."""

import hashlib
import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiori.llm import registered, substring_dedup

TABLES = Path("/root/testdata/sf0.001")
COLUMNS = ["doc_id", "n_words", "n_removed", "kept_sha256"]


def brute(rows, window=50):
    split = [(d, re.findall(r"[^ \t-\r]+", t or "")) for d, t in rows]
    least = {}
    for d, words in split:
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            if d is not None:
                least[key] = min(d, least.get(key, d))
    out = []
    for d, words in split:
        gone = set()
        for k in range(len(words) - window + 1):
            if d is not None and least[tuple(words[k : k + window])] < d:
                gone.update(range(k, k + window))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((d, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df, **limits):
    found = substring_dedup.deduplicated(df, **limits).withColumn("kept_sha256", F.sha2("text", 256))
    return sorted([tuple(r) for r in found.select(COLUMNS).collect()], key=repr)


def passages(n_docs, seed, vocabulary=400):
    rng = random.Random(seed)
    common = [[f"w{rng.randrange(vocabulary)}" for _ in range(rng.choice([30, 49, 50, 51, 70, 120]))] for _ in range(12)]
    rows = []
    for d in range(n_docs):
        words = []
        for _ in range(rng.randrange(0, 4)):
            words += rng.choice(common) if rng.random() < 0.7 else [f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(60))]
        rows.append((d, rng.choice([" ", "\n", " \t"]).join(words)))
    return rows


def test_wavelet_matrix_ranks():
    rng = np.random.default_rng(1)
    symbols = rng.integers(0, 37, 500)
    matrix = substring_dedup.WaveletMatrix(symbols, 37)
    for c in range(37):
        if (symbols == c).any():
            places = np.arange(501)
            assert (matrix.rank(np.full(501, c), places) == np.concatenate([[0], np.cumsum(symbols == c)])).all()


def test_index_finds_smallest_documents():
    rng = np.random.default_rng(3)
    lengths = rng.integers(9, 30, 40)
    words = rng.integers(0, 3, lengths.sum())
    documents = rng.permutation(40)
    least = iter(substring_dedup.matched(words, lengths, documents, 9))
    pieces = np.split(words, np.cumsum(lengths)[:-1])
    table = {}
    for piece, d in zip(pieces, documents, strict=True):
        for k in range(len(piece) - 8):
            key = tuple(piece[k : k + 9])
            table[key] = min(d, table.get(key, d))
    for piece in pieces:
        for k in range(len(piece) - 8):
            assert next(least) == table[tuple(piece[k : k + 9])]


def test_longer_anchors_share_out_all_windows():
    for length in range(20, 50):
        for place in range(0, 51 - length):
            for n in range(max(50, place + length), 50 + place + 1):
                parts = substring_dedup.longer_anchors(n, place, length, 50)
                windows = [w for first, end, _, _ in parts for w in range(first, end - 49)]
                assert sorted(windows) == list(range(n - 49))
                for first, end, at, size in parts:
                    assert length < size <= 50 and all(w <= at and at + size <= w + 50 for w in range(first, end - 49))


@pytest.mark.parametrize("limits", [{}, {"hot_pieces": 1, "shard_words": 200}, {"hot_pieces": 4, "shard_words": 2000}])
def test_passages(spark, limits):
    rows = passages(150, 4)
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), **limits) == brute(rows)


def test_hot_passage_in_changing_surroundings(spark):
    rng = random.Random(8)
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for d in range(120):
        around = [f"x{rng.randrange(10**6)}" for _ in range(80)]
        shared = ["same"] * rng.randrange(3)
        rows.append((d, " ".join(around[:40] + shared + passage + shared + around[40:])))
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), hot_pieces=5) == brute(rows)


def test_odd_rows(spark):
    long = " ".join(f"w{k % 61}" for k in range(30_000))
    same = " ".join(f"z{k}" for k in range(50))
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (4, "few words"), (5, same), (5, same), (6, same + " more"), (6, same + " more"),
        (None, same), (7, long), (8, long[5:]), (9, "a " * 200), (10, "a " * 120), (-3, same.replace(" ", "\x0b")), (11, "\xa0".join(same.split(" "))),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    extra = df.withColumn("anchor", F.lit(1)).withColumn("starts", F.lit("x")).withColumn("text_hash", F.lit(0))
    assert got(extra) == brute(rows)


def test_empty_table(spark):
    assert got(spark.createDataFrame([], "doc_id long, text string")) == []


@pytest.mark.skipif(not TABLES.exists(), reason="no test data")
def test_registered_query(spark):
    rows = [tuple(r) for r in registered.table(spark, str(TABLES), "documents").select("doc_id", "text").collect()]
    found = registered.op12_substring_dedup(spark, str(TABLES)).select(COLUMNS).collect()
    want = brute(rows)
    assert sorted(map(tuple, found), key=repr) == want and sum(r[2] for r in want) > 0
