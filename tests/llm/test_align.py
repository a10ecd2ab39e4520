"""Alignment of two tokenizers against sets of byte offsets and counters."""

import hashlib
import random
from collections import Counter
from pathlib import Path

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shiori.llm import align, registered

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TABLES = Path("/root/testdata/sf0.001")

TEXTS = [
    "Plain words, it's 12345 of them.",
    "lines\nwithout blanks\n",
    "line\n\nline  two\t tab",
    " leading and trailing ",
    "<|endoftext|> </s> <0x41> [INST]",
    "mark ▁ inside a▁b",
    "日本語の文章 と emoji 🙂🙂 é́",
    "x",
    " ",
    "\n",
    "\x00\x01",
    "ａ\xa0b　c\r\nd",
    "word " * 3000 + "end",
    "",
    None,
    "x",
]


@pytest.fixture(scope="module")
def plain():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = {v: k for k, v in align.byte_letters().items()}

    def tokens(text):
        if not text:
            return None
        ids = a.encode(" " + text, add_special_tokens=False).ids
        back = {c: bytes([n]) for n, c in letters.items()}
        first = [(i, b"".join(back[c] for c in a.id_to_token(i))) for i in ids]
        second = []
        for i in b.encode(text):
            piece = b.id_to_piece(i)
            second.append((i, bytes([int(piece[3:-1], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        if b"".join(x for _, x in first) != whole or b"".join(x for _, x in second) != whole:
            return None
        return first, second

    return tokens


def groups_of(pair):
    """Groups by the offsets at which tokens of both end."""

    def ends(tokens):
        out, at = [], 0
        for i, x in tokens:
            at += len(x)
            out.append((at, i))
        return out

    a, b = ends(pair[0]), ends(pair[1])
    cuts = sorted({e for e, _ in a} & {e for e, _ in b})
    low, groups, links = 0, [], []
    for cut in cuts:
        x, y = [i for e, i in a if low < e <= cut], [i for e, i in b if low < e <= cut]
        groups.append(",".join(map(str, x)) + "|" + ",".join(map(str, y)))
        low = cut
    at_b = dict(b)
    links = [(i, at_b[e]) for e, i in a if e in at_b]
    return groups, links


def brute(rows, plain):
    pairs = [(d, plain(t)) for d, t in rows]
    grouped = [(d, p, *groups_of(p)) if p else (d, None, [], []) for d, p in pairs]
    counts = Counter(link for *_, links in grouped for link in links)
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    out = []
    for d, p, groups, links in grouped:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        best = sum(counts[x] == highest[x[1]] for x in links)
        out.append((d, len(p[0]) if p else 0, len(p[1]) if p else 0, len(groups), digest, len(links), best, sum(counts[x] for x in links)))
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "n_links", "n_best", "count_sum"]


def test_odd_texts(spark, plain):
    rows = [(i if i != 4 else None, t) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("links", F.lit(1)).withColumn("n_a", F.lit("x"))
    got = align.alignment_digest(df, A, B).select(COLUMNS).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute(rows, plain)))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    got = align.alignment_digest(df, A, B)
    assert sorted(got.columns) == sorted(COLUMNS) and got.count() == 0


def test_skipping_equals_sets_of_offsets():
    rng = random.Random(5)
    for _ in range(500):
        n = rng.randrange(1, 200)
        density = rng.choice([0.1, 0.5, 0.95, 1.0])
        a = sorted({x for x in range(1, n) if rng.random() < density} | {n})
        b = sorted({x for x in range(1, n) if rng.random() < rng.choice([density, 0.3])} | {n})
        last_a, last_b = align.common_ends(a, b)
        assert [a[i] for i in last_a] == [b[j] for j in last_b] == sorted(set(a) & set(b))


def whole(encoder, text):
    a = encoder.v.a.encode(" " + text, add_special_tokens=False).ids
    return (a, encoder.v.b.encode(text)) if "▁" not in text else None


def test_pieces_equal_whole_texts():
    encoder = align.Encoder(align.Vocabularies(A, B))
    rng = random.Random(9)
    marks = ["a", "the", "Zug", "é", "12", "'s", ".", "!?", "\n", " ", " ", " ", "  ", "\n\n", "\t", "日本", "<|endoftext|>", "▁", "\r", "<unk>"]
    for _ in range(2000):
        text = "".join(rng.choices(marks, k=rng.randrange(1, 12)))
        assert encoder.text(text) == whole(encoder, text)


def test_emptied_memory(monkeypatch):
    monkeypatch.setattr(align, "REMEMBERED", 5)
    encoder = align.Encoder(align.Vocabularies(A, B))
    for text in ["a b c", "c d e f", "a b", "one two three four five six", "b c d"]:
        assert encoder.text(text) == whole(encoder, text)


def test_linked_pairs_end_alike():
    """The ground of the bound on pairs."""
    v = align.Vocabularies(A, B)
    encoder, seen = align.Encoder(v), set()
    for text in TEXTS:
        ids = encoder.text(text)
        if ids:
            a, b = [v.a_bytes[i] for i in ids[0]], [v.b_bytes[i] for i in ids[1]]
            ends = [[sum(map(len, x[: k + 1])) for k in range(len(x))] for x in (a[:200], b[:200])]
            common = dict(zip(ends[0], ids[0], strict=False)).keys() & dict(zip(ends[1], ids[1], strict=False)).keys()
            for e in common:
                x, y = a[ends[0].index(e)], b[ends[1].index(e)]
                assert x.endswith(y) or y.endswith(x)
                seen.add((x, y))
    assert 0 < len(seen) <= v.pair_bound()


@pytest.mark.skipif(not TABLES.exists(), reason="no test data")
def test_registered_query(spark, plain):
    rows = [tuple(r) for r in registered.table(spark, str(TABLES), "documents").select("doc_id", "text").collect()]
    rows = [(d, t) for d, t in rows]
    got = registered.op13_tokenizer_alignment(spark, str(TABLES)).select(COLUMNS).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, plain))
