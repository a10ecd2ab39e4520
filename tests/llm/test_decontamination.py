"""Decontamination against plain searches: every window of every text, every item, without an index."""

import random
from itertools import combinations

import numpy as np
import pytest
from shiori.llm import decontaminate


def held_by(passage, item):
    """Whether a passage holds an item, by sets of word tuples."""
    half = len(item) // 2
    parts = [(item, 0.8)] if half < 5 else [(item[:half], 0.8), (item[half:], 0.8), (item, 0.5)]
    for part, share in parts:
        k = min(5, len(part))
        runs = lambda w: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}  # noqa: E731, B023
        if len(runs(part) & runs(passage)) >= share * len(runs(part)) - 1e-9:
            return True
    return False


def plain(text, items):
    words = decontaminate.words_of(text or "")
    found = set()
    for i, t in items:
        item = decontaminate.words_of(t or "")
        if not item or not words:
            continue
        size = 16
        while size < len(item):
            size *= 2
        starts = range(0, max(1, len(words) - size), size)
        if any(held_by(words[s : s + 2 * size], item) for s in starts):
            found.add(i)
    return sorted(found)


def made(seed, n_items=30, n_texts=120):
    """Items of few and many words, and texts with whole, cut, edited and shuffled pieces of them."""
    rng = random.Random(seed)
    common = ["the", "of", "a", "is", "in", "to"]
    rare = [f"w{i}" for i in range(150)]
    prose = lambda n: [rng.choice(common if rng.random() < 0.5 else rare) for _ in range(n)]
    items = [(i, prose(rng.choice([1, 3, 7, 9, 10, 14, 16, 17, 40, 64, 65, 130]))) for i in range(n_items)]
    items.append((n_items, ["so"] * 20))
    items.append((n_items + 1, items[0][1]))
    texts = []
    for n in range(n_texts):
        words = prose(rng.choice([0, 4, 30, 200, 900]))
        for _ in range(rng.choice([0, 1, 1, 3])):
            piece = list(rng.choice(items)[1])
            a, b = sorted((rng.randint(0, len(piece)), rng.randint(0, len(piece))))
            piece = rng.choice([piece, piece[a:b], piece[len(piece) // 5 : len(piece) * 4 // 5]])
            if piece and rng.random() < 0.4:
                piece[rng.randrange(len(piece))] = rng.choice(rare)
            at = rng.randint(0, len(words))
            words[at:at] = piece
        texts.append((n, " ".join(words)))
    return [(i, " ".join(w)) for i, w in items], texts


@pytest.mark.parametrize("seed", range(4))
def test_index_equals_plain_search(seed):
    items, texts = made(seed)
    got = decontaminate.Index(items).matches([t for _, t in texts])
    want = [plain(t, items) for _, t in texts]
    assert got == want
    assert any(want) and not all(want)


@pytest.mark.parametrize("blocks", [1, 7])
def test_query_equals_plain_search_whatever_the_blocks(spark, blocks):
    items, texts = made(9)
    items += [(500, None), (501, ""), (502, "?!"), (None, "the of a is")]
    texts += [(900, None), (901, "")]
    documents = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    table = spark.createDataFrame(items, "item_id long, text string")
    size = sum(len(t or "") for _, t in items)
    got = {r.doc_id: r.item_ids for r in decontaminate.decontaminated(documents, table, index_bytes=size // blocks + 1).collect()}
    assert got == {i: plain(t, [x for x in items if x[0] is not None]) for i, t in texts}


def test_counts_are_those_of_all_items(spark):
    items, _ = made(3)
    table = spark.createDataFrame(items, "item_id long, text string")
    whole = decontaminate.Index(items)
    want = {i: s.impact[s.item == n].sum() for s in whole.sized for n, i in enumerate(s.ids)}
    got = {}
    for index in decontaminate.indexes(table, 300):
        got |= {i: s.impact[s.item == n].sum() for s in index.sized for n, i in enumerate(s.ids)}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("seed", range(6))
def test_loss_bounds_every_choice_of_left_out_shingles(seed):
    rng = np.random.default_rng(seed)
    n, k = 13, 3
    weights = rng.random(n)
    for drops in range(5):
        most = 0.0
        for left in combinations(range(n - k + 1), drops):
            covered = {p for s in range(n - k + 1) if s not in left for p in range(s, s + k)}
            most = max(most, sum(weights[p] for p in range(n) if p not in covered))
        assert decontaminate.heaviest_loss(weights, drops, k) >= most - 1e-12
        assert decontaminate.heaviest_loss(weights, drops, k) == pytest.approx(most)


def test_middle_of_an_item_counts_and_prose_does_not():
    words = [f"term{i}" for i in range(50)]
    index = decontaminate.Index([(1, " ".join(words))])
    prose = " ".join(f"other{i}" for i in range(400))
    middle = " ".join(words[10:40])
    assert index.matches([f"{prose} {middle} {prose}", prose, " ".join(words[20:35]), ""]) == [[1], [], [], []]


def test_long_item_leaves_windows_of_short_ones_alone():
    short = " ".join(f"a{i}" for i in range(12))
    index = decontaminate.Index([(1, short), (2, " ".join(f"b{i}" for i in range(3000)))])
    assert [s.size for s in index.sized] == [16, 4096]
    assert index.matches([f"{'x ' * 5000}{short}"]) == [[1]]


def test_very_long_text():
    items, _ = made(2)
    text = "the of w1 " * 150_000 + items[5][1]
    assert decontaminate.Index(items).matches([text]) == [plain(text[-5000:], items)]
