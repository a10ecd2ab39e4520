import random

import brute

from shiori.operators import facets


def results_of(spark, hits):
    rows = [(q, rank, facet, name) for q, listed in hits.items() for rank, (facet, name) in enumerate(listed, 1)]
    return spark.createDataFrame(rows, "query_id int, rank int, bunya_name string, koumoku_name_full string")


def corpus_of(spark, rows):
    return spark.createDataFrame(
        [(10 * i, f, n) for i, (f, n) in enumerate(rows)], "doc_id bigint, bunya_name string, koumoku_name_full string"
    ).repartition(4)


def groups(items):
    out = {}
    for r in items.orderBy("query_id", "facet_pos", "item_pos").collect():
        query = out.setdefault(r["query_id"], [])
        if r["item_pos"] == 1:
            query.append((r["facet"], []))
        assert r["facet_pos"] == len(query)
        query[-1][1].append(r["name"])
        assert r["item_pos"] == len(query[-1][1])
    return out


def test_expansion_against_plain_python(spark):
    rng = random.Random(5)
    # Field "big" has most rows; its first rows repeat a few names that queries hit.
    corpus = [("big", "dup")] * 30 + [("big", f"n{rng.randrange(40)}") for _ in range(200)]
    corpus += [("small", f"s{i}") for i in range(4)] + [(None, "lost")] * 3
    corpus += [("rep", "one")] * 25 + [("rep", "two")]
    hits = {
        1: [("big", "dup"), ("small", "s1"), ("big", "n3"), ("big", "dup")],
        2: [("small", "s0"), ("rep", "two"), (None, "lost")],
        3: [("big", f"n{i}") for i in range(40)],
        4: [("rep", "one"), ("rep", "one")],
    }
    items = facets.expand(results_of(spark, hits), corpus_of(spark, corpus))
    got = groups(items)
    assert got == {q: brute.expand(listed, corpus) for q, listed in hits.items()}
    assert got[2][1] == ("rep", ["two"] + ["one"] * 10)


def test_summary_details_totals_prompt(spark):
    corpus = [("f", f"c{i:02d}") for i in range(20)] + [("g", "only")]
    hits = {1: [("f", f"c{i:02d}") for i in (7, 3, 9, 1, 0, 2, 4, 5)] + [("g", "only")]}
    items = facets.expand(results_of(spark, hits), corpus_of(spark, corpus)).persist()
    names = dict(brute.expand(hits[1], corpus))
    assert len(names["f"]) == 18
    lines = facets.summary(items).orderBy("facet_pos").collect()
    assert [r["line"] for r in lines] == [
        "【f】(18件利用可能): " + ", ".join(names["f"][:15]),
        "【g】(1件利用可能): only",
    ]
    details = facets.details(items).orderBy("detail_pos").collect()
    assert [r["label"] for r in details] == [f"{n} (f)" for n in names["f"][:12]] + ["only (g)"]
    assert list(facets.totals(items).first()) == [1, 2, 19]
    text = facets.prompt_text(facets.summary(items)).first()["available"]
    assert text == "\n".join(r["line"] for r in lines)


def test_distribution(spark):
    got = facets.distribution(results_of(spark, {1: [("a", "x"), ("a", "y"), ("b", "z")]})).collect()
    assert {(r["facet"], r["n_results"]) for r in got} == {("a", 2), ("b", 1)}
