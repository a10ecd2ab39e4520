import json

import pytest

from shiori.operators import answers, lookup

ANSWER = {
    "analysis_perspectives": [
        {
            "perspective_title": "one",
            "perspective_description": "d",
            "recommended_indicators": [
                {"indicator_name": " Total (A) ", "recommendation_reason": "r"},
                {"indicator_name": "LABOUR"},
                {"indicator_name": "missing"},
                {"recommendation_reason": "no name"},
            ],
        },
        {"recommended_indicators": [{"indicator_name": "nothing"}]},
        {"perspective_title": "empty", "recommended_indicators": []},
    ]
}
NAMES = ["labour force", "total (a) extra", "Total (A)", "Labour cost", "Total (A)", None]


def corpus(spark):
    rows = [(i, n, "field", "mid", "small", f"c{i}") for i, n in enumerate(NAMES)]
    return spark.createDataFrame(
        rows, "doc_id bigint, koumoku_name_full string, bunya_name string, chuubunrui_name string, shoubunrui_name string, koumoku_code string"
    )


def parsed(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "query_id int, response string")
    return answers.parse(df)


@pytest.mark.parametrize(
    "text",
    [
        None,
        "no json",
        "} {",
        '{"analysis_perspectives": [1, 2',
        '{"analysis_perspectives": []} y\n}',
        "{'analysis_perspectives': []}",
        '{"analysis_perspectives": [],}',
        '{"analysis_perspectives": []}, {"analysis_perspectives": []}',
        "{}",
        '{"other": []}',
    ],
)
def test_invalid_answers_are_null(spark, text):
    assert parsed(spark, text).first()["answer"] is None


def test_json_inside_text(spark):
    wrapped = f"Sure:\n```json\n{json.dumps(ANSWER, indent=1)}\n```\nbye"
    row = parsed(spark, wrapped).first()
    assert len(row["answer"]["analysis_perspectives"]) == 3


def test_counts(spark):
    no_list = json.dumps({"analysis_perspectives": [{"perspective_title": "x"}]})
    got = answers.counts(parsed(spark, json.dumps(ANSWER), "nothing", '{"analysis_perspectives": []}', no_list))
    assert [tuple(r) for r in got.orderBy("query_id").collect()] == [(0, True, 5), (1, False, None), (2, True, 0), (3, False, None)]


def test_flatten(spark):
    rows = answers.flatten(parsed(spark, json.dumps(ANSWER), "nothing")).orderBy("perspective_pos", "indicator_pos").collect()
    assert [(r["perspective_pos"], r["title"], r["indicator_pos"], r["name"], r["reason"]) for r in rows] == [
        (1, "one", 1, " Total (A) ", "r"),
        (1, "one", 2, "LABOUR", "理由なし"),
        (1, "one", 3, "missing", "理由なし"),
        (1, "one", 4, None, "no name"),
        (2, "無題の観点", 1, "nothing", "理由なし"),
        (3, "empty", None, None, "理由なし"),
    ]


def test_verified_and_cards(spark):
    flat = answers.flatten(parsed(spark, json.dumps(ANSWER)))
    checked = answers.verified(flat, corpus(spark))
    rows = checked.orderBy("perspective_pos", "indicator_pos").collect()
    assert [(r["indicator_pos"], r["koumoku_code"], r["matched"], r["n_verified"]) for r in rows] == [
        (1, "c2", "exact", 2),
        (2, "c0", "contains", 2),
    ]
    card = answers.cards(checked, "http://b.example/?x=1", "t/c").orderBy("indicator_pos").first()
    assert card["path"] == "field > mid > small"
    assert card["link"] == "http://b.example/?x=1&filter=t/c eq 'c2'"


def asked(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "name string")


def rows_of(df):
    return {r["name"]: (r["matched"], r["doc_id"]) for r in df.collect()}


def test_lookup_is_literal_by_default(spark):
    got = rows_of(lookup.find_rows(asked(spark, "Total (A)", "TOTAL (A)", "labour", "　Labour cost ", "  ", None, "(", "no"), corpus(spark)))
    assert got == {
        "Total (A)": ("exact", 2),
        "TOTAL (A)": ("contains", 1),
        "labour": ("contains", 0),
        "　Labour cost ": ("exact", 3),
        "  ": (None, None),
        "(": ("contains", 1),
        "no": (None, None),
    }


def test_lookup_by_pattern(spark):
    got = rows_of(lookup.find_rows(asked(spark, "TOTAL (A)", "l.*cost", "("), corpus(spark), regex=True))
    assert got == {"TOTAL (A)": (None, None), "l.*cost": ("contains", 3), "(": (None, None)}


def test_names_in_several_blocks(spark):
    keys = [f"name{i:03d}" for i in range(60)]
    rows = [(i, f"x NAME{i % 50:03d} y Name{(i + 1) % 50:03d}") for i in range(200)]
    table = spark.createDataFrame(rows, "doc_id bigint, koumoku_name_full string").repartition(6)
    got = lookup.containing(spark.createDataFrame([(k,) for k in keys], "key string"), table, characters=100)
    want = {k: min(i for i, n in rows if k in n.lower()) for k in keys[:50]}
    assert {r["key"]: r["doc_id"] for r in got.collect()} == want


def test_prompts_and_responder(spark):
    queries = spark.createDataFrame([(1, "q {one}"), (2, "boom")], "query_id int, query string")
    available = spark.createDataFrame([(1, "【f】 a"), (2, "【g】 b")], "query_id int, available string")
    asked_rows = answers.prompts(queries, available)
    row = asked_rows.filter("query_id = 1").first()
    assert "\n【f】 a\n" in row["system_prompt"] and '{"analysis_perspectives": [{' in row["system_prompt"]
    assert row["user_prompt"].endswith("\n\nq {one}")

    def responder(systems, users):
        if users[0].endswith("boom"):
            raise RuntimeError("down")
        return [f"{len(s)} {u[-5:]}" for s, u in zip(systems, users)]

    got = {r["query_id"]: r["response"] for r in answers.respond(asked_rows, responder, batch_size=1).collect()}
    assert got[1].endswith("{one}")
    assert got[2] == answers.FAILURE_PREFIX + "down"


def test_failing_prompt_leaves_its_batch_alone():
    def responder(systems, users):
        if "bad" in users:
            raise RuntimeError("no")
        return [u.upper() for u in users]

    assert answers._answered(responder, ["s"] * 3, ["a", "bad", "c"]) == ["A", answers.FAILURE_PREFIX + "no", "C"]
    try:
        answers._answered(lambda s, u: ["one"], ["s"] * 2, ["a", "b"])
    except ValueError as error:
        assert "1 texts for 2 prompts" in str(error)
    else:
        raise AssertionError("a wrong number of texts must fail")
