"""Row numbers of CSV catalogues: the same for every split size and packing of files."""

import pytest

from shiori.sources import catalogue
from shiori.sources.catalogue import CATALOGUE_COLUMNS, DEFINITION_COLUMNS, build_corpus, read_numbered_csv

ROWS = 1000


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Twelve files of uneven length; names sort in another order than sizes. Some codes are defined twice or thrice."""
    base = tmp_path_factory.mktemp("csv")
    number = 0
    for part in range(12):
        (base / "catalogue").mkdir(exist_ok=True)
        with open(base / "catalogue" / f"part-{part:02d}.csv", "w") as out:
            out.write(",".join(CATALOGUE_COLUMNS) + "\n")
            for _ in range((part * 37) % 150 + 9 if part < 11 else ROWS - number):
                out.write(f"c{number % 700},n{number},full {number},f{number % 5},m,s,survey\n")
                number += 1
    (base / "definitions").mkdir()
    for part in range(3):
        with open(base / "definitions" / f"part-{part}.csv", "w") as out:
            out.write("koumoku_code,definition\n")
            for k in range(0, 300, part + 1):
                out.write(f"c{k},def {k} {part}\n")
    return base


def want():
    out = []
    for row in range(ROWS):
        code = row % 700
        found = [f"def {code} {part}" for part in range(3) if code < 300 and code % (part + 1) == 0] or [""]
        out += [(f"full {row}", d) for d in found]
    return [(k, *r) for k, r in enumerate(out)]


@pytest.mark.parametrize("size,pack", [("256", "1"), ("3000", "1"), ("128m", "4m"), ("700", "100000")])
def test_numbers_do_not_depend_on_splits(spark, folder, size, pack, monkeypatch):
    monkeypatch.setattr(catalogue, "NUMBERED_ROWS", 64)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", pack)
    try:
        rows = read_numbered_csv(spark, str(folder / "catalogue"), CATALOGUE_COLUMNS, multi_line=False)
        definitions = read_numbered_csv(spark, str(folder / "definitions"), DEFINITION_COLUMNS, multi_line=False)
        assert [r["koumoku_name"] for r in rows.orderBy("row_number").collect()] == [f"n{k}" for k in range(ROWS)]
        corpus = build_corpus(rows, definitions).select("doc_id", "koumoku_name_full", "definition").collect()
        assert sorted(map(tuple, corpus)) == want()
        # Without a code that is defined twice ids are the catalogue's own numbers, by the same rule.
        single = build_corpus(rows, definitions.filter("definition like '% 0'"))
        assert sorted(r["doc_id"] for r in single.collect()) == list(range(ROWS))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_quoted_line_breaks_are_one_record(spark, tmp_path):
    (tmp_path / "a.csv").write_text('koumoku_code,definition\nx,"one\ntwo"\ny,"say ""hi"""\n')
    (tmp_path / "b.csv").write_text("koumoku_code,definition\nz,\n")
    rows = read_numbered_csv(spark, str(tmp_path), DEFINITION_COLUMNS).orderBy("row_number").collect()
    assert [tuple(r) for r in rows] == [("x", "one\ntwo", 0), ("y", 'say "hi"', 1), ("z", None, 2)]


def test_missing_and_optional_columns(spark, folder):
    with pytest.raises(ValueError, match="missing columns: nothing"):
        read_numbered_csv(spark, str(folder / "definitions"), ["koumoku_code", "nothing"])
    rows = read_numbered_csv(spark, str(folder / "definitions"), ["koumoku_code", "nothing"], optional=["nothing"])
    assert rows.columns == ["koumoku_code", "row_number"] and rows.count() == 300 + 150 + 100
