"""Line dedup: exact copies, and near copies by a segment-partition edit join, in DataFrame functions only.

Two lines within ``THRESHOLD`` edits share at least one of threshold-plus-one segments of the one, found in the other
near the same place. Each distinct line is indexed by (length, segment, hash of the segment); each asks for the
substrings it would share with a line as long or shorter. What meets is verified with banded edit distance. Between
the steps lines go by a 64-bit hash; equality is by two.

A line goes if an equal line, or one within ``THRESHOLD`` edits, comes earlier: in a document with a smaller id, or
higher up in the same one. Near copies are looked for among lines of ``MIN_CHARS`` and more: in shorter ones two edits
mean too much. Exact copies go from ``min_copy_chars`` on, which is ``MIN_CHARS`` too unless given; with ``ALL_COPIES``
they go at every length. Empty lines stay.

The banded verification is Spark's ``levenshtein`` with a threshold: a bit-parallel one cannot be written in built-in
functions at that speed.

Defined results: a null text stays null and has no lines. Rows with the same id follow each other by a hash of their
texts; rows equal in both count as one and keep the same lines. Ids are integers, null ids come first. Other columns stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import discard, materialise

THRESHOLD = 2
MIN_CHARS = 24
# The least ``min_copy_chars``: exact copies of all lines but empty ones.
ALL_COPIES = 1
# Lines whose hashes may be sent to every task; beyond it they are joined by a shuffle.
BROADCAST_LINES = 50_000
# Hashes of lines that meet others, 8 bytes each, that may be sent to every task to pick out the lines' texts.
BROADCAST_HASHES = 500_000
# Lines under one key that are all held against each other; in larger groups counts of characters tell most pairs apart.
CROWD = 16
# Characters are counted in so many cells, each 16 bits of a line's marks.
CELLS = 32


def _segments(n: Column, parts: int) -> list[tuple[Column, Column]]:
    """(start from 0, length) of each segment of a line of n code points; the last ones take the remainder."""
    base, extra = F.floor(n / parts), n % parts
    out, start = [], F.lit(0).cast("bigint")
    for i in range(parts):
        size = base + F.when(extra >= parts - i, 1).otherwise(0)
        out.append((start, size))
        start = start + size
    return out


def _key(line: Column, start: Column, size: Column, number: int, length: Column) -> Column:
    """Hash of a segment; of a line as long in bytes as in code points the bytes are cut, which needs no count of characters."""
    at, size = (start + 1).cast("int"), size.cast("int")
    cut = F.when(F.octet_length(line) == F.length(line), F.substring(line.cast("binary"), at, size)).otherwise(F.substring(line, at, size).cast("binary"))
    return F.xxhash64(F.lit(number), length, cut)


def line_keys(line: Column, n: Column, threshold: int = THRESHOLD) -> Column:
    """(key, own) of every substring that can match a segment of a line shorter by 0 to ``threshold``; ``own``: its own segments.

    By position: segment i (from 0) can have moved by at most i edits on its left, and by what is left on its right.
    """
    keys = []
    for less in range(threshold + 1):
        m = n - less
        for i, (start, size) in enumerate(_segments(m, threshold + 1)):
            for shift in range(-threshold, threshold + 1):
                if abs(shift) <= i and abs(less - shift) <= threshold - i:
                    at = start + shift
                    inside = (at >= 0) & (at + size <= n) & (m > 0)
                    own = less == 0 and shift == 0
                    keys.append(F.struct(F.when(F.lit(own) | inside, _key(line, at, size, i, m)).alias("key"), F.lit(own).alias("own")))
    return F.array(*keys)


def _order(place: Column) -> Column:
    """A long that never falls as the document's id grows; lines of one document in their order, as far as 21 bits go."""
    most = 1 << 41
    doc = F.greatest(F.lit(-most), F.least(F.lit(most - 1), F.coalesce(place["doc_id"].cast("bigint"), F.lit(-most))))
    return F.shiftleft(doc, 21) + F.least(place["at"], F.lit((1 << 21) - 1))


def lines_of(documents: DataFrame) -> DataFrame:
    """(doc_id, _row, at, line, a, b, n): each line with its place, two hashes and its length."""
    rows = documents.filter("text is not null").select("doc_id", "_row", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    return rows.select("doc_id", "_row", "at", "line", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"), F.length("line").cast("bigint").alias("n"))


def _texts(met: DataFrame, lines: DataFrame) -> DataFrame:
    """The lines that ``met`` names by ``a``; other texts are not moved where the names are few enough to be sent."""
    wanted = materialise(met.select("a").distinct(), "line-names")
    texts = lines.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_HASHES else wanted, "a", "left_semi")
    texts = materialise(texts.select("a", "b", "place", "line"), "line-texts")
    discard(wanted)
    return texts


def _verified(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """(a, b): lines with an earlier partner a2 in ``pairs`` within ``threshold`` edits."""
    other = texts.select(F.col("a").alias("a2"), F.col("place").alias("place2"), F.col("line").alias("line2"))
    near = pairs.join(texts, "a").join(other, "a2").filter(F.col("place2") < F.col("place"))
    return materialise(near.filter(F.levenshtein("line", "line2", threshold) >= 0).select("a", "b").distinct(), "line-near")


def marks_of(texts: DataFrame) -> DataFrame:
    """(a, marks): how often a line has characters of each cell, as bits, four cells to a long.

    Counts that differ by one differ in one bit (a Johnson counter). An edit takes away and adds one character at most, so
    lines within t edits differ in 2 t bits at most. Lines that share their hash have a row each.
    """

    def ones(cells: Column, cell: Column) -> Column:
        n = F.size(F.filter(cells, lambda c: c == cell)) % 32
        below = lambda k: F.call_function("shiftleft", F.lit(1).cast("bigint"), k)
        return F.when(n <= 16, below(n) - 1).otherwise(F.lit(65536).cast("bigint") - below(n - 16))

    def packed(cells: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(CELLS // 4 - 1)), lambda j: reduce(Column.bitwiseOR, [F.shiftleft(ones(cells, 4 * j + k), 16 * k) for k in range(4)]))

    # As an element of an array the cells are worked out once for the line.
    cells = F.transform(F.split("line", ""), lambda x: F.pmod(F.xxhash64(x), F.lit(CELLS)).cast("int"))
    return texts.select("a", F.element_at(F.transform(F.array(cells), packed), 1).alias("marks"))


def _may_be_near(marks: str, marks2: str, threshold: int) -> Column:
    differ = [F.bit_count(F.col(marks)[k].bitwiseXOR(F.col(marks2)[k])) for k in range(CELLS // 4)]
    return F.coalesce(sum(differ[1:], differ[0]) <= 2 * threshold, F.lit(True))


def doomed_lines(rows: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, min_copy_chars: int | None = None) -> DataFrame:
    """(a, b, place): lines that have copies or an earlier near copy; ``place`` is where one stays, or null for nowhere."""
    some = lines_of(rows).filter(F.col("n") >= (min_chars if min_copy_chars is None else min(min_chars, min_copy_chars)))
    # Equal lines meet map-side first; each text is moved once, and its keys are made after that.
    spot = F.xxhash64("doc_id", "_row", "at")
    lines = materialise(
        some.groupBy("a", "b", "n").agg(
            F.min(F.struct("doc_id", "_row", "at")).alias("place"), (F.min(spot) != F.max(spot)).alias("copies"), F.first(F.when(F.col("n") >= min_chars, F.col("line"))).alias("line")
        ),
        "lines",
    )
    keyed = lines.filter(F.col("n") >= min_chars).select("a", _order(F.col("place")).alias("o"), F.inline(line_keys(F.col("line"), F.col("n"), threshold)))
    # One exchange by key: its rows are read once to tell the keys that lines share, and once to pick out those lines.
    keyed = keyed.filter("key is not null").repartition("key")
    heads = keyed.groupBy("key").agg(
        F.min_by("a", "o").alias("first"),
        F.min_by("a", F.when(F.col("own"), F.col("o"))).alias("first_own"),
        (F.min("a") != F.max("a")).alias("several"),
        F.max("own").alias("indexed"),
        F.count("*").alias("size"),
    )
    heads = heads.filter("several and indexed").select("key", "first", "first_own", "size")
    # The keys kept are far fewer than all: they are hashed, so that the others need no sorting.
    met = materialise(keyed.join(heads.hint("shuffle_hash"), "key").select("key", "a", "o", "own", "first", "first_own", "size"), "line-met")
    # Each line with the earliest of those it meets: as many rows as keys, however large the groups. Most lines of a
    # large group fall to its earliest one; only those that don't are held against the rest.
    firsts = F.explode(F.array("first_own", F.when(F.col("own"), F.col("first")))).alias("a2")
    quick = materialise(met.select("a", firsts).filter("a2 is not null and a2 <> a").distinct(), "line-pairs")
    texts = _texts(met, lines)
    gone = _verified(quick, texts, threshold)
    crowded = met.filter(F.col("size") > CROWD).select("a").distinct()
    marks = marks_of(texts.join(crowded, "a", "left_semi"))
    marked = materialise(met.select("key", "a", "o", "own").join(marks, "a", "left"), "line-marked")
    left = marked.join(gone.select("a"), "a", "left_anti")
    others = marked.select("key", F.col("a").alias("a2"), F.col("o").alias("o2"), F.col("own").alias("own2"), F.col("marks").alias("marks2"))
    earlier = F.shiftright("o2", 21) <= F.shiftright("o", 21)
    some = (F.col("own") | F.col("own2")) & (F.col("a") != F.col("a2")) & earlier & _may_be_near("marks", "marks2", threshold)
    rest = left.join(others, "key").filter(some).select("a", "a2").distinct()
    rest = materialise(rest.join(quick, ["a", "a2"], "left_anti"), "line-pairs")
    discard(met, marked, quick)
    later = _verified(rest, texts, threshold)
    near = gone.union(later).withColumn("near", F.lit(True))
    doomed = materialise(
        lines.join(near, ["a", "b"], "left")
        .filter(F.col("copies") | F.col("near").isNotNull())
        .select("a", "b", F.when(F.col("near").isNull(), F.col("place")).alias("place")),
        "line-doomed",
    )
    discard(lines, texts, rest, gone, later)
    return doomed


def dedup_lines(documents: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, min_copy_chars: int | None = None) -> DataFrame:
    """The rows of ``documents`` with their texts cut to the lines that stay, ``n_lines`` and ``n_removed``."""
    least = min_chars if min_copy_chars is None else min(min_chars, min_copy_chars)
    others = [c for c in documents.columns if c not in ("doc_id", "text", "n_lines", "n_removed")]
    rows = documents.select(
        "doc_id", "text", F.struct(F.lit(0).alias("_0"), *[F.col(f"`{c}`") for c in others]).alias("_others"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_row")
    )
    doomed = doomed_lines(rows.select("doc_id", "_row", "text"), threshold, min_chars, min_copy_chars)
    if doomed.count() <= BROADCAST_LINES:
        doomed = F.broadcast(doomed)
    here = F.struct("doc_id", "_row", "at")
    hit = (
        lines_of(rows).filter(F.col("n") >= least).select("a", "b", "doc_id", "_row", "at")
        .join(doomed, ["a", "b"])
        .filter(F.col("place").isNull() | (F.col("place") != here))
    )
    # Places that go, as a list for each document; a place counts once however many equal rows hold it.
    gone = hit.groupBy(F.col("doc_id").alias("_doc"), F.col("_row").alias("_r")).agg(F.collect_set("at").alias("gone"))
    lines = F.split("text", "\n", -1)
    kept = F.filter(F.transform(lines, lambda x, i: F.when(~F.array_contains("gone", i), x)), lambda x: x.isNotNull())
    joined = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_row") == F.col("_r")), "left")
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return joined.select(
        *[text.alias(c) if c == "text" else F.col("_others").getField(c).alias(c) if c in others else F.col(c) for c in documents.columns if c not in ("n_lines", "n_removed")],
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
    )
