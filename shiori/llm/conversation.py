"""Repair of conversation structure: the cheapest edits that make the roles of a conversation alternate.

A conversation's rows, by turn, are the steps of a lattice; its other side is the state of the wanted pattern, an optional
system row and then pairs of user and assistant. Edits are its edges: Keep (0), Rerole to user or assistant (3), Delete
(4, the only one for blank and repeated rows) and Insert an empty user or assistant row (3). A truncated row that is
not deleted adds 3. A forward heap from the start and a reverse heap from the ends settle nodes by cost until they meet; all
crossings of equal cost are then settled as well, and among the cheapest paths the one of least written audit is walked. State and
edit settle the new role, so an audit belongs to one path only.

Rows are placed by conversation and streamed in order. A task holds a sign and a 16-byte digest per row of one
conversation (its audit, a value of the result, is as long), never its texts: the edits are found first, and come ahead of the rows when those
are streamed again.

Defined results: null roles and texts are read as one space. Rows of one turn go by role, then text; null turns come first.
Rows with a null ``conv_id`` are one conversation. An empty role has no initial. A conversation without rows is not in
the results. Equal rows are repeats. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import materialise

# White space, marks that end a text, costs of the edits, neighbours in order.
SPACE = " \t\n\x0b\x0c\r"
MARKS = ".!?"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NEIGHBOURS = {"su", "ua", "au"}
ROLES = {"u": "user", "a": "assistant"}

# The wanted pattern (s?(ua)+)? as an automaton: state -> initial -> state. It may end in the states of ENDS.
PATTERN = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
STATES = len(PATTERN)

# A row for the lattice: what may be kept ('s', 'u', 'a', '-' for another role), in capitals if truncated; 'x' must go.
MUST_GO = "x"

# Conversations up to this length are remembered by their rows.
REMEMBERED_ROWS = 64
REMEMBERED = 100_000
# Rows passed on together.
BATCH_ROWS = 10_000

FOUND = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
REPAIRED = "conv_id bigint, position bigint, edit string, role string, text string"


def _edges(rows: str, node: int) -> Iterator[tuple[str, int, int]]:
    """(edit, cost, next node) out of a node; a node is row * STATES + state."""
    i, state = divmod(node, STATES)
    for target in PATTERN[state].values():
        if target != 1:
            yield "I", INSERT, i * STATES + target
    if i == len(rows):
        return
    row, after = rows[i], (i + 1) * STATES
    yield "D", DELETE, after + state
    if row != MUST_GO:
        extra = TRUNCATED if row.isupper() or row == "=" else 0
        kept = PATTERN[state].get(row.lower())
        if kept is not None:
            yield "K", extra, after + kept
        for target in PATTERN[state].values():
            if target != 1:
                yield "R", REROLE + extra, after + target


def _into(rows: str, node: int) -> Iterator[tuple[int, int]]:
    """(cost, node before) of the edges into a node."""
    i, state = divmod(node, STATES)
    before = [s for s in range(STATES) if state in PATTERN[s].values()]
    if state != 1:
        for s in before:
            yield INSERT, i * STATES + s
    if i == 0:
        return
    row, at = rows[i - 1], (i - 1) * STATES
    yield DELETE, at + state
    if row != MUST_GO:
        extra = TRUNCATED if row.isupper() or row == "=" else 0
        for s in before:
            if PATTERN[s].get(row.lower()) == state:
                yield extra, at + s
            if state != 1:
                yield REROLE + extra, at + s


def cheapest(rows: str) -> tuple[int, str]:
    """Cost and audit of the cheapest edits, of equal ones those whose audit comes first.

    ``rows`` has a sign per row: s, u, a, or - for another role; S, U, A and = if truncated; x if it must go.
    """
    last = len(rows) * STATES
    sides = ({0: 0}, {last + s: 0 for s in ENDS})
    settled: tuple[dict[int, int], dict[int, int]] = ({}, {})
    heaps = [[(0, node) for node in side] for side in sides]
    best = None
    while heaps[0] and heaps[1]:
        # What is not settled on either side costs at least both tops; beyond the best crossing nothing can equal it.
        if best is not None and heaps[0][0][0] + heaps[1][0][0] > best:
            break
        way = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        cost, node = heapq.heappop(heaps[way])
        if node in settled[way]:
            continue
        settled[way][node] = cost
        known, other = sides[way], sides[1 - way]
        if node in other and (best is None or cost + other[node] < best):
            best = cost + other[node]
        steps = ((c, n) for _, c, n in _edges(rows, node)) if way == 0 else _into(rows, node)
        for step, target in steps:
            reached = cost + step
            if reached < known.get(target, reached + 1):
                known[target] = reached
                heapq.heappush(heaps[way], (reached, target))
                if target in other and (best is None or reached + other[target] < best):
                    best = reached + other[target]
    forward, reverse = sides
    # Nodes from which a cheapest path goes on: behind the crossings those of the reverse side, before them what leads there.
    # A known cost is exact on a cheapest path where both sides add up to the best.
    onward = {n for n in reverse if n in forward and forward[n] + reverse[n] == best}
    todo = list(onward)
    while todo:
        node = todo.pop()
        for step, before in _into(rows, node):
            if before not in onward and before in forward and forward[before] + step == forward[node]:
                onward.add(before)
                todo.append(before)
    audit, node, spent = [], 0, 0
    while spent < best or node not in (last, last + 3):
        for edit, step, target in sorted(_edges(rows, node)):
            there = spent + step
            ahead = target in onward and forward[target] == there
            behind = reverse.get(target) == best - there
            if ahead or behind:
                audit.append(edit)
                node, spent = target, there
                break
        else:
            raise AssertionError("the cheapest path broke off")
    return best, "".join(audit)


def _plain(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) without nulls in role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    return rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role, text)


def _ordered(rows: DataFrame, *first: Column) -> DataFrame:
    """Whole conversations in one partition each, their rows in order."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *first, F.asc_nulls_first("turn"), "role", "text")


def _by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, int | None, pa.RecordBatch]]:
    """Runs of rows of one ``conv_id``, the first column: whether the run begins a conversation, the id, the rows."""
    before: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_pylist()
        cuts = [0, *[k for k in range(1, len(ids)) if ids[k] != ids[k - 1]], len(ids)]
        for low, high in zip(cuts, cuts[1:], strict=False):
            yield before != (ids[low],), ids[low], batch.slice(low, high - low)
            before = (ids[low],)


class _Conversation:
    """What is kept of the rows of one conversation while they pass."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.signs: list[str] = []
        self.seen: set[bytes] = set()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = None
        self.initial: str | None = None

    def add(self, turn: int | None, role: str, blank: bool, ended: bool, digest: bytes) -> None:
        if turn is not None and turn != self.last:
            self.turns += 1
            self.first, self.last = turn if self.first is None else self.first, turn
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in NEIGHBOURS:
            self.illegal += 1
        self.initial = initial
        sign = initial if initial in ("s", "u", "a") else "-"
        if blank:
            self.blank += 1
            sign = MUST_GO
        elif digest in self.seen:
            self.duplicate += 1
            sign = MUST_GO
        elif not ended:
            self.truncated += 1
            sign = "=" if sign == "-" else sign.upper()
        self.seen.add(digest)
        self.signs.append(sign)

    def row(self, remembered: Callable[[str], tuple[int, str]]) -> tuple:
        rows = "".join(self.signs)
        cost, audit = (remembered if len(rows) <= REMEMBERED_ROWS else cheapest)(rows)
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


def _batch(rows: Sequence[tuple], types: Sequence[pa.DataType], names: Sequence[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in types]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=list(names))


def findings(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation.

    Each row counts for its first fault: blank, duplicate (role and text came earlier), truncated (its last character
    that is not white space ends no sentence). ``illegal`` counts neighbours out of order, ``gaps`` the turns left out.
    """
    bare = F.btrim("text", F.lit(SPACE))
    ended = F.right(bare, F.lit(1)).isin(*MARKS)
    digest = F.unhex(F.md5(F.concat_ws("\x00", F.length("role").cast("string"), "role", "text")))
    known = _ordered(_plain(rows)).select("conv_id", "turn", "role", (bare == "").alias("blank"), ended.alias("ended"), digest.alias("digest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 7 + [pa.string()]
        names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
        remembered = lru_cache(REMEMBERED)(cheapest)
        out: list[tuple] = []
        current: _Conversation | None = None
        for new, conv_id, part in _by_conversation(batches):
            if new:
                if current is not None:
                    out.append(current.row(remembered))
                current = _Conversation(conv_id)
                if len(out) >= BATCH_ROWS:
                    yield _batch(out, types, names)
                    out = []
            for values in zip(*[part.column(c).to_pylist() for c in range(1, 6)], strict=True):
                current.add(*values)
        if current is not None:
            out.append(current.row(remembered))
        yield _batch(out, types, names)

    return known.mapInArrow(run, FOUND)


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, position, edit, role, text): the rows of every repaired conversation in order; ``found`` has the audits.

    Rows of a conversation lie in one partition, in order.
    """
    audits = found.select(
        "conv_id", F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).alias("place")
    )
    both = audits.unionByName(_plain(rows).withColumn("place", F.lit(1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        names = ["conv_id", "position", "edit", "role", "text"]
        out: list[tuple] = []
        audit, at, state, position = "", 0, 0, 0

        def put(conv_id: int | None, edit: str, role: str, text: str, initial: str) -> None:
            nonlocal state, position
            out.append((conv_id, position, edit, role, text))
            state, position = PATTERN[state][initial], position + 1

        def inserted(conv_id: int | None) -> None:
            nonlocal at
            while audit[at : at + 1] == "I":
                initial = "a" if "a" in PATTERN[state] else "u"
                put(conv_id, "I", ROLES[initial], "", initial)
                at += 1

        before = None
        for new, conv_id, part in _by_conversation(batches):
            places, roles, texts = (part.column(c).to_pylist() for c in (4, 2, 3))
            if new:
                if before is not None:
                    inserted(before[0])
                audit, at, state, position, before = texts[0], 0, 0, 0, (conv_id,)
            for place, role, text in zip(places, roles, texts, strict=True):
                if place == 0:
                    continue
                inserted(conv_id)
                edit = audit[at]
                at += 1
                if edit == "K":
                    put(conv_id, "K", role, text, role[:1])
                elif edit == "R":
                    initial = "a" if "a" in PATTERN[state] else "u"
                    put(conv_id, "R", ROLES[initial], text, initial)
                if len(out) >= BATCH_ROWS:
                    yield _batch(out, types, names)
                    out.clear()
        if before is not None:
            inserted(before[0])
        yield _batch(out, types, names)

    return _ordered(both, F.col("place")).select("conv_id", "turn", "role", "text", "place").mapInArrow(run, REPAIRED)


def text_digests(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the rows of ``repaired``: ``role:text`` a line, read as they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        digest, current, first = None, None, True
        for new, conv_id, part in _by_conversation(batches):
            if new:
                if digest is not None:
                    out.append((current, digest.hexdigest()))
                digest, current, first = hashlib.sha256(), conv_id, True
            for role, text in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
        if digest is not None:
            out.append((current, digest.hexdigest()))
        yield _batch(out, [pa.int64(), pa.string()], ["conv_id", "repaired_sha256"])

    return rows.select("conv_id", "role", "text").mapInArrow(run, "conv_id bigint, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with faults put in by the remainder of crc32(conv_id:turn) by 20; nulls are one space in key, role and text.

    0 leaves the row out, 1 empties its text, 2 takes out the marks that end sentences, 3 repeats it, 4 makes it a user's.
    """
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fault = F.crc32(key.cast("binary")) % 20
    plain = _plain(rows).withColumn("fault", fault).filter("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", MARKS, "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return plain.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("_copy")).drop("_copy")


def damage_and_repair(rows: DataFrame) -> DataFrame:
    """Every conversation of ``rows`` with what was found in it after ``damaged``, and a digest of its repaired rows."""
    every = rows.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    broken = damaged(rows)
    found = materialise(findings(broken), "audits")
    digests = text_digests(repaired(broken, found))
    counts = [c for c in found.columns if c not in ("conv_id", "audit")]
    full = every.alias("e")
    for table in (found.alias("f"), digests.alias("d")):
        right = table.withColumnRenamed("conv_id", "_id")
        full = full.join(right, F.col("conv_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    return full.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
