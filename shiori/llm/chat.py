"""Chat formatting: a small sandboxed template language, compiled to Python closures.

The language: text, ``{{ expression }}``, ``{% for x in name %}…{% endfor %}``, ``{% if e %}…{% elif e %}…{% else %}…
{% endif %}`` and ``{% generation %}…{% endgeneration %}``. Expressions are strings, names, ``name.key``, ``==``,
``!=``, ``not``, ``and``, ``or``, ``+``, parentheses and ``| filter``. Nothing else can be reached: a key is a plain
look-up in the row, a filter is one of ``FILTERS``.

A template becomes a syntax tree, constants in it are folded, and each node becomes a closure that yields (piece of
output, is generated). Loops take any iterator, so a conversation is formatted as a stream.

Texts are escaped: every character that can begin a control string, and the escape sign itself, becomes the sign and a
letter; ``unescape`` is its inverse.

Defined results: a null text or role is an empty one. Turns with equal numbers follow by role, then by text; null turns
come first. Rows without a conversation id form one conversation without one. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEMPLATE = (
    "{% for m in turns %}"
    "{{ '<' + 's>' }}[ROLE]{{ m.role | escape }}[/ROLE]"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}[INST]{{ m.text | escape }}[/INST]{% endif %}"
    "</s>"
    "{% endfor %}"
)

# Every control string of the template begins with one of these signs.
ESCAPED = str.maketrans({"\\": "\\\\", "<": "\\l", "[": "\\b"})
UNESCAPED = {"\\\\": "\\", "\\l": "<", "\\b": "["}


def escape(text: str) -> str:
    return text.translate(ESCAPED)


def unescape(text: str) -> str:
    return re.sub(r"\\[\\lb]", lambda m: UNESCAPED[m[0]], text)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "trim": str.strip, "lower": str.lower, "upper": str.upper}

TOKEN = re.compile(r"""\s*(?:('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|([A-Za-z_]\w*)|(==|!=|[().|+]))""")


class TemplateError(ValueError):
    pass


class _Expression:
    """Syntax tree of one expression: ("const", v), ("name", n), ("key", e, k), ("filter", f, e), ("not", e), (op, a, b)."""

    def __init__(self, source: str):
        self.tokens, at, source = [], 0, source.strip()
        while at < len(source):
            if not (m := TOKEN.match(source, at)):
                raise TemplateError(f"unexpected {source[at:]!r}")
            self.tokens.append(m.groups())
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return next((x for x in self.tokens[self.at] if x), None) if self.at < len(self.tokens) else None

    def take(self, *wanted: str) -> bool:
        if self.peek() in wanted:
            self.at += 1
            return True
        return False

    def tree(self) -> tuple:
        found = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.peek()!r}")
        return found

    def either(self) -> tuple:
        left = self.both()
        while self.take("or"):
            left = ("or", left, self.both())
        return left

    def both(self) -> tuple:
        left = self.negated()
        while self.take("and"):
            left = ("and", left, self.negated())
        return left

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        left = self.added()
        while (op := self.peek()) in ("==", "!="):
            self.at += 1
            left = (op, left, self.added())
        return left

    def added(self) -> tuple:
        left = self.filtered()
        while self.take("+"):
            left = ("+", left, self.filtered())
        return left

    def filtered(self) -> tuple:
        left = self.atom()
        while self.take("|"):
            name = self.peek()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            left = ("filter", name, left)
        return left

    def atom(self) -> tuple:
        if self.at >= len(self.tokens):
            raise TemplateError("the expression ends early")
        text, name, sign = self.tokens[self.at]
        self.at += 1
        if text:
            return ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1]))
        if name:
            found: tuple = ("name", name)
            while self.take("."):
                key = self.tokens[self.at][1] if self.at < len(self.tokens) else None
                if not key or key.startswith("_"):
                    raise TemplateError("a key must be a plain name")
                self.at += 1
                found = ("key", found, key)
            return found
        if sign == "(":
            found = self.either()
            if self.take(")"):
                return found
        raise TemplateError(f"unexpected {sign!r}")


def folded(e: tuple) -> tuple:
    """The expression with constant parts worked out."""
    if e[0] in ("const", "name"):
        return e
    if e[0] == "key":
        return ("key", folded(e[1]), e[2])
    parts = [folded(x) if isinstance(x, tuple) else x for x in e[1:]]
    new = (e[0], *parts)
    if all(p[0] == "const" for p in parts if isinstance(p, tuple)):
        return ("const", expression(new)({}))
    return new


def expression(e: tuple) -> Callable[[dict], object]:
    match e:
        case ("const", value):
            return lambda _: value
        case ("name", name):
            return lambda scope: scope[name]
        case ("key", of, key):
            of = expression(of)
            return lambda scope: of(scope)[key]
        case ("filter", name, of):
            of, apply = expression(of), FILTERS[name]
            return lambda scope: apply(of(scope))
        case ("not", of):
            of = expression(of)
            return lambda scope: not of(scope)
        case (op, left, right):
            a, b = expression(left), expression(right)
            return {
                "==": lambda scope: a(scope) == b(scope),
                "!=": lambda scope: a(scope) != b(scope),
                "+": lambda scope: a(scope) + b(scope),
                "and": lambda scope: a(scope) and b(scope),
                "or": lambda scope: a(scope) or b(scope),
            }[op]
    raise TemplateError(f"unknown expression {e[0]}")


Pieces = Iterator[tuple[str, bool]]
Node = Callable[[dict, bool], Pieces]


def parse(source: str) -> list[tuple]:
    """The syntax tree: ("text", s), ("show", e), ("for", name, over, body), ("if", [(test, body)…]), ("generation", body)."""
    parts = [p for p in re.split(r"(\{\{.*?\}\}|\{%.*?%\})", source, flags=re.S) if p]
    at = 0

    def body(*ends: str) -> tuple[list[tuple], str, str]:
        nonlocal at
        out: list[tuple] = []
        while at < len(parts):
            part = parts[at]
            at += 1
            if part.startswith("{{"):
                out.append(("show", _Expression(part[2:-2]).tree()))
            elif not part.startswith("{%"):
                out.append(("text", part))
            else:
                word, _, rest = part[2:-2].strip().partition(" ")
                if word in ends:
                    return out, word, rest
                if word == "for":
                    m = re.fullmatch(r"\s*([A-Za-z]\w*)\s+in\s+([A-Za-z]\w*)\s*", rest)
                    if not m:
                        raise TemplateError(f"a loop needs a name: {rest!r}")
                    out.append(("for", m[1], m[2], body("endfor")[0]))
                elif word == "generation":
                    out.append(("generation", body("endgeneration")[0]))
                elif word == "if":
                    cases, test = [], _Expression(rest).tree()
                    while True:
                        inside, word, rest = body("elif", "else", "endif")
                        cases.append((test, inside))
                        if word == "endif":
                            break
                        test = _Expression(rest).tree() if word == "elif" else ("const", True)
                    out.append(("if", cases))
                else:
                    raise TemplateError(f"unexpected {word!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return out, "", ""

    return body()[0]


def fold(nodes: list[tuple]) -> list[tuple]:
    """Constant shows become text, constant cases go, and texts that follow each other are joined."""
    out: list[tuple] = []
    for node in nodes:
        if node[0] == "show":
            e = folded(node[1])
            node = ("text", str(e[1])) if e[0] == "const" else ("show", e)
        elif node[0] == "for":
            node = (*node[:3], fold(node[3]))
        elif node[0] == "generation":
            node = ("generation", fold(node[1]))
        elif node[0] == "if":
            cases = [(folded(test), fold(inside)) for test, inside in node[1]]
            cases = [c for c in cases if c[0][0] != "const" or c[0][1]]
            last = next((i for i, c in enumerate(cases) if c[0][0] == "const"), len(cases))
            node = ("if", cases[: last + 1])
            if last == 0:
                more = cases[0][1] if cases else []
                out.extend(more)
                continue
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        else:
            out.append(node)
    return out


def _sequence(nodes: list[tuple]) -> Node:
    made = [_node(n) for n in nodes]

    def run(scope: dict, generated: bool) -> Pieces:
        for node in made:
            yield from node(scope, generated)

    return run


def _node(node: tuple) -> Node:
    match node:
        case ("text", text):
            return lambda scope, generated: iter(((text, generated),))
        case ("show", e):
            value = expression(e)
            return lambda scope, generated: iter(((str(value(scope)), generated),))
        case ("generation", body):
            inside = _sequence(body)
            return lambda scope, generated: inside(scope, True)
        case ("for", name, over, body):
            each = _sequence(body)

            def loop(scope: dict, generated: bool) -> Pieces:
                for item in scope[over]:
                    yield from each(scope | {name: item}, generated)

            return loop
        case ("if", cases):
            made = [(expression(test), _sequence(body)) for test, body in cases]

            def choose(scope: dict, generated: bool) -> Pieces:
                for test, body in made:
                    if test(scope):
                        yield from body(scope, generated)
                        return

            return choose
    raise TemplateError(f"unknown node {node[0]}")


def compile_template(source: str) -> Callable[..., Pieces]:
    """A function of the template's names that yields (text, is generated)."""
    run = _sequence(fold(parse(source)))
    return lambda **names: run(names, False)


TURN = re.compile(r"<s>\[ROLE\]([^<\[]*)\[/ROLE\](?:\[INST\]([^<\[]*)\[/INST\]|([^<\[]*))</s>")


def ordered(conversations: DataFrame) -> DataFrame:
    """Rows of a conversation side by side and in order; nothing is gathered, so a conversation may be of any length."""
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")],
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[dict]]]:
    """Each conversation and its turns, as streams; the turns must be used up before the next conversation."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    row = next(rows, None)

    def turns(of) -> Iterator[dict]:
        nonlocal row
        while row is not None and row[0] == of:
            now, row = row, next(rows, None)
            yield {"role": now[2], "text": now[3]}

    while row is not None:
        yield row[0], turns(row[0])


def formatted(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, part, text, generated): the output in pieces, to be joined by ``part``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        out: list[list] = [[], [], [], []]
        size = 0
        for conv_id, turns in _conversations(batches):
            for part, (text, generated) in enumerate(render(turns=turns)):
                for column, value in zip(out, (conv_id, part, text, generated), strict=True):
                    column.append(value)
                size += len(text)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)
                    out, size = [[], [], [], []], 0
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    names = ["conv_id", "part", "text", "generated"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.bool_()]
    return ordered(conversations).mapInArrow(run, "conv_id bigint, part bigint, text string, generated boolean")


def read_back(parts: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), from formatted output alone."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        row, out = next(rows, None), []
        while row is not None:
            conv_id, rest, n, chars, loss_chars = row[0], "", 0, 0, 0
            turns, loss = hashlib.sha256(), hashlib.sha256()
            while row is not None and row[0] == conv_id:
                text, generated = row[2], row[3]
                chars += len(text)
                if generated:
                    plain = unescape(text)
                    loss_chars += len(plain)
                    loss.update(plain.encode())
                rest += text
                at = 0
                if text.endswith("</s>"):
                    for m in TURN.finditer(rest):
                        if m.start() != at:
                            raise ValueError("the output is not a sequence of turns")
                        at = m.end()
                        said = m[2] if m[2] is not None else m[3]
                        turns.update(f"{unescape(m[1])}\n{unescape(said)}\n".encode())
                        n += 1
                    rest = rest[at:]
                row = next(rows, None)
            if rest:
                raise ValueError("the output ends inside a turn")
            out.append((conv_id, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    schema = pa.schema([(c, pa.string() if "sha" in c else pa.int64()) for c in names])
    columns = ", ".join(f"{c} {'string' if 'sha' in c else 'bigint'}" for c in names)
    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(run, columns)
