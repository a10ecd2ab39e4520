"""Secret scan with multipart credential linking, in DataFrame functions only.

Base kinds are found as they stand. Weak parts (a long mixed token, an endpoint) say little alone. A token is reported if
an access identifier or an endpoint lies at most ``SCOPE`` code points away, an endpoint if a token does; an endpoint beside
an identifier alone is none. An interval join finds them: a part goes to every block of ``SCOPE`` code points that it covers.

Defined results: a null text is an empty one. Rows with the same id are scanned each for itself. Offsets count code
points, the end is exclusive. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import materialise

# The base patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "secret_part", "endpoint")

SECRET_PART = r"(?<![A-Za-z0-9+/])(?=[a-z0-9+/]*[A-Z])(?=[A-Z0-9+/]*[a-z])(?=[A-Za-z+/]*[0-9])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"
ENDPOINT = r"(?:https?://|(?<![a-z0-9-]))[a-z0-9-]+(?:\.[a-z0-9-]+)*\.amazonaws\.com"
# Code points between the parts of one credential.
SCOPE = 400


def _spans(text: Column, kind: str, pattern: str, keep: Column | None = None) -> Column:
    """array<struct(start, kind, end)> of the leftmost matches: what splits the text and what lies between, added up."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    keep = F.transform(found, lambda _: F.lit(True)) if keep is None else keep
    number = F.lit(KINDS.index(kind))
    parts = F.arrays_zip(F.transform(found, F.length).alias("n"), gaps.alias("gap"), keep.alias("keep"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")

    def step(acc, p):
        start = acc["at"] + p["gap"]
        one = F.array(F.struct(start.alias("start"), number.alias("kind"), (start + p["n"]).alias("end")))
        out = F.when(p["n"].isNotNull() & p["keep"], F.concat(acc["out"], one)).otherwise(acc["out"])
        return F.struct((start + F.coalesce(p["n"], F.lit(0))).cast("bigint").alias("at"), out.alias("out"))

    walked = F.aggregate(parts, F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), walked).otherwise(none)


def scanned(documents: DataFrame) -> DataFrame:
    """(row, doc_id, base, weak): spans of the base kinds, and of parts that mean something only together."""
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    long_enough = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= 8)
    base = [
        _spans(text, "assign", ASSIGN, long_enough),
        _spans(text, "access", ACCESS, F.transform(F.regexp_extract_all(text, F.lit(ACCESS), F.lit(0)), lambda v: F.length(v) >= 16)),
        _spans(text, "hex", HEX),
    ]
    # Tokens count beside an identifier or an endpoint only, endpoints beside a token; texts without either are left.
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    weak = F.concat(_spans(text, "secret_part", SECRET_PART), _spans(text, "endpoint", ENDPOINT))
    return rows.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.array_sort(F.concat(*base)).alias("base"),
        F.when(text.rlike(ACCESS) | text.contains(".amazonaws.com"), weak).otherwise(none).alias("weak"),
    )


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(row, start, kind, end) of weak parts with a complementary part at most ``scope`` code points away."""
    part = F.struct("start", "kind", "end")

    def blocks(first: Column, last: Column) -> Column:
        return F.explode(F.sequence(F.floor(first / scope), F.floor(last / scope))).alias("block")

    some = parts.filter(F.size("weak") > 0)
    every = some.select("row", F.inline(F.concat("base", "weak")))
    tokens = every.filter(F.col("kind") == KINDS.index("secret_part")).select("row", part.alias("token"), blocks(F.col("start"), F.col("end")))
    others = every.filter(F.col("kind").isin(KINDS.index("access"), KINDS.index("endpoint")))
    others = others.select("row", part.alias("other"), blocks(F.col("start") - scope, F.col("end") + scope))
    close = (F.col("token.start") <= F.col("other.end") + scope) & (F.col("token.end") >= F.col("other.start") - scope)
    endpoint = F.when(F.col("other.kind") == KINDS.index("endpoint"), F.col("other"))
    found = tokens.join(others, ["row", "block"]).filter(close).select("row", F.explode(F.array("token", endpoint)).alias("part"))
    return found.filter("part is not null").select("row", "part.*").distinct()


def secret_spans(documents: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, base, linked): arrays of spans (start, kind, end); ``kind`` is a place in ``KINDS``."""
    parts = materialise(scanned(documents), "secret-parts")
    more = linked(parts, scope).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("linked"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    joined = parts.filter(F.size("weak") > 0).select("row", "doc_id", "base").join(more, "row", "left")
    plain = parts.filter(F.size("weak") == 0).select("doc_id", "base", none.alias("linked"))
    return joined.select("doc_id", "base", F.coalesce("linked", none).alias("linked")).unionByName(plain)


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
