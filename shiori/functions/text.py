"""Text expressions: Unicode white space, tokens, n-grams, cleaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters and default text that results depend on.
# White space is what Python's str.split() takes for it, wider than Java's \s (it has U+3000).
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WORD = r"[\p{L}\p{N}_]{2,}+"
BLANK_TEXT = "統計指標"


def strip(text: Column) -> Column:
    """Trim Unicode white space at both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def or_blank(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def clean(text: Column) -> Column:
    """Stripped text; null and blank become the default text."""
    stripped = strip(or_blank(text))
    return F.when(stripped == "", F.lit(BLANK_TEXT)).otherwise(stripped)


def is_blank(text: Column) -> Column:
    return strip(or_blank(text)) == ""


def space_tokens(text: Column) -> Column:
    """White-space tokens, case kept; null gives none.

    Mapping every kind of white space to a space first is several times faster than a regex class.
    """
    spaced = F.translate(or_blank(text), WHITE_SPACE, " " * len(WHITE_SPACE))
    return F.array_remove(F.split(spaced, " "), "")


def word_tokens(text: Column, stop_words: Sequence[str] = ()) -> Column:
    """Lower-cased runs of two or more word characters, without the stop words."""
    words = F.regexp_extract_all(F.lower(or_blank(text)), F.lit(f"({WORD})"), F.lit(1))
    if stop_words:
        words = F.filter(words, lambda w: ~w.isin(list(stop_words)))
    return words


def neighbours(tokens: Column, join: bool = True) -> Column:
    """Adjacent token pairs, as 'a b' strings or as (a, b) structs.

    ``tokens`` should be a stored column: it is evaluated several times.
    """
    pairs = F.greatest(F.size(tokens) - 1, F.lit(0))
    left, right = F.slice(tokens, F.lit(1), pairs), F.slice(tokens, F.lit(2), pairs)
    if join:
        return F.zip_with(left, right, lambda a, b: F.concat(a, F.lit(" "), b))
    return F.zip_with(left, right, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def ngrams(tokens: Column) -> Column:
    """The tokens followed by their adjacent pairs."""
    return F.concat(tokens, neighbours(tokens))
