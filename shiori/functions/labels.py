"""Display strings built from catalogue columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import or_blank

# Label formats and default labels.
UNTITLED = "無題の観点"
NO_REASON = "理由なし"
SUMMARY_FORMAT = "【%s】(%d件利用可能): %s"
PATH_SEPARATOR = " > "
NAME_SEPARATOR = ", "


def path(*levels: Column) -> Column:
    return F.concat_ws(PATH_SEPARATOR, *[or_blank(c) for c in levels])


def link(base: str, column: str, code: Column) -> Column:
    """Report link that filters ``column`` on one code."""
    return F.concat(F.lit(f"{base}&filter={column} eq '"), or_blank(code), F.lit("'"))


def named(name: Column, facet: Column) -> Column:
    return F.concat(name, F.lit(" ("), facet, F.lit(")"))


def titled(title: Column) -> Column:
    return F.coalesce(title, F.lit(UNTITLED))


def described(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def reasoned(reason: Column) -> Column:
    return F.coalesce(reason, F.lit(NO_REASON))
