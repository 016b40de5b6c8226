"""Text helpers on string columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..vocab import LINE_BREAK, UNUSUAL_BREAKS, WHITESPACE


def strip(text: Column) -> Column:
    """Drop Unicode white space at both ends (Spark's own trim knows spaces only)."""
    return F.btrim(text, F.lit(WHITESPACE))


def unix_lines(text: Column) -> Column:
    """Every kind of line end as ``\\n``; most texts have no other and stay untouched."""
    unusual = reduce(Column.__or__, [text.contains(char) for char in UNUSUAL_BREAKS])
    return F.when(unusual, F.regexp_replace(text, LINE_BREAK, "\n")).otherwise(text)


def first_nonempty(*candidates: Column) -> Column:
    """First candidate that is neither null nor the empty string, else null."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates])


def escape_literal(text: Column) -> Column:
    """Escape for a Turtle string: backslash first, then the quote. Line ends stay."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
