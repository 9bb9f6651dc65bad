"""Words of texts, compared without case, punctuation, spacing and markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words: all but letters, marks and digits, in few ranges, for a pattern's time grows with their number.
SEPARATORS = r"[^a-z0-9À-\u1fff\u2c00-\u2fdf\u3040-\uffdc]+"


def plain(c: Column) -> Column:
    """Lower-case text with tags and entities replaced by blanks and apostrophes removed; null gives null."""
    marked = r"<[/!a-zA-Z][^<>]*>|&#?\w{1,8};"
    bare = F.when(F.contains(c, F.lit("<")) | F.contains(c, F.lit("&")), F.regexp_replace(c, marked, " ")).otherwise(c)
    return F.lower(F.replace(F.replace(bare, F.lit("'"), F.lit("")), F.lit("’"), F.lit("")))


def words(c: Column) -> Column:
    """The words of a text in order: maximal runs of letters, marks and digits of :func:`plain`; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(plain(c), F.lit("")), SEPARATORS), "")


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a costly column that later filters and projections read instead of computing it again.

    Catalyst pushes a filter on a computed column below it as a second copy of the expression; it cannot push one through an explode.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))
