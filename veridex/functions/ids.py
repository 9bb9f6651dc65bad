"""Identifiers written in several ways, blanks, and plain column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nonblank(c: Column) -> Column:
    """``c`` as stored, or null where it is null, empty or only white space."""
    return F.when(c.rlike(r"(?U)[^\s]"), c)


def clean_review_id(c: Column) -> Column:
    """The upper-case code alone ('R' and ten letters or digits), however ``c`` is written; null if it holds none."""
    code = F.regexp_extract(c, r"(?i)(?:^|[^a-z0-9])(r[a-z0-9]{10})(?![a-z0-9])", 1)
    return F.nullif(F.upper(code), F.lit(""))
