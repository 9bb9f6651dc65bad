"""Field extraction and cleaning: the column pipelines that turn scraped strings into record values."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# fixed values: the patterns by which ids and numbers are found in pages
REVIEW_ID = r"review/(\w+)/"
GROUPED_NUMBER = r"\d+(?:,\d+)*"
CATEGORY_NAME = r"\w+(?:\s+(?:\w+|&))*"
SALES_RANK = rf"#({GROUPED_NUMBER})\s+(?:\w+\s+)?in\s+({CATEGORY_NAME})"
PRICE = rf"\$({GROUPED_NUMBER}\.\d\d)"
STARS = r"(\d+(?:\.\d+)?)\s+out\s+of"
PRODUCT_URL_ID = r"(?:/gp/product/glance/|/gp/product/|/dp/)(\w+)"
MEMBER_URL_ID = r"profile/(\w+)"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null where there is none."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def remove_commas(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit(""))


def grouped_int(c: Column) -> Column:
    """An integer written with thousands separators; null where it is none."""
    return remove_commas(strip(c)).try_cast("int")


def all_numbers(c: Column) -> Column:
    """Every number of a text, as integers."""
    return F.transform(F.regexp_extract_all(c, F.lit(f"({GROUPED_NUMBER})"), F.lit(1)), lambda x: remove_commas(x).try_cast("int"))


def filter_empty(c: Column) -> Column:
    return F.filter(c, lambda x: x != "")


def only_element(c: Column) -> Column:
    """The element of a one-element array; an error otherwise."""
    return F.when(F.size(c) == 1, F.get(c, F.lit(0))).otherwise(F.raise_error(F.lit("expected exactly one element")))


def only_element_or(c: Column, default: Column) -> Column:
    """The element of an array of at most one; ``default`` if it is empty; an error if there are more."""
    return F.when(F.size(c) <= 1, F.coalesce(F.get(c, F.lit(0)), default)).otherwise(F.raise_error(F.lit("expected at most one element")))


def keep_value(c: Column, kind: str = "string") -> Column:
    """Null for what counts as absent: empty strings and arrays. Zero and false stay."""
    if kind == "array":
        return F.when(F.size(c) > 0, c)
    return F.nullif(c, F.lit("")) if kind == "string" else c


def join_texts(c: Column) -> Column:
    """Parts stripped, empty ones dropped, joined by a blank."""
    return F.array_join(filter_empty(F.transform(c, strip)), " ")


def badges(c: Column) -> Column:
    return F.transform(c, lambda b: F.upper(strip(b)))


def ascii_only(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\x00-\x7F]", "")


def epoch_seconds(c: Column, pattern: str = "MMMM d, yyyy") -> Column:
    """Seconds since 1970 of a written date; null where it is none."""
    return F.unix_timestamp(F.try_to_timestamp(c, F.lit(pattern)))


def first_of(*extractors: Column) -> Column:
    """The first extractor that found something."""
    return F.coalesce(*[F.nullif(e, F.lit("")) for e in extractors])


def absolute_url(base: Column, href: Column) -> Column:
    """A link of a page made absolute: full, protocol-relative, rooted or relative to the page's folder."""
    scheme, origin = F.regexp_extract(base, r"^([a-z]+:)//", 1), F.regexp_extract(base, r"^([a-z]+://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(?<=[^/:])/[^/]*$", "")
    return (
        F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(origin, href))
        .otherwise(F.concat(folder, F.lit("/"), href))
    )


def register(spark: SparkSession) -> None:
    """Make the scalar functions known to SQL; they are expressions, not code run by row."""
    for name, body in {"lower_case": "lower(s)", "keep_text": "nullif(s, '')", "remove_commas": "replace(s, ',', '')", "ascii_only": r"regexp_replace(s, '[^\\x00-\\x7F]', '')"}.items():
        spark.sql(f"create or replace temporary function {name}(s string) returns string return {body}")
