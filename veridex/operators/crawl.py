"""The dataflow of a breadth-first crawl over tables of known links."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fields import absolute_url
from ..session import checkpoint

MAX_DEPTH = 2
MAX_PAGES = 30
MAX_RELATED = 5


def page_url(base: str, kind: Column, id_: Column, page: Column) -> Column:
    """Address of a page of a member's ('m') or product's ('p') reviews."""
    return F.when(kind == "m", F.format_string(base + "/member-reviews/%s?page=%s", id_, page)).when(kind == "p", F.format_string(base + "/product-reviews/%s?page=%s", id_, page))


def item_url(base: str, kind: Column, id_: Column) -> Column:
    """Address of a member's profile or a product's details."""
    return F.when(kind == "m", F.format_string(base + "/profile/%s", id_)).when(kind == "p", F.format_string(base + "/dp/%s", id_))


def checked_seeds(seeds: DataFrame, kind: str, id_: str) -> DataFrame:
    """Distinct seeds; a kind other than 'm' or 'p' is an error when it is read."""
    ok = F.when(F.col(kind).isin("m", "p"), F.col(kind)).otherwise(F.raise_error(F.concat(F.lit("unknown seed type: "), F.coalesce(kind, F.lit("null")))))
    return seeds.select(ok.alias("type"), F.col(id_).alias("id")).distinct()


def frontier(links: DataFrame, seeds: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(type, id, depth): everything within ``max_depth`` steps of the seeds, each at its least depth.

    ``links`` has (src_type, src, dst_type, dst). What lies at the depth limit is not expanded.
    """
    level = checkpoint(seeds.select("type", "id").distinct().withColumn("depth", F.lit(0)))
    seen = level
    for depth in range(1, max_depth + 1):
        nxt = links.join(level.select(F.col("type").alias("src_type"), F.col("id").alias("src")), ["src_type", "src"]).select(F.col("dst_type").alias("type"), F.col("dst").alias("id")).distinct()
        level = checkpoint(nxt.join(seen.select("type", "id"), ["type", "id"], "left_anti").withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def allowed_requests(requests: DataFrame, max_depth: int = MAX_DEPTH, max_pages: int | Mapping[str, int] = MAX_PAGES) -> DataFrame:
    """Requests (type, id, page or null, depth) within depth and page limits (one limit, or one by type); review pages at the last depth are dropped, for nothing
    on them could be followed. Ordered by priority, the shallower the earlier."""
    limit = F.lit(max_pages) if isinstance(max_pages, int) else F.create_map(*[F.lit(x) for kv in max_pages.items() for x in kv])[F.col("type")]
    kept = requests.where((F.col("depth") <= max_depth) & ~(F.col("page").isNotNull() & (F.col("depth") >= max_depth)) & (F.col("page").isNull() | (F.col("page") <= limit)))
    return kept.withColumn("priority", -F.col("depth"))


def depth_histogram(reached: DataFrame) -> DataFrame:
    return reached.groupBy("depth").agg(F.count("*").alias("requests"))


def pages_of(df: DataFrame, n: Column, per_page: int = 10, max_pages: int = MAX_PAGES) -> DataFrame:
    """One row per page of ``n`` entries, from 1 on, at least one and at most ``max_pages``."""
    pages = F.greatest(F.lit(1), F.least(F.lit(max_pages), F.ceil(n / per_page))).cast("int")
    return df.withColumn("page", F.explode(F.sequence(F.lit(1), pages)))


def first_related(df: DataFrame, group: str, order: str, most: int = MAX_RELATED) -> DataFrame:
    """The first ``most`` + 1 entries of a group (the limit is checked after counting the one at hand)."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(group).orderBy(order))).where(F.col("__r") <= most + 1).drop("__r")


def related_links(df: DataFrame, main: Column, fallback: Column, most: int = MAX_RELATED, out: str = "link") -> DataFrame:
    """The first ``most`` + 1 links of an array, or of the fallback where that is empty or null: one row per link."""
    links = F.when(F.size(F.coalesce(main, F.array().cast("array<string>"))) > 0, main).otherwise(fallback)
    return df.withColumn(out, F.explode(F.slice(links, 1, most + 1)))


def more_product_pages(page: Column, before_next: Column) -> Column:
    """Whether a product has a page of reviews after ``page``: the link before 'Next' tells how many there are, 1 if there is none."""
    return page < F.coalesce(F.regexp_extract(before_next, r"\d+", 0).try_cast("int"), F.lit(1))


def more_member_pages(bar: Column) -> Column:
    """Whether a member has a further page of reviews: the bar of pages names one before a stroke."""
    return F.coalesce(bar.rlike(r"\d+\s+\|"), F.lit(False))


def follow_ups(details: DataFrame, base: str) -> DataFrame:
    """(key, kind, url): what a product's page leads to, its reviews and, where linked, its category and its maker."""
    page = F.lit(base + "/")
    wanted = F.array(
        F.struct(F.lit("category").alias("kind"), absolute_url(page, F.col("category_href")).alias("url")),
        F.struct(F.lit("maker").alias("kind"), absolute_url(page, F.col("maker_href")).alias("url")),
        F.struct(F.lit("reviews").alias("kind"), page_url(base, F.lit("p"), F.col("key"), F.lit(1)).alias("url")),
    )
    return details.select("key", F.explode(F.filter(wanted, lambda x: x["url"].isNotNull())).alias("x")).select("key", "x.kind", "x.url")


def first_items(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first record of each key, by ``order``."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")
