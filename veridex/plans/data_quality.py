"""Core queries over the crawled reviews: timestamps (problem 2), trailing totals (5), even per-key results (7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import clean_review_id, nonblank
from ..functions.timestamps import with_utc_micros
from ..operators.rolling import each_day, trailing_totals
from ..operators.skew import key_quantiles
from ..session import bounded, table
from .registry import Registry

R = Registry()


def reviews_utc(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """``columns`` of reviews and ``utc_us``, the instant its date means."""
    sites = bounded(table(spark, sf_dir, "sites").select("site", "tz", "date_order"))
    rows = table(spark, sf_dir, "reviews").select(*columns, F.col("date").alias("__date"), "site").join(sites, "site", "left")
    return with_utc_micros(rows, "__date", "tz", "date_order", "utc_us").select(*columns, "utc_us")


@R.add("p2_found")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews_utc(spark, sf_dir, "row_no").where("utc_us is not null")


def counted_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(product_id, day, rating): each review once, if its rows give a product, a usable date and a rating within 1..5."""
    rows = reviews_utc(spark, sf_dir, "id", "productId", "starRating")
    stars = F.when(F.col("starRating").between(1, 5), F.col("starRating"))
    keyed = rows.select(clean_review_id(F.col("id")).alias("rid"), nonblank(F.col("productId")).alias("product_id"), "utc_us", stars.alias("rating")).where("rid is not null")
    one = keyed.groupBy("rid").agg(F.min("product_id").alias("product_id"), F.min("utc_us").alias("utc_us"), F.min("rating").alias("rating"))
    return one.select("product_id", F.date_from_unix_date(F.floor(F.col("utc_us") / 86400000000).cast("int")).alias("day"), "rating").where("product_id is not null and day is not null and rating is not null")


@R.add("p5_found")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = trailing_totals(counted_reviews(spark, sf_dir), "product_id", "day", "rating", (7, 30))
    burst = runs.where("n_7 >= 6 and 4 * n_7 >= 3 * n_30 and sum_7 >= 4.5 * n_7")
    cut = burst.withColumn("from_day", F.greatest("from_day", F.date_add("first_active", 30))).withColumn("to_day", F.least("to_day", "last_active"))
    return each_day(cut.where("from_day <= to_day")).select("product_id", F.date_format("day", "yyyy-MM-dd").alias("day_utc"))


@R.add("p5_trailing_runs")
def p5_trailing_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing number, total and mean of stars of every product and day, as runs of equal days."""
    runs = trailing_totals(counted_reviews(spark, sf_dir), "product_id", "day", "rating", (7, 30))
    means = [F.try_divide(F.col(f"sum_{w}"), F.col(f"n_{w}")).alias(f"mean_{w}") for w in (7, 30)]
    return runs.select("product_id", "from_day", "to_day", "n_7", "sum_7", "n_30", "sum_30", *means)


@R.add("p7_found", """with k as (select 'memberId' as key_field, memberId as key_value from reviews union all select 'productId', productId from reviews)
select key_field, key_value from k where regexp_matches(key_value, '[^[:space:]]') group by all having count(*) * 100 >= (select count(*) from reviews)""")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys whose result was reached: all on 1 % of the rows or more, each with its median unless it has no rating at all."""
    reviews = table(spark, sf_dir, "reviews").select("memberId", "productId", "starRating")
    medians = key_quantiles(reviews, ["memberId", "productId"], F.col("starRating"), (0.5,), min_share=0.01)
    return medians.where(F.col("q_50").isNotNull() | (F.col("n_values") == 0)).select("key_field", "key_value")


@R.add(
    "p7_star_quantiles",
    """
with k as (
  select 'memberId' as key_field, memberId as key_value, starRating as v from reviews
  union all select 'productId', productId, starRating from reviews),
r as (select * from k where regexp_matches(key_value, '[^[:space:]]')),
o as (select *, row_number() over (partition by key_field, key_value order by v nulls last) as rn,
  count(v) over (partition by key_field, key_value) as n_values, count(*) over (partition by key_field, key_value) as n_rows from r)
select key_field, key_value, n_rows, n_values,
  max(case when rn = greatest(1, ceil(n_values * 0.1)) then v end) as q_10,
  max(case when rn = greatest(1, ceil(n_values * 0.5)) then v end) as q_50,
  max(case when rn = greatest(1, ceil(n_values * 0.9)) then v end) as q_90
from o group by all""",
)
def p7_star_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = table(spark, sf_dir, "reviews").select("memberId", "productId", "starRating")
    return key_quantiles(reviews, ["memberId", "productId"], F.col("starRating"), (0.1, 0.5, 0.9))
