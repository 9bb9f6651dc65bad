"""The driver's tables as review records: orders and line items read as reviews of suppliers by customers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import collapse_edges
from ..session import table

#: The same reading as SQL common table expressions, for the oracles.
RAW_SQL = """raw as (select o_custkey as m, l_suppkey as p, cast(floor(epoch(l_shipdate)) as bigint) as t, cast((cast(l_quantity as int) - 1) % 5 + 1 as double) as star
  from lineitem join orders on l_orderkey = o_orderkey)"""
EDGES_SQL = RAW_SQL + """,
edges as (select m, p, t, star from (select *, row_number() over (partition by m, p order by t desc, star desc) as rn from raw) where rn = 1),
fav as (select * from edges where star >= 4)"""


def seconds(c: str) -> Column:
    return F.unix_timestamp(F.col(c).cast("timestamp"))


def raw_reviews(spark: SparkSession, sf_dir: str, product: str = "l_suppkey") -> DataFrame:
    """(m, p, t, star): one row per line item."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", product, "l_shipdate", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return joined.select(F.col("o_custkey").alias("m"), F.col(product).alias("p"), seconds("l_shipdate").alias("t"), ((F.col("l_quantity").cast("int") - 1) % 5 + 1).cast("double").alias("star"))


def edges(spark: SparkSession, sf_dir: str, product: str = "l_suppkey") -> DataFrame:
    """One edge per member and product, the latest review's values."""
    return collapse_edges(raw_reviews(spark, sf_dir, product).withColumn("t0", F.col("t")), ["m", "p"], ["t0", "star"], ["t", "star"])
