"""Items that appear together more often than chance (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint

#: Items of a basket beyond which it is enumerated in blocks of as many items, every pair of blocks on its own.
LARGE = 100


def _by_blocks(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(item_a < item_b, w 1): the pairs of the baskets in ``sizes`` (b, n), from ``rows`` (b, i), a pair of blocks of items at a time."""
    cut = rows.join(sizes.select("b", F.ceil(F.col("n") / LARGE).alias("blocks")), "b").withColumn("k", F.pmod(F.xxhash64("i"), F.col("blocks")))
    left = cut.select("b", F.col("k").alias("x"), F.explode(F.sequence("k", F.col("blocks") - 1)).alias("y"), F.col("i").alias("one"))
    right = cut.select("b", F.explode(F.sequence(F.lit(0).cast("bigint"), "k")).alias("x"), F.col("k").alias("y"), F.col("i").alias("two"))
    met = left.join(right, ["b", "x", "y"]).where("x < y or one < two")
    return met.select(F.least("one", "two").alias("item_a"), F.greatest("one", "two").alias("item_b"), F.lit(1).cast("bigint").alias("w"))


def item_pairs(df: DataFrame, basket: str, item: str, min_shared: int = 6, min_lift: float = 5.0) -> DataFrame:
    """Pairs of items found in at least ``min_shared`` baskets together and ``min_lift`` times as often as chance has it.

    Basket collapsing: rows become distinct (basket, item), items that cannot be in any result pair are dropped, baskets with
    the same items become one with a weight, and pairs are enumerated once per distinct basket, weights summed. Items are
    dropped by exact bounds only: with n baskets of N, an item needs n >= min_shared, and lift * n <= N since shared <= the other's n.
    A basket of more than LARGE items is never gathered: its items fall into blocks by a hash, and each pair of blocks is a join key of
    its own. The largest of these, at most min_shared - 1, need no enumeration at all, for a pair that occurs in them alone cannot
    reach min_shared; what they add to a pair is counted from each item's list of those it is in.

    Result: item_a < item_b STRING (as stored), shared, n_a, n_b, n_all BIGINT, lift, conviction DOUBLE (the larger of both
    directions; null where a rule is never broken). A basket counts once per item, however often it is repeated. Rows with a blank basket
    or item are left out. Empty input gives an empty result.
    """
    rows = df.select(F.col(f"`{basket}`").cast("string").alias("b"), F.col(f"`{item}`").cast("string").alias("i"))
    rows = checkpoint(rows.where(F.col("b").rlike(r"(?U)[^\s]") & F.col("i").rlike(r"(?U)[^\s]")).distinct())
    n_all = rows.select("b").distinct().count()
    counts = rows.groupBy("i").agg(F.count("*").alias("n")).where((F.col("n") >= min_shared) & (F.col("n") * F.lit(float(min_lift)) <= n_all))
    kept = rows.join(counts.select("i"), "i", "left_semi")
    # the largest baskets, at most min_shared - 1 of them, are set aside by their ids: their items are never gathered
    sizes = checkpoint(kept.groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") > LARGE))
    out = [r["b"] for r in sizes.orderBy(F.desc("n"), "b").limit(max(0, min_shared - 1)).collect()]
    small = kept.join(sizes.select("b"), "b", "left_anti")
    baskets = small.groupBy("b").agg(F.array_sort(F.collect_list("i")).alias("items")).where("size(items) >= 2")
    rest = baskets.groupBy("items").agg(F.count("*").alias("w"))
    first = rest.select("items", "w", F.posexplode("items").alias("p", "item_a")).where("p < size(items) - 1")
    pairs = first.select("item_a", F.explode(F.expr("slice(items, p + 2, size(items))")).alias("item_b"), "w")
    pairs = pairs.unionByName(_by_blocks(kept, sizes.where(~F.col("b").isin(out)))).groupBy("item_a", "item_b").agg(F.sum("w").alias("shared"))
    pairs = pairs.where(F.col("shared") >= min_shared - len(out))
    if out:
        holds = kept.where(F.col("b").isin(out)).groupBy("i").agg(F.collect_list("b").alias("bs"))  # at most min_shared - 1 each
        for side in ("a", "b"):
            pairs = pairs.join(holds.select(F.col("i").alias(f"item_{side}"), F.col("bs").alias(f"bs_{side}")), f"item_{side}", "left")
        both = F.size(F.array_intersect(F.coalesce("bs_a", F.array().cast("array<string>")), F.coalesce("bs_b", F.array().cast("array<string>"))))
        pairs = pairs.select("item_a", "item_b", (F.col("shared") + both).alias("shared"))
    pairs = pairs.where(F.col("shared") >= min_shared)
    for side in ("a", "b"):
        pairs = pairs.join(counts.select(F.col("i").alias(f"item_{side}"), F.col("n").alias(f"n_{side}")), f"item_{side}")
    n = F.lit(n_all).cast("bigint")
    lift = F.col("shared") * n / (F.col("n_a") * F.col("n_b"))
    conviction = lambda x, y: F.try_divide((1 - F.col(f"n_{y}") / n), 1 - F.col("shared") / F.col(f"n_{x}"))
    sure = pairs.where(F.col("shared") * n >= F.lit(float(min_lift)) * F.col("n_a") * F.col("n_b"))
    return sure.select("item_a", "item_b", "shared", "n_a", "n_b", n.alias("n_all"), lift.alias("lift"), F.greatest(conviction("a", "b"), conviction("b", "a")).alias("conviction"))
