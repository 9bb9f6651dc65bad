"""Per-key results that take even time although a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import checkpoint

#: Share of all rows from which a key counts as hot. At most 1 / HOT_SHARE keys of a field can be hot, whatever the input.
HOT_SHARE = 0.001
BINS = 256


def _keyed(df: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """(field, key, v): one row per record and key field with a non-blank key."""
    rows = df.select(F.array(*[F.struct(F.lit(k).alias("field"), F.col(f"`{k}`").cast("string").alias("key")) for k in keys]).alias("k"), value.cast("double").alias("v"))
    return rows.select(F.explode("k").alias("k"), "v").select("k.field", "k.key", "v").where(F.col("key").rlike(r"(?U)[^\s]"))


def key_quantiles(df: DataFrame, keys: Sequence[str], value: Column, probs: Sequence[float] = (0.5,), min_share: float = 0.0) -> DataFrame:
    """Row counts and exact quantiles of ``value`` for every value of every key column.

    Distributed exact selection. A first aggregate gives each key's rows, least and greatest value. Then each round
    counts the values of the interval that holds a wanted rank in 256 bins per key (counts merge on the map side, so a
    key costs 256 rows per task however many rows it has), finds the bin with the rank and keeps that bin's own least
    and greatest value as the next interval, until every interval is one value. No key's values are ever gathered. Intervals of
    hot keys (a thousandth of the rows or more, so at most 1,000 per field) are broadcast to the rows; the
    others meet their rows in a shuffle, which the rows of hot keys are taken out of before.

    Result: key_field, key_value STRING, n_rows BIGINT (rows with the key), n_values BIGINT (with a value that is neither null nor NaN),
    q_<percent> DOUBLE per probability: the value of rank max(1, ceil(p * n_values)), null if there is none. Blank keys are
    left out; ``min_share`` keeps the keys on at least that share of all rows of ``df``. Empty input gives an empty result.
    """
    spark = df.sparkSession
    rows = _keyed(df, keys, F.nanvl(value.cast("double"), F.lit(None).cast("double")))
    total = df.count()
    counted = rows.groupBy("field", "key").agg(F.count("*").alias("n"), F.count("v").alias("nv"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    stats = checkpoint(counted.where(F.col("n") >= F.lit(min_share) * total))
    targets = stats.where("nv > 0").select(
        "field", "key", "lo", "hi", F.lit(0).cast("bigint").alias("below"), (F.col("n") >= F.lit(HOT_SHARE) * total).alias("hot"),
        F.explode(F.array(*[F.struct(F.lit(float(p)).alias("p"), F.greatest(F.lit(1), F.ceil(F.col("nv") * F.lit(float(p)))).alias("rank")) for p in probs])).alias("t"),
    ).select("field", "key", "lo", "hi", "below", "hot", "t.p", "t.rank")
    # at most 1 / HOT_SHARE keys of a field: their rows never enter a shuffle
    hot_keys = F.broadcast(stats.where(F.col("n") >= F.lit(HOT_SHARE) * total).select("field", "key"))
    others = rows.join(hot_keys, ["field", "key"], "left_anti")
    done = spark.createDataFrame([], "field string, key string, p double, q double")
    while True:
        done = done.unionByName(targets.where("lo = hi").select("field", "key", "p", F.col("lo").alias("q")))
        open_ = targets.where("lo < hi")
        if open_.isEmpty():
            break
        where = open_.select("field", "key", "lo", "hi", "hot").distinct()
        inside = [  # hot intervals travel to the rows, the others meet them by key
            rows.join(F.broadcast(where.where("hot")), ["field", "key"]),
            others.join(where.where("not hot"), ["field", "key"]) if min_share < HOT_SHARE else None,
        ]
        bins = None
        for x in filter(None, inside):
            bin_ = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1))
            b = x.where("v between lo and hi").groupBy("field", "key", "lo", "hi", bin_.alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
            bins = b if bins is None else bins.unionByName(b)
        before = F.sum("c").over(W.partitionBy("field", "key", "lo", "hi").orderBy("bin")) - F.col("c")
        ranked = bins.withColumn("before", before)
        hit = open_.join(ranked, ["field", "key", "lo", "hi"]).where("rank - below > before and rank - below <= before + c")
        targets = checkpoint(hit.select("field", "key", F.col("least").alias("lo"), F.col("most").alias("hi"), (F.col("below") + F.col("before")).alias("below"), "hot", "p", "rank"))
    q = done.groupBy("field", "key").agg(*[F.max(F.when(F.col("p") == float(p), F.col("q"))).alias(f"q_{round(p * 100)}") for p in probs])
    return stats.join(q, ["field", "key"], "left").select(F.col("field").alias("key_field"), F.col("key").alias("key_value"), F.col("n").alias("n_rows"), F.col("nv").alias("n_values"), *[f"q_{round(p * 100)}" for p in probs])
