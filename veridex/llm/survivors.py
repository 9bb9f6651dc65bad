"""The best representative of each group of duplicate records, value by value (problem 6)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def surviving_records(df: DataFrame, group: Column, fields: Mapping[str, tuple[Column, Column]], recency: Sequence[Column], min_rows: int = 2) -> DataFrame:
    """One record per group with, field by field, the value of the best row that has one.

    ``fields`` maps a result column to (value, trust): rows whose value is null do not compete; of the rest the highest trust wins,
    then the latest by ``recency`` (each descending, nulls last). The last of ``recency`` should be unique; where it is not, the greatest
    value wins, so that the result never depends on the order of rows. ``value`` may be a struct of values that must come from one row.

    Rows compete per group and field under ``row_number() = 1``, which Spark applies within every task before the shuffle as
    well as after it: a group that holds a third of all rows sends one candidate per task and field. Groups are counted by a partial
    aggregate. Result: group STRING, n_rows BIGINT, and the fields; groups of fewer than ``min_rows`` rows and rows with a null group
    are left out, a field without any candidate is null. Empty input gives an empty result.
    """
    keyed = df.select(group.alias("g"), *[v.alias(f"v_{i}") for i, (v, _) in enumerate(fields.values())], *[t.cast("int").alias(f"t_{i}") for i, (_, t) in enumerate(fields.values())], *[r.alias(f"r_{i}") for i, r in enumerate(recency)]).where("g is not null")
    sizes = keyed.groupBy("g").agg(F.count("*").alias("n_rows")).where(F.col("n_rows") >= min_rows)
    best = sizes
    for i, name in enumerate(fields):
        order = [F.col(f"t_{i}").desc_nulls_last(), *[F.col(f"r_{j}").desc_nulls_last() for j in range(len(recency))], F.col(f"v_{i}").desc()]
        ranked = keyed.where(F.col(f"v_{i}").isNotNull()).withColumn("rank", F.row_number().over(W.partitionBy("g").orderBy(*order)))
        best = best.join(ranked.where("rank = 1").select("g", F.col(f"v_{i}").alias(name)), "g", "left")
    return best.withColumnRenamed("g", "group")
