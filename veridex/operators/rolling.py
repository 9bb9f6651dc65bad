"""Totals over trailing periods, days without activity included."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def trailing_totals(df: DataFrame, entity: str, day: str, value: str, windows: Sequence[int] = (7, 30)) -> DataFrame:
    """Number and total of ``value`` over the last 7, 30, ... days of every entity and day, as runs of equal days.

    Rows are first summed per entity and day, so that an entity never holds more rows than the calendar has days, however
    many records it has. A prefix sum per entity is a step function of time; the trailing total of w days is the
    prefix minus the prefix w days before. Both only change on an active day and w days after one, so the prefix is
    laid out at these points and filled forward: one row per run of days with equal totals, instead of one per day.

    Result: entity, first_active, last_active DATE, from_day, to_day DATE (both included), and n_w BIGINT, sum_w DOUBLE per
    window w. The runs of an entity cover every day from its first active one to the day its longest window empties.
    Values are summed as decimals of six digits after the point, so that a total does not depend on the days before its window.
    Rows with a null entity, day or value, or a value that is NaN or beyond a decimal of 24 digits, are left out; an empty input gives an empty result; repeated rows each count.
    """
    real = F.nanvl(F.col(f"`{value}`").cast("double"), F.lit(None).cast("double")).try_cast("decimal(24,6)")
    rows = df.select(F.col(f"`{entity}`").alias("e"), F.col(f"`{day}`").cast("date").alias("d"), real.alias("v"))
    daily = rows.where("e is not null and d is not null and v is not null").groupBy("e", "d").agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    by_day = W.partitionBy("e").orderBy("d")
    prefix = daily.select(
        "e", "d", F.sum("n").over(by_day).alias("n"), F.sum("s").over(by_day).alias("s"),
        F.min("d").over(W.partitionBy("e")).alias("first_active"), F.max("d").over(W.partitionBy("e")).alias("last_active"),
    )
    points = prefix.select("e", "first_active", "last_active", "n", "s", F.explode(F.array(*[F.struct(F.date_add("d", w).alias("t"), F.lit(w).alias("w")) for w in (0, *windows)])).alias("p"))
    laid = points.groupBy("e", F.col("p.t").alias("t")).agg(
        F.first("first_active").alias("first_active"), F.first("last_active").alias("last_active"),
        *[F.max(F.when(F.col("p.w") == w, F.col(c))).alias(f"{c}{w}") for w in (0, *windows) for c in ("n",)],
        *[F.max(F.when(F.col("p.w") == w, F.struct("n", "s"))).alias(f"s{w}") for w in (0, *windows)],
    )
    so_far = W.partitionBy("e").orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    at = lambda c, zero: F.coalesce(F.last(c, ignorenulls=True).over(so_far), F.lit(zero))
    filled = laid.select(
        "e", "first_active", "last_active", "t", F.lead("t").over(W.partitionBy("e").orderBy("t")).alias("next"),
        *[at(f"n{w}", 0).alias(f"n{w}") for w in (0, *windows)], *[at(F.col(f"s{w}.s"), 0).alias(f"s{w}") for w in (0, *windows)],
    )
    return filled.select(
        F.col("e").alias(entity), "first_active", "last_active", F.col("t").alias("from_day"), F.coalesce(F.date_sub("next", 1), F.col("t")).alias("to_day"),
        *[c for w in windows for c in ((F.col("n0") - F.col(f"n{w}")).alias(f"n_{w}"), (F.col("s0") - F.col(f"s{w}")).cast("double").alias(f"sum_{w}"))],
    )


def each_day(runs: DataFrame, out: str = "day") -> DataFrame:
    """Spread the runs of :func:`trailing_totals` over their days: one row per entity and day."""
    kept = [c for c in runs.columns if c not in ("from_day", "to_day")]
    return runs.select(*kept, F.explode(F.sequence("from_day", "to_day")).alias(out))
