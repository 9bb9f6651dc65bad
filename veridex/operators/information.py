"""Entropies, mutual information and linear-Gaussian fits."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _entropy(n: Column, total: Column, base: float) -> Column:
    p = n / total
    return -F.sum(F.when(n > 0, p * F.ln(p))) / math.log(base)


def entropy(df: DataFrame, cols: Sequence[str], base: float = 2.0, out: str = "entropy") -> DataFrame:
    """Entropy of the joint distribution of ``cols``; nulls are a value, an empty table gives null."""
    counted = df.groupBy(*cols).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.join(F.broadcast(total)).agg(_entropy(F.col("n"), F.col("total"), base).alias(out))  # total is one row


def entropy_of_counts(df: DataFrame, n: str, base: float = 2.0) -> DataFrame:
    """Entropy of counts, zeros dropped."""
    return df.join(F.broadcast(df.agg(F.sum(n).alias("__total")))).agg(_entropy(F.col(n), F.col("__total"), base).alias("entropy"))


def mutual_information(df: DataFrame, x: str, y: str, base: float = 2.0) -> DataFrame:
    """sum of p(x, y) log(p(x, y) / (p(x) p(y))), with both entropies, in one pass over grouping sets."""
    sets = df.select(F.col(x).alias("x"), F.col(y).alias("y")).cube("x", "y").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    total = sets.where("g = 3").select(F.col("n").alias("total"))
    h = sets.join(F.broadcast(total)).groupBy("g").agg(_entropy(F.col("n"), F.col("total"), base).alias("h"))
    pick = lambda g: F.max(F.when(F.col("g") == g, F.col("h")))
    return h.agg(pick(1).alias("h_x"), pick(2).alias("h_y"), pick(0).alias("h_xy")).withColumn("mi", F.col("h_x") + F.col("h_y") - F.col("h_xy"))


def binned(df: DataFrame, cols: Sequence[str], bins: int) -> DataFrame:
    """Equal-width bin numbers 0..bins-1 over each column's range, the last bin closed; a constant column is bin null."""
    bounds = df.agg(*[f(c).alias(f"__{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))])  # one row
    share = lambda c: F.try_divide(F.col(c) - F.col(f"__lo_{c}"), F.col(f"__hi_{c}") - F.col(f"__lo_{c}"))
    scaled = {f"bin_{c}": F.when(share(c).isNotNull(), F.least(F.floor(share(c) * bins), F.lit(bins - 1))) for c in cols}
    return df.join(F.broadcast(bounds)).withColumns(scaled).select(*df.columns, *scaled)


def histogram(df: DataFrame, cols: Sequence[str], bins: int) -> DataFrame:
    return binned(df, cols, bins).groupBy(*[f"bin_{c}" for c in cols]).agg(F.count("*").alias("n"))


def mutual_information_binned(df: DataFrame, x: str, y: str, bins: int, base: float = 2.0) -> DataFrame:
    return mutual_information(binned(df, [x, y], bins), f"bin_{x}", f"bin_{y}", base)


def topological_order(vertices: Sequence[str], edges: Sequence[tuple[str, str]]) -> list[str]:
    """Parents before children; the order of ``vertices`` decides between equals. Raises on a cycle."""
    parents = {v: {a for a, b in edges if b == v} for v in vertices}
    out: list[str] = []
    while parents:
        ready = next((v for v, p in parents.items() if p <= set(out)), None)
        if ready is None:
            raise ValueError("the graph has a cycle")
        out.append(ready)
        del parents[ready]
    return out


def linear_gaussian(df: DataFrame, child: str, parent: str) -> DataFrame:
    """Least-squares intercept and slope of ``child`` on one parent, and the mean squared residual."""
    fit = df.agg(F.regr_slope(child, parent).alias("slope"), F.regr_intercept(child, parent).alias("intercept"), F.regr_syy(child, parent).alias("syy"), F.regr_sxy(child, parent).alias("sxy"), F.regr_count(child, parent).alias("n"))
    return fit.select("intercept", "slope", ((F.col("syy") - F.col("slope") * F.col("sxy")) / F.col("n")).alias("variance"))


def linear_gaussian_network(df: DataFrame, vertices: Sequence[str], edges: Sequence[tuple[str, str]]) -> list[dict]:
    """Intercept, coefficients and variance of every vertex on its parents, from one pass of sums of products."""
    import numpy as np

    cols = ["1", *vertices]
    value = {c: F.lit(1.0) if c == "1" else F.col(f"`{c}`").cast("double") for c in cols}
    row = df.dropna(subset=list(vertices)).agg(*[F.sum(value[a] * value[b]).alias(f"{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]).first()
    gram = np.array([[row[f"{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(len(cols))] for i in range(len(cols))])
    out = []
    for v in topological_order(vertices, edges):
        ps = [a for a, b in edges if b == v]
        at, t = [0, *(cols.index(p) for p in ps)], cols.index(v)
        beta = np.linalg.lstsq(gram[np.ix_(at, at)], gram[at, t], rcond=None)[0]
        out.append({"vertex": v, "parents": ps, "intercept": float(beta[0]), "coefficients": [float(x) for x in beta[1:]], "variance": float((gram[t, t] - beta @ gram[at, t]) / max(gram[0, 0], 1.0))})
    return out
