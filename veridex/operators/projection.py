"""Time-windowed co-review projections and the burst gate."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint, materialize
from .graph import degrees, favorable

DAY = 86_400
WINDOW = 7 * DAY
SIGNIFICANT = 0.05
EPSILON = 1e-6
LEAST_SERIES = 50


def close_pairs(edges: DataFrame, center: str, end: str, window: int = WINDOW) -> DataFrame:
    """(u, v, center): ends that share a center within less than ``window`` seconds, u < v.

    The band is part of the join key: a row keeps its bucket of ``window`` seconds and meets rows of the same
    and the preceding bucket, so a center with many edges is split by time instead of paired all with all.
    """
    bucket = F.floor(F.col("t") / window)
    left = edges.select(F.col(center).alias("c"), F.col(end).alias("u"), F.col("t").alias("tu"), bucket.alias("b"))
    right = edges.select(F.col(center).alias("c"), F.col(end).alias("v"), F.col("t").alias("tv"), F.explode(F.array(F.struct(bucket.alias("b"), F.lit(False).alias("before")), F.struct((bucket + 1).alias("b"), F.lit(True).alias("before")))).alias("k")).select("c", "v", "tv", "k.b", "k.before")
    met = left.join(right, ["c", "b"]).where(((F.col("before") & (F.col("u") != F.col("v"))) | (F.col("u") < F.col("v"))) & (F.abs(F.col("tu") - F.col("tv")) < window))
    return met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.col("c").alias(center))


def member_projection(edges: DataFrame, window: int = WINDOW, star: float = 4.0, keep: DataFrame | None = None) -> DataFrame:
    """Members who favourably reviewed more than one product close in time: (m1, m2, cnt, denom, weight).

    ``edges`` has m, p, t (seconds), star, one row per (m, p). ``keep`` names products that pass a gate. The weight is
    cnt over the larger favourable degree of both.
    """
    good = materialize(favorable(edges, "star", star).select("m", "p", "t"))  # read for the pairs and for the degrees
    paired = good if keep is None else good.join(keep.select("p"), "p", "left_semi")
    counted = close_pairs(paired, "p", "m", window).groupBy("u", "v").agg(F.count("*").alias("cnt")).where("cnt > 1")
    return _normalised(counted, degrees(good, "m"), F.greatest).withColumnsRenamed({"u": "m1", "v": "m2"})


def product_projection(edges: DataFrame, window: int = WINDOW, star: float = 4.0) -> DataFrame:
    """Products favourably reviewed by one member close in time: (p1, p2, cnt, denom, weight), weight over the smaller degree."""
    good = checkpoint(favorable(edges, "star", star).select("m", "p", "t"))
    counted = close_pairs(good, "m", "p", window).groupBy("u", "v").agg(F.count("*").alias("cnt"))
    return _normalised(counted, degrees(good, "p"), F.least).withColumnsRenamed({"u": "p1", "v": "p2"})


def _normalised(pairs: DataFrame, degree: DataFrame, pick) -> DataFrame:
    a, b = degree.select(F.col("id").alias("u"), F.col("degree").alias("du")), degree.select(F.col("id").alias("v"), F.col("degree").alias("dv"))
    return pairs.join(a, "u").join(b, "v").withColumn("denom", pick("du", "dv")).select("u", "v", "cnt", "denom", (F.col("cnt") / F.col("denom")).alias("weight"))


def projection_evidence(edges: DataFrame, window: int = WINDOW) -> DataFrame:
    """For pairs of members with more than one shared product, which products (sorted; bounded by a member's products)."""
    pairs = close_pairs(favorable(edges), "p", "m", window)
    return pairs.groupBy(F.col("u").alias("m1"), F.col("v").alias("m2")).agg(F.sort_array(F.collect_set("p")).alias("products")).where("size(products) > 1")


def _burst_p(ts: np.ndarray, window: float, weights: np.ndarray | None = None, spread: float | None = None) -> float:
    """Probability that two draws of the series' density fall within half a window of each other.

    ``weights`` tells how many reviews each time stands for; ``spread`` is their standard deviation where ``ts`` are means of cells.
    """
    weights = np.ones(len(ts)) if weights is None else weights
    n = weights.sum()
    h = (ts.std(ddof=1) if spread is None else spread) * n ** (-0.2)
    lo, hi = ts.min() - window / 2, ts.max() + window / 2
    panels = max(1, math.ceil((hi - lo) / (64 * h)))  # so that nodes lie closer than the bandwidth
    x, w = np.polynomial.legendre.leggauss(256)
    half = (hi - lo) / panels / 2
    erf = np.vectorize(math.erf, otypes=[float])
    total = 0.0
    for k in range(panels):
        for at, share in zip(lo + half * (2 * k + 1 + x), w, strict=True):
            z = (at - ts) / h
            density = (weights * np.exp(-0.5 * z * z)).sum() / (n * h * math.sqrt(2 * math.pi))
            inside = (weights * (erf((z + window / 2 / h) / math.sqrt(2)) - erf((z - window / 2 / h) / math.sqrt(2)))).sum() / (2 * n)
            total += half * share * density * inside
    return float(total)


def burst_gate(edges: DataFrame, window: int = WINDOW, finer: int = 64) -> DataFrame:
    """(p, n, p_value, keep): products whose reviews are so close in time that a co-review says something.

    A kernel density of all review times of a product gives the probability of two reviews within half a window; products where it
    is not significant are left out, short or constant series are kept. At every size, times are merged into weighted means of
    cells ``finer`` times narrower than both window and bandwidth (a second at least), and number and spread of the reviews are the true
    ones; a product's group is bounded by the range of its times, not by its reviews.
    """
    bounds = edges.groupBy("p").agg(F.count("*").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi"), F.stddev_samp("t").alias("spread"))
    width = F.greatest(F.lit(1.0), F.floor(F.least(F.lit(float(window)), F.coalesce("spread", F.lit(0.0)) * F.pow("n", F.lit(-0.2))) / finer))
    bounds = bounds.withColumn("width", width)
    merged = edges.join(bounds, "p").groupBy("p", "n", "lo", "hi", "spread", F.floor((F.col("t") - F.col("lo")) / F.col("width")).alias("cell")).agg(F.count("*").alias("w"), F.avg("t").alias("t"))

    def gate(pdf: pd.DataFrame) -> pd.DataFrame:
        n, low, high = int(pdf["n"].iloc[0]), pdf["lo"].iloc[0], pdf["hi"].iloc[0]
        value, keep = None, True
        if n >= LEAST_SERIES and low < high:
            value = _burst_p(pdf["t"].to_numpy(float), window, pdf["w"].to_numpy(float), float(pdf["spread"].iloc[0]))
            keep = not value - EPSILON >= SIGNIFICANT
        return pd.DataFrame({"p": [pdf["p"].iloc[0]], "n": [n], "p_value": pd.Series([value], dtype=float), "keep": [keep]})

    return merged.groupBy("p").applyInPandas(gate, "p long, n long, p_value double, keep boolean")
