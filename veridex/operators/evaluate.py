"""Synthetic graphs, set partitions and exhaustive scoring, to judge clusterings by."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hardem import older_log_likelihood

# fixed values: the six-node author graph (id, helpful flag, real name, review length) and its edges
SMALL_NODES = [(1, True, True, 100), (2, True, True, 120), (3, False, False, 95), (4, False, True, 500), (5, True, False, 600), (6, False, False, 850)]
SMALL_EDGES = [(1, 2), (1, 3), (2, 3), (3, 4), (4, 5), (5, 6), (4, 6)]


def small_graph(spark: SparkSession, weight: float = 0.3) -> tuple[DataFrame, DataFrame]:
    nodes = spark.createDataFrame(SMALL_NODES, "id int, hlpful_fav_unfav boolean, isRealName boolean, revLen int")
    return nodes, spark.createDataFrame([(a, b, weight) for a, b in SMALL_EDGES], "u int, v int, weight double")


def stirling2(df: DataFrame, n: str, k: str, out: str = "s2") -> DataFrame:
    """Ways to part ``n`` things into ``k`` non-empty blocks, as an exact integer (n up to 18)."""
    term = lambda i: F.when(i % 2 == 0, 1).otherwise(-1) * F.factorial(k) / (F.factorial(i) * F.factorial(F.col(k) - i)) * F.pow(F.col(k) - i, F.col(n))
    total = F.aggregate(F.sequence(F.lit(0), F.col(k).cast("int")), F.lit(0.0), lambda a, i: a + term(i))
    return df.withColumn(out, F.round(total / F.factorial(k)).cast("bigint"))


def set_partitions(n: int, blocks: int) -> Iterator[list[int]]:
    """Labellings of n things with exactly ``blocks`` blocks, each in the form where block numbers first appear in order."""
    z = [0] * n

    def fill(i: int, used: int) -> Iterator[list[int]]:
        if used + n - i < blocks:
            return
        if i == n:
            yield list(z)
            return
        for b in range(min(used + 1, blocks)):
            z[i] = b
            yield from fill(i + 1, max(used, b + 1))

    yield from fill(0, 0) if blocks <= n else iter(())


def partitions(spark: SparkSession, n: int, most: int) -> DataFrame:
    """(blocks, labels ARRAY<INT>): every partition of n things into 1..``most`` blocks, grown one thing at a time.

    Each step extends all prefixes of all partitions by an explode, so the table is generated where it is used.
    """
    grown = spark.range(1).select(F.array(F.lit(0)).alias("labels"), F.lit(1).alias("blocks"))
    for _ in range(n - 1):
        grown = grown.select("labels", "blocks", F.explode(F.sequence(F.lit(0), F.least(F.col("blocks"), F.lit(most - 1)))).alias("b"))
        grown = grown.select(F.concat("labels", F.array("b")).alias("labels"), F.greatest("blocks", F.col("b") + 1).alias("blocks"))
    return grown.select("blocks", "labels")


def exhaustive_scores(spark: SparkSession, nodes: DataFrame, edges: DataFrame, most: int, tau: float = 0.8) -> DataFrame:
    """(labels, ll): every partition of a small graph's nodes into at most ``most`` blocks with its log-likelihood under the older model."""
    model = nodes.orderBy("id").toPandas().set_index("id")
    links = [tuple(r) for r in edges.select("u", "v", "weight").collect()]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"labels": b["labels"], "ll": [older_log_likelihood(model, links, list(z), tau)[0] for z in b["labels"]]})

    return partitions(spark, len(model), most).select("labels").mapInPandas(score, "labels array<int>, ll double")


def two_block_graph(spark: SparkSession, n: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of two dense halves with opposite traits and one weak bridge."""
    half = n // 2
    u = lambda k: F.pmod(F.xxhash64(F.lit(seed + k), "id"), F.lit(1_000_003)) / 1_000_003.0
    first = F.col("id") < half
    normal = F.sqrt(-2 * F.ln(u(3) + 1e-9)) * F.cos(2 * math.pi * u(4))
    nodes = spark.range(n).select("id", F.when(first, 0).otherwise(1).alias("acluster"), (u(1) < F.when(first, 0.9).otherwise(0.1)).alias("isRealName"), (u(2) < F.when(first, 0.8).otherwise(0.2)).alias("hlpful_fav_unfav"), (u(5) < F.when(first, 0.7).otherwise(0.3)).alias("vrf_prchs_fav_unfav"), (F.when(first, 3.0).otherwise(7.0) + normal).alias("revLen"))
    inside = _pairs(spark, n).where((F.col("u") < half) == (F.col("v") < half)).where(_coin(seed, 0.4))
    bridge = spark.createDataFrame([(half - 1, half, 0.1, 5)], "u long, v long, weight double, denom int")
    return nodes, inside.select("u", "v", F.lit(1.0).alias("weight"), F.lit(5).alias("denom")).unionByName(bridge)


def _pairs(spark: SparkSession, n: int) -> DataFrame:
    """All pairs u < v of 0..n-1, enumerated from each u (no join)."""
    return spark.range(n - 1).select(F.col("id").alias("u"), F.explode(F.sequence(F.col("id") + 1, F.lit(n - 1).cast("bigint"))).alias("v"))


def _coin(seed: int, p):
    return F.pmod(F.xxhash64(F.lit(seed + 11), "u", "v"), F.lit(1_000_003)) / 1_000_003.0 < p


def cluster_graph(spark: SparkSession, n: int, clusters: int, seed: int = 0, tau: float = 0.9, products: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, author products) of ``clusters`` planted groups: random sizes and traits, about 15 edges a node, most within a group."""
    import numpy as np

    rng = np.random.default_rng(seed)
    shares = np.cumsum(rng.dirichlet([10.0] * clusters))
    real, helpful, verified, mu = rng.random(clusters), rng.random(clusters), rng.random(clusters), rng.uniform(3, 7, clusters)
    pick = lambda v: F.element_at(F.array(*[F.lit(float(x)) for x in v]), F.col("acluster") + 1)
    u = lambda k: F.pmod(F.xxhash64(F.lit(seed + k), "id"), F.lit(1_000_003)) / 1_000_003.0
    group = F.lit(clusters - 1)
    for i in reversed(range(clusters - 1)):
        group = F.when(u(0) < float(shares[i]), i).otherwise(group)
    labelled = spark.range(n).withColumn("acluster", group)
    normal = F.sqrt(-2 * F.ln(u(3) + 1e-9)) * F.cos(2 * math.pi * u(4)) * math.sqrt(0.6)
    nodes = labelled.select("id", "acluster", (u(1) < pick(real)).alias("isRealName"), (u(2) < pick(helpful)).alias("hlpful_fav_unfav"), (u(5) < pick(verified)).alias("vrf_prchs_fav_unfav"), (pick(mu) + normal).alias("revLen"))
    a, b = labelled.select(F.col("id").alias("u"), F.col("acluster").alias("cu")), labelled.select(F.col("id").alias("v"), F.col("acluster").alias("cv"))
    drawn = _pairs(spark, n).where(_coin(seed, min(15 / n, 1.0))).join(a, "u").join(b, "v")
    noise = F.pmod(F.xxhash64(F.lit(seed + 12), "u", "v"), F.lit(1_000_003)) / 1_000_003.0
    same = F.col("cu") == F.col("cv")
    kept = drawn.where(noise < F.when(same, tau).otherwise(1 - tau))
    edges = kept.select("u", "v", F.greatest(F.lit(0.05), F.least(F.lit(1.0), F.when(same, 1.0).otherwise(0.5) + (noise - 0.5) / 2)).alias("weight"), F.lit(5).alias("denom"))
    held = labelled.select(F.col("id").alias("a"), "acluster", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    own = F.pmod(F.xxhash64(F.lit(seed + 13), "a", "k"), F.lit(products))
    return nodes, edges, held.select("a", (F.col("acluster") * products + own).cast("string").alias("x"))
