"""Structural metrics of a bipartite graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from .graph import degrees


def density(edges: DataFrame, u: str, v: str) -> DataFrame:
    """Edges over the product of both sides' sizes."""
    counted = edges.select(u, v).distinct().agg(F.count("*").alias("edges"), F.count_distinct(u).alias("left"), F.count_distinct(v).alias("right"))
    return counted.withColumn("density", F.try_divide("edges", F.col("left") * F.col("right")))


#: Neighbours of a node that meet within one join key; a node with more is cut into blocks of as many, every pair of blocks a key of its own.
BLOCK = 2_000


def wedges(links: DataFrame, center: str, end: str) -> DataFrame:
    """(center, x, y): pairs x < y of the ends of each center, from distinct (center, end) ``links``, which are read several times.

    The ends of a center with more than BLOCK fall into blocks by a hash, so the pairs of one with a tenth of all ends are spread over many tasks.
    """
    large = checkpoint(links.groupBy(center).agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).where("blocks > 1"))
    spread = not large.isEmpty()
    small = links.join(large.select(center), center, "left_anti") if spread else links
    pairs = small.withColumnRenamed(end, "x").join(small.withColumnRenamed(end, "y"), center).where("x < y").select(center, "x", "y")
    if not spread:
        return pairs
    cut = links.join(large, center).select(center, F.col(end).alias("x"), F.pmod(F.xxhash64(end), F.col("blocks")).alias("k"), "blocks")
    left = cut.select(center, "x", F.col("k").alias("i"), F.explode(F.sequence("k", F.col("blocks") - 1)).alias("j"))
    right = cut.select(center, F.col("x").alias("y"), F.explode(F.sequence(F.lit(0).cast("bigint"), "k")).alias("i"), F.col("k").alias("j"))
    met = left.join(right, [center, "i", "j"]).where("i < j or x < y")
    return pairs.unionByName(met.select(center, F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")))


def _common(edges: DataFrame, node: str, via: str) -> DataFrame:
    """(x, y, common): pairs x < y of ``node`` with the number of shared neighbours."""
    e = checkpoint(edges.select(F.col(node).alias("n"), F.col(via).alias("w")).distinct())
    return wedges(e, "w", "n").groupBy("x", "y").agg(F.count("*").alias("common"))


def clustering(edges: DataFrame, node: str, via: str, mode: str = "dot") -> DataFrame:
    """Mean overlap of each node's neighbourhood with those two steps away; mode dot (Jaccard), min or max. 0 without any."""
    deg = degrees(edges.select(node, via).distinct(), node)
    pairs = _common(edges, node, via)
    both = pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"), "common"))
    joined = both.join(deg.select(F.col("id").alias("x"), F.col("degree").alias("dx")), "x").join(deg.select(F.col("id").alias("y"), F.col("degree").alias("dy")), "y")
    under = {"dot": F.col("dx") + F.col("dy") - F.col("common"), "min": F.least("dx", "dy"), "max": F.greatest("dx", "dy")}[mode]
    mean = joined.groupBy("x").agg(F.avg(F.col("common") / under).alias("clustering"))
    return deg.select("id").join(mean.withColumnRenamed("x", "id"), "id", "left").select("id", F.coalesce("clustering", F.lit(0.0)).alias("clustering"))


def redundancy(edges: DataFrame, node: str, via: str) -> DataFrame:
    """Share of the pairs of a node's neighbours that another node links too; null below two neighbours."""
    e = checkpoint(edges.select(F.col(node).alias("n"), F.col(via).alias("w")).distinct())
    # pairs of nodes that share a neighbour first, then the pairs of neighbours each of these shares: what is enumerated are the
    # rectangles that make a pair redundant, not all pairs of a node's neighbours
    shared = checkpoint(wedges(e, "w", "n").select(F.struct("x", "y").alias("c"), "w"))
    twice = wedges(shared, "c", "w").select(F.explode(F.array("c.x", "c.y")).alias("n"), "x", "y").distinct()
    hits = twice.groupBy("n").agg(F.count("*").alias("hits"))
    deg = degrees(e, "n")
    return deg.join(hits.withColumnRenamed("n", "id"), "id", "left").select("id", F.when(F.col("degree") >= 2, F.coalesce("hits", F.lit(0)) / (F.col("degree") * (F.col("degree") - 1) / 2)).alias("redundancy"))


def bfs_depth(edges: DataFrame, u: str, v: str, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(id, depth): fewest edges from any of ``seeds.id``; nodes out of reach are absent. Each level is one checkpointed join."""
    links = checkpoint(edges.select(F.col(u).alias("a"), F.col(v).alias("b")).unionByName(edges.select(F.col(v).alias("a"), F.col(u).alias("b"))).distinct())
    frontier = checkpoint(seeds.select("id").distinct().withColumn("depth", F.lit(0)))
    levels, seen, depth = [frontier], frontier.select("id"), 0
    while max_depth is None or depth < max_depth:
        depth += 1
        reached = links.join(frontier.select(F.col("id").alias("a")), "a").select(F.col("b").alias("id")).distinct()
        frontier = checkpoint(reached.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        levels.append(frontier)
        seen = checkpoint(seen.unionByName(frontier.select("id")))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def statistics(edges: DataFrame, node: str, via: str, seeds: DataFrame | None = None, calc_redundancy: bool = True, calc_clustering: bool = True) -> DataFrame:
    """(id, [depth], [redundancy], [clustering]) of every ``node`` of a bipartite graph, each measure only where asked.

    Depth is given with ``seeds`` (id, ends of ``node``) and counts edges; it is null out of reach.
    """
    out = edges.select(F.col(node).alias("id")).distinct()
    if seeds is not None:
        # ends of the two sides may have equal names
        links = edges.select(F.struct(F.lit(0).alias("side"), F.col(node).cast("string").alias("id")).alias("a"), F.struct(F.lit(1).alias("side"), F.col(via).cast("string").alias("id")).alias("b"))
        start = seeds.select(F.struct(F.lit(0).alias("side"), F.col("id").cast("string").alias("id")).alias("id"))
        depth = bfs_depth(links, "a", "b", start).where("id.side = 0").select(F.col("id.id").alias("at"), "depth")
        out = out.join(depth, F.col("id").cast("string") == F.col("at"), "left").drop("at")
    if calc_redundancy:
        out = out.join(redundancy(edges, node, via), "id", "left")
    if calc_clustering:
        out = out.join(clustering(edges, node, via, "min"), "id", "left")
    return out
