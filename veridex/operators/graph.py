"""Review records to an attributed bipartite graph, held as node and edge DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fields import ascii_only, epoch_seconds

#: Stars from which a review is favourable.
FAVORABLE = 4.0


def key_fallback(df: DataFrame, key: str, fallback: str) -> DataFrame:
    """``df`` with ``key`` filled from ``fallback`` where missing, and ``<key>_known`` telling which were given."""
    return df.withColumn(f"{key}_known", F.col(key).isNotNull()).withColumn(key, F.coalesce(key, fallback))


def collapse_edges(df: DataFrame, keys: Sequence[str], latest: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One edge per key pair; each value is the last non-null one in the order of ``latest``.

    A mergeable aggregate (partial on the map side), so an edge repeated without bound never meets in one task's window.
    """
    order = F.struct(*latest)
    # min and max compare structs field by field; a null value yields to any other
    picked = [F.max(F.when(F.col(v).isNotNull(), F.struct(order.alias("o"), F.col(v).alias("v"))))["v"].alias(v) for v in values]
    return df.groupBy(*keys).agg(*picked)


def favorable(edges: DataFrame, star: str = "star", least: float = FAVORABLE) -> DataFrame:
    return edges.where(F.col(star) >= least)


def id_sets(edges: DataFrame, member: str, product: str) -> DataFrame:
    """(id, kind): the distinct member and product ids."""
    members = edges.select(F.col(member).alias("id"), F.lit("member").alias("kind"))
    return members.unionByName(edges.select(F.col(product).alias("id"), F.lit("product").alias("kind"))).where("id is not null").distinct()


def degrees(edges: DataFrame, end: str, out: str = "degree") -> DataFrame:
    return edges.groupBy(F.col(end).alias("id")).agg(F.count("*").alias(out))


def node_upsert(nodes: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Union of two node tables; attributes of ``other`` win where they are not null."""
    shared = [c for c in nodes.columns if c in other.columns and c != key]
    a, b = nodes.alias("a"), other.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    cols: list[Column] = [F.coalesce(f"b.{key}", f"a.{key}").alias(key)]
    cols += [F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in shared]
    cols += [F.col(f"a.{c}") for c in nodes.columns if c not in shared and c != key] + [F.col(f"b.{c}") for c in other.columns if c not in shared and c != key]
    return joined.select(*cols)


def stat_or_degree(nodes: DataFrame, key: str, stat: Column, degree: DataFrame, out: str) -> DataFrame:
    """The larger of a recorded count and the number of edges seen (a node without edges has 0)."""
    return nodes.join(degree.select(F.col("id").alias(key), F.col("degree").alias("__degree")), key, "left").withColumn(out, F.greatest(F.coalesce(stat, F.lit(0)), F.coalesce("__degree", F.lit(0)))).drop("__degree")


def badge_flags(df: DataFrame, badges: str, known: Sequence[str]) -> DataFrame:
    """One boolean per known badge; any badge that contains THE counts as THE."""
    clean = F.transform(F.coalesce(badges, F.array().cast("array<string>")), lambda b: F.upper(F.trim(b)))
    rows = df.withColumn("__badges", clean)
    flags = {"is_the": F.exists("__badges", lambda b: b.contains("THE"))} | {"is_" + k.lower().replace(" ", "_"): F.array_contains("__badges", k) for k in known if "THE" not in k}
    return rows.withColumns(flags).drop("__badges")


def helpful_ratio(df: DataFrame, helpful: str) -> DataFrame:
    """helpful_ratio (null where nobody voted) and helpful_total of [helpful, total]."""
    yes, total = F.get(F.col(helpful), F.lit(0)), F.get(F.col(helpful), F.lit(1))
    return df.withColumns({"helpful_ratio": F.try_divide(yes.cast("double"), total), "helpful_total": total})


def integrity_violations(nodes: DataFrame, edges: DataFrame, ends: Sequence[str]) -> DataFrame:
    """How many distinct ids edges name that are no nodes, and how many nodes have no edge."""
    named = edges.select(F.explode(F.array(*ends)).alias("id")).distinct()
    unknown = named.join(nodes.select("id"), "id", "left_anti").agg(F.count("*").alias("unknown_ends"))
    return unknown.crossJoin(nodes.join(named, "id", "left_anti").agg(F.count("*").alias("isolated")))  # one row each


def without_isolated(nodes: DataFrame, edges: DataFrame, ends: Sequence[str]) -> DataFrame:
    return nodes.join(edges.select(F.explode(F.array(*ends)).alias("id")).distinct(), "id", "left_semi")


def induced_subgraph(edges: DataFrame, ids: DataFrame, u: str, v: str) -> DataFrame:
    """The edges both ends of which are in ``ids.id``."""
    keep = ids.select("id").distinct()
    return edges.join(keep.withColumnRenamed("id", u), u, "left_semi").join(keep.withColumnRenamed("id", v), v, "left_semi").select(*edges.columns)


def author_products(edges: DataFrame, member: str, product: str) -> DataFrame:
    """The sorted distinct products of each member; bounded by the products one member reviewed."""
    return edges.groupBy(member).agg(F.sort_array(F.collect_set(product)).alias("products"))


def connected_components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """(id, component): the least id of each node's component, by alternating large-star and small-star steps until nothing changes.

    The number of rounds grows with the logarithm of the longest path; every round is cut by a reliable checkpoint.
    """
    from ..session import checkpoint

    pairs = edges.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b")).where("a <> b").distinct()
    nodes = edges.select(F.explode(F.array(u, v)).alias("id")).distinct()
    pairs, before = checkpoint(pairs), None
    while True:
        both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        pairs = checkpoint(small)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return nodes.join(pairs.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def dense_ids(nodes: DataFrame, part: str, key: str) -> DataFrame:
    """0-based ids, first part first. Ranges are numbered by their counts, so no task sorts all nodes."""
    from ..session import checkpoint

    ranged = checkpoint(nodes.select(part, key).repartitionByRange(F.col(part), F.col(key)).sortWithinPartitions(part, key).withColumn("__p", F.spark_partition_id()))
    starts = ranged.groupBy("__p").agg(F.count("*").alias("n")).withColumn("start", F.sum("n").over(W.orderBy("__p")) - F.col("n"))  # one row per partition
    return ranged.join(F.broadcast(starts), "__p").withColumn("dense_id", F.col("start") + F.row_number().over(W.partitionBy("__p").orderBy(part, key)) - 1).select(part, key, "dense_id")


@dataclass
class ReviewGraph:
    """Review records as a graph: members and products with their attributes, edges, and the ids of both sides."""

    members: DataFrame
    products: DataFrame
    edges: DataFrame
    ids: DataFrame


def review_graph(reviews: DataFrame, members: DataFrame, products: DataFrame, latest: Sequence[str], edge_metadata: bool = True, node_metadata: bool = True) -> ReviewGraph:
    """The graph of crawled records (schemas of :mod:`veridex.sources.records`).

    A review without a member or product hangs on its own id. Reviews of one member and product become one edge with the last value of each
    attribute, by ``latest``; written dates become seconds, votes a ratio, texts lose what is not ASCII. Of several records of one id
    the greatest value of an attribute counts, in the order of its type. ``members`` and ``products`` hold every id named by a record or, where given, by a
    review, and the larger of the recorded and the seen number of reviews. Reviews that name neither id nor partner are left out.
    """
    r = key_fallback(key_fallback(reviews, "memberId", "id"), "productId", "id").where("memberId is not null and productId is not null")
    r = helpful_ratio(r, "helpful").withColumns({"seconds": epoch_seconds(F.col("date")), "title": ascii_only(F.col("title")), "reviewTxt": ascii_only(F.col("reviewTxt"))})
    values = ["starRating", "seconds", "helpful_ratio", "helpful_total", "title", "reviewTxt", "verifiedPurchase", "nComments", "vine", "id"] if edge_metadata else []
    edges = collapse_edges(r, ["memberId", "productId"], latest, values) if values else r.select("memberId", "productId").distinct()
    edges = edges.withColumnsRenamed({"memberId": "member", "productId": "product"})
    given = lambda c, kind: r.where(f"{c}_known").select(F.col(c).alias("id"), F.lit(kind).alias("kind"))
    ids = given("memberId", "member").unionByName(given("productId", "product"))
    if not node_metadata:
        ids = ids.distinct()
        only = lambda kind: ids.where(F.col("kind") == kind).select("id")
        return ReviewGraph(only("member"), only("product"), edges, ids)
    named = lambda df, kind: df.select("id", F.lit(kind).alias("kind"))
    ids = ids.unionByName(named(members, "member")).unionByName(named(products, "product")).where("id is not null").distinct()

    def side(records: DataFrame, kind: str, end: str, stat: str) -> DataFrame:
        one = records.where("id is not null").groupBy("id").agg(*[F.max(c).alias(c) for c in records.columns if c != "id"])
        nodes = ids.where(F.col("kind") == kind).select("id").join(one, "id", "left")
        return stat_or_degree(nodes, "id", F.col(stat), degrees(edges, end), "__stat").drop(stat).withColumnRenamed("__stat", stat)

    people = helpful_ratio(members, "helpfulStat").drop("helpfulStat")
    return ReviewGraph(side(people, "member", "member", "reviewStat"), side(products, "product", "product", "nReviews"), edges, ids)
