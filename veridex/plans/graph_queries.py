"""Queries over the review graph: records to graph, projections, structural metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import metrics as M
from ..operators import projection as P
from ..session import checkpoint, table
from .model import EDGES_SQL, RAW_SQL, edges, raw_reviews
from .registry import Registry

R = Registry()


def _projection_sql(days: int) -> str:
    return f"""with {EDGES_SQL}, d as (select m, count(*) as d from fav group by m),
c as (select a.m as m1, b.m as m2, count(*) as cnt from fav a join fav b on a.p = b.p and a.m < b.m and abs(a.t - b.t) < {days * P.DAY} group by all having count(*) > 1)
select m1, m2, cnt, greatest(x.d, y.d) as denom, round(cnt / greatest(x.d, y.d), 8) as weight from c join d x on x.m = m1 join d y on y.m = m2"""


def _projection(days: int):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return P.member_projection(edges(spark, sf_dir), days * P.DAY).withColumn("weight", F.round("weight", 8))

    return q


for _days in (7, 30):
    R.add(f"member_projection_{_days}d", _projection_sql(_days))(_projection(_days))


@R.add("product_projection_7d", f"""with {EDGES_SQL}, d as (select p, count(*) as d from fav group by p),
c as (select a.p as p1, b.p as p2, count(*) as cnt from fav a join fav b on a.m = b.m and a.p < b.p and abs(a.t - b.t) < {P.WINDOW} group by all)
select p1, p2, cnt, least(x.d, y.d) as denom, round(cnt / least(x.d, y.d), 8) as weight from c join d x on x.p = p1 join d y on y.p = p2""")
def product_projection_7d(spark, sf_dir):
    return P.product_projection(edges(spark, sf_dir)).withColumn("weight", F.round("weight", 8))


@R.add("projection_evidence", f"""with {EDGES_SQL}
select a.m as m1, b.m as m2, string_agg(cast(a.p as varchar), ',' order by a.p) as products
from fav a join fav b on a.p = b.p and a.m < b.m and abs(a.t - b.t) < {P.WINDOW} group by all having count(*) > 1""")
def projection_evidence(spark, sf_dir):
    return P.projection_evidence(edges(spark, sf_dir)).withColumn("products", F.array_join(F.transform("products", lambda p: p.cast("string")), ","))


@R.add("projected_nodes", f"""with {EDGES_SQL}, c as (select a.m as m1, b.m as m2 from fav a join fav b on a.p = b.p and a.m < b.m and abs(a.t - b.t) < {30 * P.DAY} group by all having count(*) > 1),
n as (select m1 as id from c union select m2 from c) select id, c_name as name, c_mktsegment as segment from n join customer on id = c_custkey""")
def projected_nodes(spark, sf_dir):
    """The members left in the projection, isolated ones removed, with their own attributes."""
    pairs = P.member_projection(edges(spark, sf_dir), 30 * P.DAY)
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return G.without_isolated(nodes, pairs, ["m1", "m2"])


@R.add("favorable_edges", f"with {EDGES_SQL} select m, p, t, star from fav")
def favorable_edges(spark, sf_dir):
    return G.favorable(edges(spark, sf_dir)).select("m", "p", "t", "star")


@R.add("edge_collapse", f"with {EDGES_SQL} select m, p, t, star from edges")
def edge_collapse(spark, sf_dir):
    return edges(spark, sf_dir).select("m", "p", "t", "star")


@R.add("edge_metadata_off", f"with {EDGES_SQL} select m, p from edges")
def edge_metadata_off(spark, sf_dir):
    return raw_reviews(spark, sf_dir).select("m", "p").distinct()


@R.add("id_sets", f"with {RAW_SQL} select distinct m as id, 'member' as kind from raw union select distinct p, 'product' from raw")
def id_sets(spark, sf_dir):
    return G.id_sets(raw_reviews(spark, sf_dir), "m", "p")


@R.add("key_fallback", """select o_orderkey as id, coalesce(nullif(o_custkey, 7), o_orderkey) as member, o_custkey <> 7 as member_known from orders""")
def key_fallback(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.nullif("o_custkey", F.lit(7)).alias("member"))
    return G.key_fallback(o, "member", "id")


@R.add("node_upsert", f"""with {RAW_SQL}, e as (select m as id, count(*) as reviews from raw group by m)
select coalesce(c_custkey, id) as id, c_name as name, reviews from customer full outer join e on c_custkey = id""")
def node_upsert(spark, sf_dir):
    seen = raw_reviews(spark, sf_dir).groupBy(F.col("m").alias("id")).agg(F.count("*").alias("reviews"))
    return G.node_upsert(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), seen, "id")


@R.add("review_stat_greatest", f"""with {EDGES_SQL}, d as (select m, count(*) as d from edges group by m)
select c_custkey as id, greatest(cast(floor(c_acctbal / 100) as bigint), coalesce(d, 0)) as review_stat from customer left join d on c_custkey = m""")
def review_stat_greatest(spark, sf_dir):
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.floor(F.col("c_acctbal") / 100).alias("stat"))
    return G.stat_or_degree(nodes, "id", F.col("stat"), G.degrees(edges(spark, sf_dir), "m"), "review_stat").select("id", "review_stat")


@R.add("product_review_count", f"""with {EDGES_SQL}, d as (select p, count(*) as d from edges group by p)
select s_suppkey as id, greatest(cast(50 as bigint), coalesce(d, 0)) as n_reviews from supplier left join d on s_suppkey = p""")
def product_review_count(spark, sf_dir):
    nodes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    return G.stat_or_degree(nodes, "id", F.lit(50), G.degrees(edges(spark, sf_dir), "p"), "n_reviews").select("id", "n_reviews")


@R.add("badge_pivot", """with b as (select id, list_transform(coalesce(badges, []), lambda x: upper(trim(x))) as b from members)
select id, len(list_filter(b, lambda x: contains(x, 'THE'))) > 0 as is_the, list_contains(b, 'VINE VOICE') as is_vine_voice, list_contains(b, 'TOP 500 REVIEWER') as is_top_500_reviewer from b""")
def badge_pivot(spark, sf_dir):
    m = table(spark, sf_dir, "members").select("id", "badges")
    return G.badge_flags(m, "badges", ["VINE VOICE", "TOP 500 REVIEWER"]).drop("badges")


@R.add("helpful_ratio", """select row_no, case when len(helpful) >= 2 and helpful[2] <> 0 then round(helpful[1] / helpful[2], 8) end as helpful_ratio, helpful[2] as helpful_total from reviews""")
def helpful_ratio(spark, sf_dir):
    return G.helpful_ratio(table(spark, sf_dir, "reviews").select("row_no", "helpful"), "helpful").drop("helpful").withColumn("helpful_ratio", F.round("helpful_ratio", 8))


@R.add("member_helpful_stat", """select id, case when helpfulStat[2] <> 0 then round(helpfulStat[1] / helpfulStat[2], 8) end as helpful_ratio, helpfulStat[2] as helpful_total from members""")
def member_helpful_stat(spark, sf_dir):
    return G.helpful_ratio(table(spark, sf_dir, "members").select("id", "helpfulStat"), "helpfulStat").drop("helpfulStat").withColumn("helpful_ratio", F.round("helpful_ratio", 8))


@R.add("integrity_check", f"""with {RAW_SQL} select (select count(distinct m) from raw where m not in (select c_custkey from customer)) as unknown_ends,
(select count(*) from customer where c_custkey not in (select m from raw)) as isolated""")
def integrity_check(spark, sf_dir):
    return G.integrity_violations(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), raw_reviews(spark, sf_dir), ["m"])


@R.add("isolated_removal", f"with {EDGES_SQL} select c_custkey as id from customer where c_custkey in (select m from fav)")
def isolated_removal(spark, sf_dir):
    return G.without_isolated(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), favorable_edges(spark, sf_dir), ["m"])


@R.add("complete_features", """select s_suppkey as id from supplier where s_acctbal is not null and s_name is not null and s_nationkey is not null""")
def complete_features(spark, sf_dir):
    return table(spark, sf_dir, "supplier").dropna(subset=["s_acctbal", "s_name", "s_nationkey"]).select(F.col("s_suppkey").alias("id"))


@R.add("induced_subgraph", f"""with {EDGES_SQL}, c as (select a.m as m1, b.m as m2, count(*) as cnt from fav a join fav b on a.p = b.p and a.m < b.m and abs(a.t - b.t) < {30 * P.DAY} group by all having count(*) > 1),
k as (select c_custkey from customer where c_acctbal > 0) select m1, m2, cnt from c where m1 in (from k) and m2 in (from k)""")
def induced_subgraph(spark, sf_dir):
    keep = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    return G.induced_subgraph(P.member_projection(edges(spark, sf_dir), 30 * P.DAY).select("m1", "m2", "cnt"), keep, "m1", "m2")


@R.add("author_products", f"with {EDGES_SQL} select m, string_agg(cast(p as varchar), ',' order by p) as products from fav group by m")
def author_products(spark, sf_dir):
    return G.author_products(favorable_edges(spark, sf_dir), "m", "p").withColumn("products", F.array_join(F.transform("products", lambda p: p.cast("string")), ","))


_CHAIN = f"""{EDGES_SQL}, c as (select a.m as u, b.m as v from fav a join fav b on a.p = b.p and a.m < b.m and abs(a.t - b.t) < {P.WINDOW} group by all having count(*) > 1),
s as (select u as a, v as b from c union select v, u from c)"""


@R.add("connected_components", f"""with recursive {_CHAIN}, n as (select distinct a from s),
reach(a, b) as (select a, a from n union select r.a, s.b from reach r join s on s.a = r.b) select a as id, min(b) as component from reach group by a""")
def connected_components(spark, sf_dir):
    return G.connected_components(P.member_projection(edges(spark, sf_dir), P.WINDOW), "m1", "m2")


@R.add("large_components", f"""with recursive {_CHAIN}, n as (select distinct a from s),
reach(a, b) as (select a, a from n union select r.a, s.b from reach r join s on s.a = r.b), k as (select a as id, min(b) as component from reach group by a)
select component, count(*) as size from k group by component having count(*) >= 3""")
def large_components(spark, sf_dir):
    return connected_components(spark, sf_dir).groupBy("component").agg(F.count("*").alias("size")).where("size >= 3")


@R.add("bfs_depth", f"""with recursive {_CHAIN}, walk(id, depth) as (select min(a), 0 from s union select s.b, walk.depth + 1 from walk join s on s.a = walk.id where walk.depth < 12)
select id, min(depth) as depth from walk group by id""")
def bfs_depth(spark, sf_dir):
    pairs = P.member_projection(edges(spark, sf_dir), P.WINDOW)
    return M.bfs_depth(pairs, "m1", "m2", pairs.agg(F.min("m1").alias("id")))


@R.add("node_statistics", f"""with recursive {_CHAIN}, walk(id, depth) as (select min(a), 0 from s union select s.b, walk.depth + 1 from walk join s on s.a = walk.id where walk.depth < 12),
d as (select id, min(depth) as depth from walk group by id), g as (select m, count(*) as degree from fav group by m)
select m as id, degree, depth from g left join d on d.id = m""")
def node_statistics(spark, sf_dir):
    """Degree and depth of every favourable member; depth is null out of reach."""
    return G.degrees(favorable_edges(spark, sf_dir), "m").join(bfs_depth(spark, sf_dir), "id", "left")


def _links(spark, sf_dir):
    """The favourable edges as links of nodes m... and p..."""
    return favorable_edges(spark, sf_dir).select(F.concat(F.lit("m"), F.col("m")).alias("a"), F.concat(F.lit("p"), F.col("p")).alias("b"))


@R.add("bfs_depth_favorable")
def bfs_depth_favorable(spark, sf_dir):
    """Depth over the favourable edges from the first member, to any depth."""
    links = checkpoint(_links(spark, sf_dir))
    return M.bfs_depth(links, "a", "b", links.agg(F.min("a").alias("id")))


@R.add("node_statistics_favorable")
def node_statistics_favorable(spark, sf_dir):
    """Degree and depth of every node of the favourable edges; depth is null out of reach."""
    links = checkpoint(_links(spark, sf_dir))
    ends = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return ends.join(M.bfs_depth(links, "a", "b", links.agg(F.min("a").alias("id"))), "id", "left")


@R.add("connected_components_30d")
def connected_components_30d(spark, sf_dir):
    return G.connected_components(P.member_projection(edges(spark, sf_dir), 30 * P.DAY), "m1", "m2")


@R.add("large_components_30d")
def large_components_30d(spark, sf_dir):
    return connected_components_30d(spark, sf_dir).groupBy("component").agg(F.count("*").alias("size")).where("size >= 3")


@R.add("density", f"""with {EDGES_SQL} select count(*) as edges, count(distinct m) as "left", count(distinct p) as "right", round(count(*) / (count(distinct m) * count(distinct p)), 8) as density from fav""")
def density(spark, sf_dir):
    return M.density(favorable_edges(spark, sf_dir), "m", "p").withColumn("density", F.round("density", 8))


@R.add("degree", f"with {EDGES_SQL} select p as id, count(*) as degree from edges group by p")
def degree(spark, sf_dir):
    return G.degrees(edges(spark, sf_dir), "p")


def _clustering_sql(under: str) -> str:
    return f"""with {EDGES_SQL}, d as (select p, count(*) as d from fav group by p), c as (select a.p as x, b.p as y, count(*) as c from fav a join fav b on a.m = b.m and a.p <> b.p group by all),
k as (select x, avg(c / ({under})) as k from c join d dx on dx.p = x join d dy on dy.p = y group by x) select d.p as id, round(coalesce(k, 0), 8) as clustering from d left join k on x = d.p"""


for _mode, _under in {"min": "least(dx.d, dy.d)", "dot": "dx.d + dy.d - c", "max": "greatest(dx.d, dy.d)"}.items():
    R.add(f"clustering_{_mode}", _clustering_sql(_under))(lambda spark, sf_dir, mode=_mode: M.clustering(favorable_edges(spark, sf_dir), "p", "m", mode).withColumn("clustering", F.round("clustering", 8)))


@R.add("node_redundancy", f"""with {EDGES_SQL}, l as (select a.p, a.m as a, b.m as b from fav a join fav b on a.p = b.p and a.m < b.m),
s as (select a, b from l group by all having count(*) >= 2), h as (select p, count(*) as h from l semi join s using (a, b) group by p), d as (select p, count(*) as d from fav group by p)
select p as id, case when d >= 2 then round(coalesce(h, 0) / (d * (d - 1) / 2), 8) end as redundancy from d left join h using (p)""")
def node_redundancy(spark, sf_dir):
    return M.redundancy(favorable_edges(spark, sf_dir), "p", "m").withColumn("redundancy", F.round("redundancy", 8))


@R.add("kde_burst_gate")
def kde_burst_gate(spark, sf_dir):
    """The gate over a year's window, where some products are left out."""
    return P.burst_gate(raw_reviews(spark, sf_dir), 365 * P.DAY).withColumn("p_value", F.round("p_value", 8))


@R.add("gated_member_projection", _projection_sql(7))
def gated_member_projection(spark, sf_dir):
    """The projection over products that pass the gate; at seven days all products here do, so the ungated SQL holds."""
    keep = P.burst_gate(raw_reviews(spark, sf_dir)).where("keep").select("p")
    return P.member_projection(edges(spark, sf_dir), P.WINDOW, keep=keep).withColumn("weight", F.round("weight", 8))


@R.add("dense_relabel", f"with {EDGES_SQL}, n as (select distinct 1 as part, m as id from fav union select distinct 2, p from fav) select part, id, row_number() over (order by part, id) - 1 as dense_id from n")
def dense_relabel(spark, sf_dir):
    f = favorable_edges(spark, sf_dir)
    nodes = f.select(F.lit(1).alias("part"), F.col("m").alias("id")).unionByName(f.select(F.lit(2).alias("part"), F.col("p").alias("id"))).distinct()
    return G.dense_ids(nodes, "part", "id")


@R.add("adjacency", f"with {EDGES_SQL}, s as (select 'm' || m as id, 'p' || p as n from fav union select 'p' || p, 'm' || m from fav) select id, count(*) as degree, min(n) as first_neighbor, max(n) as last_neighbor from s group by id")
def adjacency(spark, sf_dir):
    """The symmetrised neighbour lists, as the aggregates a step reads (lists themselves are never gathered)."""
    f = favorable_edges(spark, sf_dir).select(F.concat(F.lit("m"), F.col("m")).alias("a"), F.concat(F.lit("p"), F.col("p")).alias("b"))
    both = f.select(F.col("a").alias("id"), F.col("b").alias("n")).unionByName(f.select(F.col("b").alias("id"), F.col("a").alias("n")))
    return both.groupBy("id").agg(F.count("*").alias("degree"), F.min("n").alias("first_neighbor"), F.max("n").alias("last_neighbor"))


@R.add("graph_statistics", f"""with recursive {EDGES_SQL}, b as (select 'p' || p as a, 'm' || m as b from fav union all select 'm' || m, 'p' || p from fav),
  walk(id, depth) as (select 'p' || min(p), 0 from fav union select b, depth + 1 from walk join b on a = id where depth < 6), w as (select id, min(depth) as depth from walk group by id),
  l as (select a.p, a.m as a, b.m as b from fav a join fav b on a.p = b.p and a.m < b.m), s as (select a, b from l group by all having count(*) >= 2), h as (select p, count(*) as h from l semi join s using (a, b) group by p),
  d as (select p, count(*) as d from fav group by p), c as (select a.p as x, b.p as y, count(*) as c from fav a join fav b on a.m = b.m and a.p <> b.p group by all),
  k as (select x, avg(c / least(dx.d, dy.d)) as k from c join d dx on dx.p = x join d dy on dy.p = y group by x)
select d.p as id, depth, case when d >= 2 then round(coalesce(h, 0) / (d * (d - 1) / 2), 8) end as redundancy, round(coalesce(k, 0), 8) as clustering from d left join h using (p) left join k on x = d.p left join w on w.id = 'p' || d.p""")
def graph_statistics(spark, sf_dir):
    """Depth, redundancy and clustering attached to the products of the favourable edges; here all lie within six edges of the first."""
    e = checkpoint(favorable_edges(spark, sf_dir))
    found = M.statistics(e, "p", "m", e.agg(F.min("p").alias("id")))
    return found.select("id", "depth", F.round("redundancy", 8).alias("redundancy"), F.round("clustering", 8).alias("clustering"))
