"""Queries of information measures, mixture and hard-EM clustering, evaluation, files and streams."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import nonblank
from ..operators import evaluate as V
from ..operators import hardem as H
from ..operators import information as I
from ..operators import mixture as X
from ..operators import projection as P
from ..session import checkpoint, passed_on, shared_folder, table
from ..sources import graphs, records
from ..streaming import items as S
from .data_quality import reviews_utc
from .model import EDGES_SQL, edges
from .registry import Registry

R = Registry()


# --- information ---

_H = "(select -sum(n / t * ln(n / t)) / ln({b}) from (select count(*) as n, sum(count(*)) over () as t from lineitem group by {c}))"


@R.add("entropy_counts", f"select round({_H.format(b=2, c='l_returnflag')}, 8) as entropy")
def entropy_counts(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"))
    return I.entropy_of_counts(counts, "n").select(F.round("entropy", 8).alias("entropy"))


@R.add("entropy_base10", f"select round({_H.format(b=10, c='l_quantity')}, 8) as entropy")
def entropy_base10(spark, sf_dir):
    return I.entropy(table(spark, sf_dir, "lineitem"), ["l_quantity"], 10).select(F.round("entropy", 8).alias("entropy"))


@R.add("joint_entropy", f"select round({_H.format(b=2, c='l_returnflag, l_linestatus')}, 8) as entropy")
def joint_entropy(spark, sf_dir):
    return I.entropy(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"]).select(F.round("entropy", 8).alias("entropy"))


def _mi_sql(source: str, b: float) -> str:
    return f"""with s as ({source}), n as (select count(*) as t from s), x as (select x, count(*) as n from s group by x), y as (select y, count(*) as n from s group by y), xy as (select x, y, count(*) as n from s group by x, y),
h as (select (select -sum(n / t * ln(n / t)) / ln({b}) from x, n) as h_x, (select -sum(n / t * ln(n / t)) / ln({b}) from y, n) as h_y, (select -sum(n / t * ln(n / t)) / ln({b}) from xy, n) as h_xy)
select round(h_x, 8) as h_x, round(h_y, 8) as h_y, round(h_xy, 8) as h_xy, round(h_x + h_y - h_xy, 8) as mi from h"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 8).alias(c) for c in df.columns])


@R.add("mutual_information", _mi_sql("select l_returnflag as x, l_linestatus as y from lineitem", 10))
def mutual_information(spark, sf_dir):
    return _rounded(I.mutual_information(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", 10))


@R.add("mutual_information_events", _mi_sql("select event_type as x, user_id % 7 as y from events", 2))
def mutual_information_events(spark, sf_dir):
    return _rounded(I.mutual_information(table(spark, sf_dir, "events").withColumn("y", F.col("user_id") % 7), "event_type", "y"))


_BINS = """select cast(least(floor((l_extendedprice - lo) / (hi - lo) * 10), 9) as bigint) as x, cast(least(floor((l_quantity - ql) / (qh - ql) * 10), 9) as bigint) as y
  from lineitem, (select min(l_extendedprice) as lo, max(l_extendedprice) as hi, min(l_quantity) as ql, max(l_quantity) as qh from lineitem)"""


@R.add("histogram2d", f"select x as bin_l_extendedprice, y as bin_l_quantity, count(*) as n from ({_BINS}) group by all")
def histogram2d(spark, sf_dir):
    return I.histogram(table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_quantity"), ["l_extendedprice", "l_quantity"], 10)


@R.add("mi_histogram", _mi_sql(_BINS, 2))
def mi_histogram(spark, sf_dir):
    return _rounded(I.mutual_information_binned(table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_quantity"), "l_extendedprice", "l_quantity", 10))


@R.add("min_max_scaling", "select l_orderkey, l_linenumber, round((l_quantity - lo) / (hi - lo), 8) as scaled from lineitem, (select min(l_quantity) as lo, max(l_quantity) as hi from lineitem)")
def min_max_scaling(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    bounds = lines.agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))
    return lines.join(F.broadcast(bounds)).select("l_orderkey", "l_linenumber", F.round(F.try_divide(F.col("l_quantity") - F.col("lo"), F.col("hi") - F.col("lo")), 8).alias("scaled"))


@R.add("linear_gaussian", """select round(regr_intercept(l_extendedprice, l_quantity), 3) as intercept, round(regr_slope(l_extendedprice, l_quantity), 5) as slope,
  round((regr_syy(l_extendedprice, l_quantity) - regr_slope(l_extendedprice, l_quantity) * regr_sxy(l_extendedprice, l_quantity)) / regr_count(l_extendedprice, l_quantity) / 1e6, 5) as variance_m from lineitem""")
def linear_gaussian(spark, sf_dir):
    fit = I.linear_gaussian(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity")
    return fit.select(F.round("intercept", 3).alias("intercept"), F.round("slope", 5).alias("slope"), F.round(F.col("variance") / 1e6, 5).alias("variance_m"))


@R.add("gaussian_network", """select 'l_discount' as vertex, round(avg(l_discount), 6) as intercept, cast(null as double) as coefficient from lineitem
union all select 'l_quantity', round(regr_intercept(l_quantity, l_discount), 6), round(regr_slope(l_quantity, l_discount), 6) from lineitem""")
def gaussian_network(spark, sf_dir):
    fits = I.linear_gaussian_network(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"], [("l_discount", "l_quantity")])
    return spark.createDataFrame([(f["vertex"], round(f["intercept"], 6), round(f["coefficients"][0], 6) if f["coefficients"] else None) for f in fits], "vertex string, intercept double, coefficient double")


# --- mixture ---

_E = f"""with {EDGES_SQL}, e as (select m as i, p as j from fav), r as (select unnest([0, 1])::int as r), t0 as (select r, j, ((j * 7919 + r * 104729) % 1000 + 1) / 1000.0::double as x from (select distinct j from e), r),
theta as (select r, j, x / sum(x) over (partition by r) as theta from t0), l as (select i, r, ln(0.5::double) + sum(ln(theta)) as x from e join theta using (j) group by i, r),
s as (select i, r, exp(x - max(x) over (partition by i)) as e from l), q as (select i, r, e / sum(e) over (partition by i) as q from s)"""


def _step(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = checkpoint(edges(spark, sf_dir).where("star >= 4").select(F.col("m").alias("i"), F.col("p").alias("j")))
    grid = spark.range(2).select(F.lit(0).alias("run"), F.col("id").cast("int").alias("r"))
    x = e.select("j").distinct().join(F.broadcast(grid)).withColumn("x", (F.pmod(F.col("j") * 7919 + F.col("r") * 104729, F.lit(1000)) + 1) / 1000.0)
    theta = x.join(F.broadcast(x.groupBy("run", "r").agg(F.sum("x").alias("s"))), ["run", "r"]).select("run", "r", "j", (F.col("x") / F.col("s")).alias("theta"))
    return e, theta, X.expectation(e, grid.withColumn("pi", F.lit(0.5)), theta)


@R.add("nl_em_expectation", _E + " select i, r, round(q, 6) as q from q")
def nl_em_expectation(spark, sf_dir):
    return _step(spark, sf_dir)[2].select("i", "r", F.round("q", 6).alias("q"))


@R.add("nl_em_maximization", _E + ", w as (select r, j, sum(q) as x from e join q using (i) group by r, j) select r, j, round(x / sum(x) over (partition by r), 6) as theta from w")
def nl_em_maximization(spark, sf_dir):
    e, _, q = _step(spark, sf_dir)
    return X.maximization(e, q)[1].select("r", "j", F.round("theta", 6).alias("theta"))


@R.add("nl_em_priors", _E + " select r, round(avg(q), 6) as pi from q group by r")
def nl_em_priors(spark, sf_dir):
    e, _, q = _step(spark, sf_dir)
    return X.maximization(e, q)[0].select("r", F.round("pi", 6).alias("pi"))


@R.add("nl_em_loglik", _E + """, g as (select i, arg_max(r, q) as g from q group by i), w as (select r, j, sum(q) as x from e join q using (i) group by r, j), t as (select r, j, x / sum(x) over (partition by r) as theta from w),
pi as (select r, avg(q) as pi from q group by r) select round((select sum(ln(pi)) from g join pi on g = r) + (select sum(ln(theta)) from e join g using (i) join t on t.j = e.j and t.r = g.g), 2) as ll""")
def nl_em_loglik(spark, sf_dir):
    e, _, q = _step(spark, sf_dir)
    pi, theta = X.maximization(e, q)
    return X.log_likelihood(e, pi, theta, X.assignments(q)).select(F.round("ll", 2).alias("ll"))


@R.add("nl_em_revlen_step", _E + """, v as (select l_suppkey as j0, ln(l_extendedprice) as l, o_custkey as i from lineitem join orders on l_orderkey = o_orderkey),
n as (select i, count(*) as n, sum(l) as s, sum(l * l) as ss from v group by i), mu as (select r, sum(q * s) / sum(q * n) as mu from q join n using (i) group by r)
select r, round(max(mu), 6) as mu, round(sum(q * (ss - 2 * mu * s + n * mu * mu)) / sum(q * (n - 1)), 6) as sigma2 from q join n using (i) join mu using (r) group by r""")
def nl_em_revlen_step(spark, sf_dir):
    q = _step(spark, sf_dir)[2]
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.ln("l_extendedprice").alias("l")).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("i")), "l_orderkey")
    lengths = lines.groupBy("i").agg(F.count("*").alias("n"), F.sum("l").alias("s"), F.sum(F.col("l") * F.col("l")).alias("ss"))
    return X.length_terms(lengths, q)[0].select("r", F.round("mu", 6).alias("mu"), F.round("sigma2", 6).alias("sigma2"))


@R.add("log_review_lengths", "select memberId as member, count(*) as n, round(sum(ln(length(reviewTxt))), 4) as s from reviews where length(reviewTxt) > 0 group by memberId")
def log_review_lengths(spark, sf_dir):
    r = table(spark, sf_dir, "reviews").where("length(reviewTxt) > 0")
    return r.groupBy(F.col("memberId").alias("member")).agg(F.count("*").alias("n"), F.round(F.sum(F.ln(F.length("reviewTxt"))), 4).alias("s"))


@R.add("nl_em_bipartite")
def nl_em_bipartite(spark, sf_dir):
    e = edges(spark, sf_dir).where("star >= 4").select(F.col("m").alias("u"), F.col("p").alias("v"))
    return X.cluster_bipartite(e, 2, 2, iterations=30, runs=8)


@R.add("nl_em_nodes")
def nl_em_nodes(spark, sf_dir):
    """Clusters of the projected members; null for those without an edge."""
    pairs = P.member_projection(edges(spark, sf_dir), 30 * P.DAY).select(F.col("m1").alias("u"), F.col("m2").alias("v"))
    return X.cluster_nodes(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), pairs, 3, iterations=10, runs=6)


# --- hard EM, under a fixed labelling: author % 5 ---

_Z = f"with {EDGES_SQL}, z as (select distinct m as a, m % 5 as z from fav), held as (select m as a, p as x from fav), acct as (select c_custkey as a, c_acctbal / 1000 as v, c_acctbal > 5000 as flag from customer)"
_PROJ = f""", c as (select a.m as u, b.m as v, count(*) as cnt from fav a join fav b on a.p = b.p and a.m < b.m and abs(a.t - b.t) < {30 * P.DAY} group by all having count(*) > 1),
d as (select m, count(*) as d from fav group by m), ed as (select u, v, cnt / greatest(x.d, y.d) as weight, greatest(x.d, y.d) as denom from c join d x on x.m = u join d y on y.m = v)"""


def _labels(spark, sf_dir):
    return edges(spark, sf_dir).where("star >= 4").select(F.col("m").alias("a"), (F.col("m") % 5).alias("z")).distinct()


def _held(spark, sf_dir):
    return edges(spark, sf_dir).where("star >= 4").select(F.col("m").alias("a"), F.col("p").alias("x"))


def _traits(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("a"), (F.col("c_acctbal") / 1000).alias("v"), (F.col("c_acctbal") > 5000).alias("flag"))


def _projected(spark, sf_dir):
    return P.member_projection(edges(spark, sf_dir), 30 * P.DAY).select(F.col("m1").alias("u"), F.col("m2").alias("v"), "weight", "denom")


@R.add("cluster_prior", _Z + " select z as p, count(*) as n, round(ln(count(*) / (select count(*) from z)), 8) as log_prior from z group by z")
def cluster_prior(spark, sf_dir):
    return H.prior_parameters(_labels(spark, sf_dir)).withColumn("log_prior", F.round("log_prior", 8))


@R.add("bernoulli_mstep", _Z + " select z as p, round(ln(avg(flag::int)), 8) as log_true, round(ln(1 - avg(flag::int)), 8) as log_false from z join acct using (a) group by z")
def bernoulli_mstep(spark, sf_dir):
    return H.bernoulli_parameters(_labels(spark, sf_dir), _traits(spark, sf_dir), "flag").select("p", F.round("log_true", 8).alias("log_true"), F.round("log_false", 8).alias("log_false"))


@R.add("normal_mstep", _Z + " select z as p, round(avg(v), 4) as mu, round(var_pop(v) * count(v) / (count(v) - 1 + 0.001) + 0.001, 4) as sigma2 from z join acct using (a) group by z")
def normal_mstep(spark, sf_dir):
    return H.normal_parameters(_labels(spark, sf_dir), _traits(spark, sf_dir), "v", None).select("p", F.round("mu", 4).alias("mu"), F.round("sigma2", 4).alias("sigma2"))


@R.add("normal_scores", _Z + ", k as (select z as p, avg(v) as mu from z join acct using (a) group by z) select a, p, round(-((v - mu) * (v - mu)) / (2 * 0.6 + 1e-12) - (ln(2 * pi()) + ln(0.6)) / 2, 6) as ll from z join acct using (a), k")
def normal_scores(spark, sf_dir):
    labels, traits = _labels(spark, sf_dir), _traits(spark, sf_dir)
    model = H.normal_parameters(labels, traits, "v")
    return labels.join(traits, "a").join(F.broadcast(model)).select("a", "p", F.round(H.ln_normal(F.col("v"), F.col("mu"), F.col("sigma2"), 1e-12), 6).alias("ll"))  # a row per cluster


_MULTI = """, n as (select z as p, x, count(*) as n from z join {items} h using (a) group by all), full_ as (select p, x, coalesce(n, 0) + 1e-12 as n from (select * from (select distinct z as p from z) cross join (select distinct x from {items})) left join n using (p, x)),
lp as (select p, x, ln(n / sum(n) over (partition by p)) as log_p from full_)"""


@R.add("product_multinomial", _Z + _MULTI.format(items="held") + " select p, x, round(log_p, 6) as log_p from lp")
def product_multinomial(spark, sf_dir):
    return H.multinomial_parameters(_labels(spark, sf_dir), _held(spark, sf_dir)).withColumn("log_p", F.round("log_p", 6))


@R.add("neighbor_multinomial", _Z + _PROJ + ", nb as (select u as a, v as x from ed union select v, u from ed)" + _MULTI.format(items="nb") + " select p, x, round(log_p, 6) as log_p from lp")
def neighbor_multinomial(spark, sf_dir):
    e = _projected(spark, sf_dir)
    near = e.select(F.col("u").alias("a"), F.col("v").alias("x")).unionByName(e.select(F.col("v").alias("a"), F.col("u").alias("x")))
    return H.multinomial_parameters(_labels(spark, sf_dir), near).withColumn("log_p", F.round("log_p", 6))


_SCORES = _MULTI.format(items="held") + ", sc as (select a, p, sum(log_p) as s from held join lp using (x) group by a, p), pr as (select z as p, ln(count(*) / (select count(*) from z)) as lp0 from z group by z), ns as (select z.a, pr.p, lp0 + coalesce(s, 0) as ll from z cross join pr left join sc on sc.a = z.a and sc.p = pr.p)"


@R.add("node_scores", _Z + _SCORES + " select a, p, round(ll, 5) as ll from ns")
def node_scores(spark, sf_dir):
    return _scores(spark, sf_dir).withColumn("ll", F.round("ll", 5))


def _scores(spark, sf_dir):
    labels, held = _labels(spark, sf_dir), _held(spark, sf_dir)
    return H.node_scores(labels, H.prior_parameters(labels).drop("n"), H.multinomial_scores(held, H.multinomial_parameters(labels, held)))


@R.add("mrf_loglik", _Z + _PROJ + _SCORES + """, o as (select sum(ll) as node_ll from ns join z on ns.a = z.a and ns.p = z.z), k as (select sum(weight * case when x.z = y.z then ln(0.7) else ln(1 - 0.7) end) as pair_ll from ed join z x on x.a = u join z y on y.a = v)
select round(node_ll, 3) as node_ll, round(pair_ll, 5) as pair_ll, round(node_ll + pair_ll, 3) as ll from o, k""")
def mrf_loglik(spark, sf_dir):
    ll = H.total_log_likelihood(_labels(spark, sf_dir), _scores(spark, sf_dir), _projected(spark, sf_dir), 0.7)
    return ll.select(F.round("node_ll", 3).alias("node_ll"), F.round("pair_ll", 5).alias("pair_ll"), F.round("ll", 3).alias("ll"))


@R.add("weak_edge_filter", _Z + _PROJ + " select u, v, denom from ed where denom >= 9")
def weak_edge_filter(spark, sf_dir):
    return H.strong_edges(_projected(spark, sf_dir), 9).select("u", "v", "denom")


@R.add("hard_em")
def hard_em(spark, sf_dir):
    return H.hard_em(_projected(spark, sf_dir), _held(spark, sf_dir), parts=5, restarts=16, iterations=30)


@R.add("labelled_nodes")
def labelled_nodes(spark, sf_dir):
    """Members with their name and the cluster attached; null where the graph leaves them out."""
    labels = H.hard_em(_projected(spark, sf_dir), _held(spark, sf_dir), parts=8, restarts=16, iterations=30).select(F.col("a").alias("c_custkey"), F.col("cluster").alias("cLabel"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(labels, "c_custkey", "left")


@R.add("smooth_labels")
def smooth_labels(spark, sf_dir):
    """The step for graphs of any size, from the fixed labelling. The favourable edges are found once and read by each part."""
    e = passed_on(edges(spark, sf_dir).where("star >= 4"))
    pairs = passed_on(P.member_projection(e, 30 * P.DAY).select(F.col("m1").alias("u"), F.col("m2").alias("v"), "weight"))
    held = e.select(F.col("m").alias("a"), F.col("p").alias("x"))
    labels = passed_on(held.select("a", (F.col("a") % 5).alias("z")).distinct())
    scores = H.node_scores(labels, H.prior_parameters(labels).drop("n"), H.multinomial_scores(held, H.multinomial_parameters(labels, held)))
    return H.smooth_labels(labels, scores, pairs, 0.7)


@R.add("older_hard_em")
def older_hard_em(spark, sf_dir):
    """The older model on the six-node graph: 8 restarts of 5 steps."""
    nodes, e = V.small_graph(spark)
    return H.older_hard_em(nodes.withColumn("a", F.col("id").cast("long")), e.select(F.col("u").cast("long"), F.col("v").cast("long"), "weight").withColumn("denom", F.lit(H.LEAST_DENOM)), 2, 8, 5)


# --- evaluation ---


@R.add("rand_index", f"""with {EDGES_SQL}, l as (select distinct m, m % 5 as a, m % 3 as b from fav), c as (select a, b, count(*) as n from l group by all), p as (select sum(n) * (sum(n) - 1) / 2 as p, sum(n * (n - 1) / 2) as w from c),
x as (select sum(n * (n - 1) / 2) as x from (select sum(n) as n from c group by a)), y as (select sum(n * (n - 1) / 2) as y from (select sum(n) as n from c group by b)) select round((p + 2 * w - x - y) / p, 8) as rand from p, x, y""")
def rand_index(spark, sf_dir):
    labels = edges(spark, sf_dir).where("star >= 4").select("m", (F.col("m") % 5).alias("a"), (F.col("m") % 3).alias("b")).distinct()
    return X.rand_index(labels, "a", "b").select(F.round("rand", 8).alias("rand"))


@R.add("stirling2", """with recursive s(n, k, v) as (select n::int, k::int, case when n = k then 1 when k = 1 then 1 else 0 end::bigint from range(1, 2) t(n), range(1, 6) u(k)
union all select s.n + 1, s.k, case when s.k = 1 then 1 else s.k * s.v + coalesce(lag(s.v) over (order by s.k), 0) end::bigint from s where s.n < 12) select n, k, v as s2 from s where k <= n""")
def stirling2(spark, sf_dir):
    grid = spark.range(1, 13).select(F.col("id").cast("int").alias("n"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("k")).where("k <= n")
    return V.stirling2(grid, "n", "k")


@R.add("set_partitions", """with recursive g(s, n, b) as (select '0', 1, 1 union all select s || x, n + 1, greatest(b, x + 1) from g, range(3) t(x) where n < 8 and x <= least(b, 2)) select b::int as blocks, s as labels from g where n = 8""")
def set_partitions(spark, sf_dir):
    return V.partitions(spark, 8, 3).select("blocks", F.array_join(F.transform("labels", lambda x: x.cast("string")), "").alias("labels"))


@R.add("exhaustive_top10")
def exhaustive_top10(spark, sf_dir):
    """The ten likeliest distinct scores over all partitions of the six-node graph, one labelling each."""
    scores = V.exhaustive_scores(spark, *V.small_graph(spark), 3)
    best = scores.groupBy(F.round("ll", 9).alias("ll")).agg(F.min(F.array_join(F.transform("labels", lambda x: x.cast("string")), "")).alias("labels"))
    return best.orderBy(F.desc("ll")).limit(10)


@R.add("toy_graph", "select * from (values (1, 100), (2, 120), (3, 95), (4, 500), (5, 600), (6, 850)) t(id, revLen)")
def toy_graph(spark, sf_dir):
    return V.small_graph(spark)[0].select("id", "revLen")


@R.add("synthetic_two_blocks")
def synthetic_two_blocks(spark, sf_dir):
    nodes, e = V.two_block_graph(spark, 60)
    ends = e.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.join(ends, "id", "left")


@R.add("synthetic_clusters")
def synthetic_clusters(spark, sf_dir):
    nodes, e, held = V.cluster_graph(spark, 200, 4)
    ends = e.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.join(ends, "id", "left").join(held.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("products")), "id", "left")


@R.add("synthetic_hard_em")
def synthetic_hard_em(spark, sf_dir):
    """Planted clusters against those found: one row with the Rand index."""
    nodes, e, held = V.cluster_graph(spark, 200, 3, seed=3)
    found = H.hard_em(e, held, parts=3, restarts=4, iterations=10)
    return X.rand_index(found.join(nodes.select(F.col("id").alias("a"), "acluster"), "a"), "cluster", "acluster")


# --- files and streams ---


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors share, under the session's checkpoint folder."""
    return f"{shared_folder(spark).rstrip('/')}/files-{os.urandom(6).hex()}"


def _local(folder: str) -> str:
    return re.sub("^file:/+", "/", folder)


@R.add("jsonl_roundtrip", "select id, fullname, location, ranking from members")
def jsonl_roundtrip(spark, sf_dir):
    folder = _folder(spark)
    records.write_items(table(spark, sf_dir, "members"), folder, "member")
    return records.read_items(spark, folder, "member").select("id", "fullname", "location", "ranking")


@R.add("jsonl_reviews", "select coalesce(sum(len(helpful)), 0)::bigint as votes, count(*) as n, count(starRating) as rated from reviews")
def jsonl_reviews(spark, sf_dir):
    folder = _folder(spark)
    records.write_items(table(spark, sf_dir, "reviews").drop("row_no", "page_type", "site", "crawled_at"), folder, "review")
    size = F.when(F.col("helpful").isNotNull(), F.size("helpful"))
    return records.read_items(spark, folder, "review").agg(F.coalesce(F.sum(size), F.lit(0)).alias("votes"), F.count("*").alias("n"), F.count("starRating").alias("rated"))


@R.add("jsonl_products", "select id, name, price, nReviews from products")
def jsonl_products(spark, sf_dir):
    folder = _folder(spark)
    records.write_items(table(spark, sf_dir, "products"), folder, "product")
    return records.read_items(spark, folder, "product").select("id", "name", "price", "nReviews")


@R.add("seed_csv_roundtrip", "select Type, ID from seeds")
def seed_csv_roundtrip(spark, sf_dir):
    folder = _folder(spark)
    table(spark, sf_dir, "seeds").write.option("header", True).csv(folder)
    return records.read_seeds(spark, folder)


@R.add("id_set_roundtrip", "select distinct id from members")
def id_set_roundtrip(spark, sf_dir):
    folder = _folder(spark)
    records.write_id_set(table(spark, sf_dir, "members"), "id", folder)
    return records.read_id_set(spark, folder)


@R.add("literal_source", "select * from (values (1, 'a'), (2, null)) t(k, v)")
def literal_source(spark, sf_dir):
    return spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")


def _graph_tables(spark, sf_dir):
    e = _projected(spark, sf_dir)
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label"), F.col("c_acctbal").alias("balance"))
    return nodes, e.select(F.col("u").alias("source"), F.col("v").alias("target"), "weight", "denom")


@R.add("graphml_roundtrip", "select cast(c_custkey as varchar) as id, c_name as label, c_acctbal as balance from customer")
def graphml_roundtrip(spark, sf_dir):
    path = _local(_folder(spark)) + ".graphml"
    graphs.write_graphml(*_graph_tables(spark, sf_dir), path)
    return graphs.read_graphml(spark, path)[0].select("id", "label", "balance")


@R.add("gexf_roundtrip", _Z + _PROJ + " select cast(u as varchar) as source, cast(v as varchar) as target, round(weight, 6) as weight, denom from ed")
def gexf_roundtrip(spark, sf_dir):
    path = _local(_folder(spark)) + ".gexf"
    graphs.write_gexf(*_graph_tables(spark, sf_dir), path)
    return graphs.read_gexf(spark, path)[1].select("source", "target", F.round("weight", 6).alias("weight"), F.col("attributes")["denom"].cast("bigint").alias("denom"))


@R.add("stream_dedup_export", "select distinct event_id, user_id from events")
def stream_dedup_export(spark, sf_dir):
    """The events as a stream: first of each id, exported by micro-batch, read back."""
    folder = _folder(spark)
    src = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(src).schema
    glob = src if not os.path.isfile(src) else f"{sf_dir}/event[s].parquet"
    stream = spark.readStream.schema(schema).parquet(glob).withColumn("ts", F.col("ts").cast("timestamp"))
    query = S.export(S.first_items(stream, "event_id", "ts").select("event_id", "user_id"), folder, folder + "-state", "event")
    query.awaitTermination()
    return spark.read.schema("event_id long, user_id long").json(f"{folder}/item_type=event").select("event_id", "user_id")


@R.add("detection_pipeline")
def detection_pipeline(spark, sf_dir):
    """Crawled reviews to labelled members, end to end: dates, one edge per member and product, burst gate, projection, hard EM."""
    r = reviews_utc(spark, sf_dir, "memberId", "productId", "starRating")
    clean = r.select(nonblank(F.col("memberId")).alias("member"), nonblank(F.col("productId")).alias("product"), F.floor(F.col("utc_us") / 1000000).alias("t"), F.col("starRating").alias("star"))
    clean = checkpoint(clean.where("member is not null and product is not null and t is not null and star between 1 and 5").select("member", F.xxhash64("member").alias("m"), F.xxhash64("product").alias("p"), "t", "star"))
    keep = P.burst_gate(clean.select("m", "p", "t"), 30 * P.DAY).where("keep").select("p")
    one = clean.groupBy("m", "p").agg(F.max("t").alias("t"), F.max_by("star", F.struct("t", "star")).alias("star"))
    pairs = checkpoint(P.member_projection(one, 30 * P.DAY, keep=keep).select(F.col("m1").alias("u"), F.col("m2").alias("v"), "weight", "denom"))
    held = one.where("star >= 4").select(F.col("m").alias("a"), F.col("p").alias("x"))
    labels = H.hard_em(pairs, held, parts=4, restarts=16, iterations=30)
    return clean.select("member", F.col("m").alias("a")).distinct().join(labels.select("a", "cluster"), "a").select("member", "cluster")
