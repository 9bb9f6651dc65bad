import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veridex.operators import evaluate as V
from veridex.operators import graph as G
from veridex.operators import hardem as H
from veridex.operators import information as I
from veridex.operators import metrics as M
from veridex.operators import mixture as X
from veridex.operators import projection as P
from veridex.sources import graphs

# fixed values: the karate club's friendships and its factions' members
KARATE = """1-2 1-3 1-4 1-5 1-6 1-7 1-8 1-9 1-11 1-12 1-13 1-14 1-18 1-20 1-22 1-32 2-3 2-4 2-8 2-14 2-18 2-20 2-22 2-31 3-4 3-8 3-9 3-10 3-14 3-28 3-29 3-33
4-8 4-13 4-14 5-7 5-11 6-7 6-11 6-17 7-17 9-31 9-33 9-34 10-34 14-34 15-33 15-34 16-33 16-34 19-33 19-34 20-34 21-33 21-34 23-33 23-34 24-26 24-28 24-30 24-33 24-34
25-26 25-28 25-32 26-32 27-30 27-34 28-34 29-32 29-34 30-33 30-34 31-33 31-34 32-33 32-34 33-34"""
FIRST = {1, 2, 3, 4, 5, 6, 7, 8, 11, 12, 13, 14, 17, 18, 20, 22}


def test_projection_against_pairs(spark):
    rng = np.random.default_rng(1)
    rows = sorted({(int(m), int(p)): (int(m), int(p), int(t), float(s)) for m, p, t, s in zip(rng.integers(0, 12, 300), rng.integers(0, 9, 300), rng.integers(0, 40, 300) * 86400 - 86400, rng.integers(1, 6, 300), strict=True)}.values())
    e = spark.createDataFrame(rows, "m long, p long, t long, star double")
    good = [r for r in rows if r[3] >= 4]
    cnt, deg = {}, {}
    for m, p, t, _ in good:
        deg[m] = deg.get(m, 0) + 1
        for m2, p2, t2, _ in good:
            if p == p2 and m < m2 and abs(t - t2) < P.WINDOW:
                cnt[m, m2] = cnt.get((m, m2), 0) + 1
    want = {(a, b, c, max(deg[a], deg[b])) for (a, b), c in cnt.items() if c > 1}
    assert {(r.m1, r.m2, r.cnt, r.denom) for r in P.member_projection(e).collect()} == want
    assert P.member_projection(e.limit(0)).count() == 0


def test_collapse_keeps_last_known_value(spark):
    df = spark.createDataFrame([(1, 1, 1, "a", 5), (1, 1, 2, None, 6), (1, 1, 3, "c", None), (2, 1, 1, None, None)], "m int, p int, t int, x string, y int")
    assert {tuple(r) for r in G.collapse_edges(df, ["m", "p"], ["t"], ["x", "y"]).collect()} == {(1, 1, "c", 6), (2, 1, None, None)}


def test_components_of_a_long_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "u int, v int")
    got = {r.id: r.component for r in G.connected_components(e, "u", "v").collect()}
    assert {got[i] for i in range(61)} == {0} and got[100] == got[101] == 100


def test_bfs_and_metrics(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 10)], "u int, v int")
    assert {tuple(r) for r in M.bfs_depth(e, "u", "v", spark.createDataFrame([(1,)], "id int")).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}
    b = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 2)], "m string, p int")
    assert {tuple(r) for r in M.redundancy(b, "m", "p").collect()} == {("a", 1.0), ("b", 1.0), ("c", None)}
    assert {r.id: round(r.clustering, 6) for r in M.clustering(b, "m", "p", "dot").collect()} == {"a": 0.75, "b": 0.75, "c": 0.5}
    assert round(M.density(b, "m", "p").first().density, 6) == round(5 / 6, 6)


def test_burst_gate(spark):
    day = P.DAY
    rows = [(1, i * day // 4) for i in range(60)] + [(2, i * 40 * day) for i in range(60)] + [(3, 5)] * 60 + [(4, i) for i in range(10)]
    got = {r.p: r for r in P.burst_gate(spark.createDataFrame(rows, "p long, t long")).collect()}
    assert not got[1].keep and got[1].p_value > 0.05  # sixty reviews within two weeks fall close together anyway
    assert got[2].keep and got[3].keep and got[4].keep and got[3].p_value is None and got[4].n == 10


def test_information(spark):
    df = spark.createDataFrame([(x, y) for x, y in zip([0, 0, 1, 1, 2, 2, 2, 0], [0, 0, 1, 1, 1, 1, 0, 0], strict=True)], "x int, y int")
    r = I.mutual_information(df, "x", "y").first()
    assert abs(r.mi - (r.h_x + r.h_y - r.h_xy)) < 1e-12
    assert abs(I.entropy(df.withColumn("x2", F.col("x")), ["x", "x2"]).first()[0] - r.h_x) < 1e-12  # H(X, X) = H(X)
    assert abs(r.h_y - 1.0) < 1e-12
    assert I.topological_order(["c", "a", "b"], [("a", "b"), ("b", "c")]) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        I.topological_order(["a", "b"], [("a", "b"), ("b", "a")])
    xs = np.random.default_rng(0).normal(size=(200, 2))
    data = [(float(a), float(b), float(2 * a - b + 3)) for a, b in xs]
    fit = I.linear_gaussian_network(spark.createDataFrame(data, "a double, b double, y double"), ["a", "b", "y"], [("a", "y"), ("b", "y")])[-1]
    assert fit["vertex"] == "y" and np.allclose([fit["intercept"], *fit["coefficients"]], [3, 2, -1]) and abs(fit["variance"]) < 1e-8
    assert I.binned(df.withColumn("k", F.lit(3)), ["k"], 4).where("bin_k is not null").count() == 0


def test_karate(spark):
    pairs = [tuple(map(int, x.split("-"))) for x in KARATE.split()]
    assert len(pairs) == 78
    both = spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "i int, j int")
    found = X.cluster(both, 2, iterations=10, runs=6, seed=1)
    truth = found.withColumn("faction", F.col("i").isin(FIRST).cast("int"))
    assert X.rand_index(truth, "cluster", "faction").first().rand >= 0.94


def test_rand_index(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 1), (1, 0)], "a int, b int")
    assert X.rand_index(df, "a", "b").first().rand == pytest.approx(0.5)


def test_older_model_golden_values():
    nodes = pd.DataFrame(V.SMALL_NODES, columns=["id", "hlpful_fav_unfav", "isRealName", "revLen"]).set_index("id")
    edges = [(a, b, 0.3) for a, b in V.SMALL_EDGES]
    ll, parameters = H.older_log_likelihood(nodes, edges, [0, 0, 0, 1, 1, 1])
    assert ll == pytest.approx(-43.490385136, abs=1e-6)
    assert parameters[0]["log_prior"] == pytest.approx(-0.691315, abs=1e-6) and parameters[1]["sigma2"] == pytest.approx(32483.759121, abs=1e-5)
    assert parameters[0]["isRealName"] == pytest.approx(0.666445, abs=1e-6) and parameters[0]["sigma2"] == pytest.approx(174.913544, abs=1e-5)
    assert H.older_log_likelihood(nodes, edges, [0, 1, 0, 1, 0, 1])[0] == pytest.approx(-56.534782489, abs=1e-6)


def test_partitions_and_stirling(spark):
    assert len(list(V.set_partitions(10, 1))) + len(list(V.set_partitions(10, 2))) == 512
    assert V.partitions(spark, 10, 2).count() == 512
    assert {tuple(r) for r in V.stirling2(spark.createDataFrame([(10, 1), (10, 2), (16, 2)], "n int, k int"), "n", "k").collect()} == {(10, 1, 1), (10, 2, 511), (16, 2, 32767)}
    nodes = pd.DataFrame(V.SMALL_NODES, columns=["id", "hlpful_fav_unfav", "isRealName", "revLen"]).set_index("id")
    edges = [(a, b, 0.3) for a, b in V.SMALL_EDGES]
    want = {tuple(z): H.older_log_likelihood(nodes, edges, z)[0] for k in (1, 2) for z in V.set_partitions(6, k)}
    got = {tuple(r.labels): r.ll for r in V.exhaustive_scores(spark, *V.small_graph(spark), 2).collect()}
    assert got == pytest.approx(want)


def test_relaxed_labels_match_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(8):
        cost = rng.normal(size=(6, 2))
        u, v = np.array([0, 1, 2, 3, 4]), np.array([1, 2, 3, 4, 5])
        pull = rng.random(5)
        z = H.relaxed_labels(cost, u, v, pull, 4000)
        value = lambda q: sum(cost[i, c] for i, c in enumerate(q)) + sum(w for a, b, w in zip(u, v, pull, strict=True) if q[a] != q[b])
        assert value(z) == pytest.approx(min(value([(k >> i) & 1 for i in range(6)]) for k in range(64)), abs=1e-6)


def test_hard_em_finds_planted_clusters(spark):
    nodes, e, held = V.cluster_graph(spark, 120, 2, seed=3)
    found = H.hard_em(e, held, parts=2, restarts=12, iterations=15)
    joined = found.join(nodes.select(F.col("id").alias("a"), "acluster"), "a")
    assert X.rand_index(joined, "cluster", "acluster").first().rand > 0.9
    empty = H.hard_em(e.limit(0), held, parts=2, restarts=1)
    assert empty.count() == 0


def test_graph_files(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "A & <b>", 1, 0.5, True), ("é", None, None, None, None)], "id string, label string, k int, x double, f boolean")
    edges = spark.createDataFrame([("a", "é", 0.25)], "source string, target string, weight double")
    graphs.write_graphml(nodes, edges, str(tmp_path / "g.graphml"))
    n, e = graphs.read_graphml(spark, str(tmp_path / "g.graphml"))
    assert {tuple(r) for r in n.collect()} == {tuple(r) for r in nodes.collect()} and [tuple(r) for r in e.collect()] == [("a", "é", 0.25)]
    graphs.write_gexf(nodes, edges, str(tmp_path / "g.gexf"))
    n, e = graphs.read_gexf(spark, str(tmp_path / "g.gexf"))
    assert {r.id for r in n.collect()} == {"a", ""} and e.first().weight == 0.25  # letters beyond ASCII are dropped
    assert math.isclose(float(n.where("id = 'a'").first().attributes["x"]), 0.5)
