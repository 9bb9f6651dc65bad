from collections import Counter, defaultdict

from veridex.operators import projection as P
from veridex.plans import graph_queries as Q

SF = "/root/testdata/sf0.001"


def walk(links, seed):
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    depth, frontier = {seed: 0}, [seed]
    while frontier:
        frontier = sorted({b for a in frontier for b in near[a]} - set(depth))
        depth |= dict.fromkeys(frontier, depth[min(near[frontier[0]] & set(depth), key=depth.get)] + 1) if frontier else {}
    return depth


def test_bfs_depth_has_no_limit(spark, monkeypatch):
    chain = spark.createDataFrame([(i, i + 1) for i in range(15)], "m1 long, m2 long")
    monkeypatch.setattr(P, "member_projection", lambda *_, **__: chain)
    assert {r.id: r.depth for r in Q.bfs_depth(spark, SF).collect()} == {i: i for i in range(16)}


def test_depth_over_favourable_edges(spark):
    links = [(f"m{r.m}", f"p{r.p}") for r in Q.favorable_edges(spark, SF).select("m", "p").collect()]
    want, degree = walk(links, min(a for a, _ in links)), Counter(x for e in links for x in e)
    assert {r.id: r.depth for r in Q.bfs_depth_favorable(spark, SF).collect()} == want
    assert {r.id: (r.degree, r.depth) for r in Q.node_statistics_favorable(spark, SF).collect()} == {i: (n, want.get(i)) for i, n in degree.items()}


def test_components_of_the_30_day_graph(spark):
    pairs = [(r.m1, r.m2) for r in P.member_projection(Q.edges(spark, SF), 30 * P.DAY).collect()]
    want = {}
    for i in sorted({x for e in pairs for x in e}):
        if i not in want:
            want |= dict.fromkeys(walk(pairs, i), i)
    assert {r.id: r.component for r in Q.connected_components_30d(spark, SF).collect()} == want
    assert {r.component: r.size for r in Q.large_components_30d(spark, SF).collect()} == {c: n for c, n in Counter(want.values()).items() if n >= 3}
