import itertools
import random

import pytest
from pyspark.sql import functions as F

from veridex.functions.pages import css, member_page, member_profiles, parse, product_details, product_page
from veridex.operators import graph as G
from veridex.operators import metrics as M
from veridex.operators.skew import key_quantiles
from veridex.sources import graphs
from veridex.sources.records import MEMBER, PRODUCT, REVIEW


def test_pages_without_values(spark):
    assert set(product_page(None).values()) == {None} and product_page("<div><p>x") == product_page("")
    assert member_page("<b class='h1'>this customer's list of reviews is currently not available</b>") is None
    assert product_page("<title>Shop: Blue Lamp: Home</title>")["name"] == "Blue Lamp"
    nodes = parse('<div id="a"><p class="x y">1</p><div><p class="x">2</p></div></div><p class="x">3</p>')
    assert [nodes[i][3] for i in css(nodes, "div#a p.x")] == [["1"], ["2"]] and len(css(nodes, "p.x")) == 3
    df = spark.createDataFrame([("k", None), (None, "<h1>"), ("k", None)], "k string, html string")
    assert product_details(df, "k", "html").count() == 3 and member_profiles(df, "k", "html").count() == 3
    assert product_details(df.limit(0), "k", "html").count() == 0


def test_records_to_graph(spark):
    r = [("R1", "P1", "M1", [1, 2], 5.0, "é t", "May 1, 2012", True, "a", 1, False, 1), ("R2", "P1", "M1", None, None, "u", "soon", None, None, None, None, 2), ("R3", None, "M2", [0, 0], 1.0, None, None, None, None, None, None, 3), (None, None, None, None, 2.0, None, None, None, None, None, None, 4)]
    reviews = spark.createDataFrame(r, REVIEW + ", row_no int")
    members = spark.createDataFrame([("M1", "Ann", None, [], 3, [1, 2], 9, None), ("M3", None, None, None, None, None, None, None), ("M1", "Bob", None, [], 2, [0, 0], 1, None)], MEMBER)
    products = spark.createDataFrame([("P1", "Lamp", 2.0, None, None, None, None, None, None, None, None)], PRODUCT)
    g = G.review_graph(reviews, members, products, ["row_no"])
    assert {(e.member, e["product"], e.starRating, e.title, e.helpful_ratio) for e in g.edges.collect()} == {("M1", "P1", 5.0, "u", 0.5), ("M2", "R3", 1.0, None, None)}
    assert {(x.id, x.kind) for x in g.ids.collect()} == {("M1", "member"), ("M2", "member"), ("M3", "member"), ("P1", "product")}
    assert {(x.id, x.fullname, x.reviewStat) for x in g.members.collect()} == {("M1", "Bob", 9), ("M2", None, 1), ("M3", None, 0)}
    assert [(x.id, x.nReviews) for x in g.products.collect()] == [("P1", 1)]
    bare = G.review_graph(reviews, members, products, ["row_no"], edge_metadata=False, node_metadata=False)
    assert bare.edges.columns == ["member", "product"] and bare.members.count() == 2
    assert G.review_graph(reviews.limit(0), members.limit(0), products.limit(0), ["row_no"]).ids.count() == 0


@pytest.mark.parametrize("block", [2, 5, 2_000])
def test_wedges_of_heavy_centers(spark, monkeypatch, block):
    monkeypatch.setattr(M, "BLOCK", block)
    rng = random.Random(block)
    links = {(0, f"e{i}") for i in range(20)} | {(rng.randrange(1, 9), f"e{rng.randrange(30)}") for _ in range(60)}
    df = spark.createDataFrame(sorted(links), "c int, e string")
    of = {c: sorted(e for d, e in links if d == c) for c, _ in links}
    got = [tuple(r) for r in M.wedges(df, "c", "e").collect()]
    assert sorted(got) == sorted((c, x, y) for c, es in of.items() for x, y in itertools.combinations(es, 2))
    both = lambda c, x, y: any({x, y} <= set(es) for d, es in of.items() if d != c)
    want = {c: sum(both(c, x, y) for x, y in itertools.combinations(es, 2)) / (len(es) * (len(es) - 1) / 2) if len(es) > 1 else None for c, es in of.items()}
    assert {r.id: r.redundancy for r in M.redundancy(df, "c", "e").collect()} == pytest.approx(want)


def test_statistics_by_flags(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("x", "y")], "p string, m string")
    plain = M.statistics(df, "p", "m", calc_redundancy=False, calc_clustering=False)
    assert plain.columns == ["id"] and plain.count() == 4
    depth = M.statistics(df, "p", "m", spark.createDataFrame([("a",)], "id string"), calc_redundancy=False)
    assert {(r.id, r.depth) for r in depth.collect()} == {("a", 0), ("b", 2), ("c", None), ("x", None)}


def test_rows_of_hot_keys_do_not_enter_the_shuffle(spark, monkeypatch):
    monkeypatch.setattr("veridex.operators.skew.HOT_SHARE", 0.2)
    rows = [("hot" if i % 2 else f"k{i % 40}", float(i % 97)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.key_value: (r.n_rows, r.q_50) for r in key_quantiles(df, ["k"], F.col("v")).collect()}
    for k in {k for k, _ in rows}:
        own = sorted(v for x, v in rows if x == k)
        assert got[k] == (len(own), own[max(1, -(-len(own) // 2)) - 1])


def test_attributes_declared_far_down(spark, tmp_path):
    path = str(tmp_path / "g.graphml")
    filler = "\n".join("<!-- nothing -->" for _ in range(3000))
    with open(path, "w") as f:
        f.write(f'<?xml version="1.0"?>\n<graphml>\n{filler}\n<key id="d0" for="node" attr.name="size" attr.type="int"/>\n<graph edgedefault="undirected">\n<node id="1"><data key="d0">7</data></node>\n<edge source="1" target="1"/>\n</graph>\n</graphml>')
    assert [(r.id, r.size) for r in graphs.read_graphml(spark, path)[0].collect()] == [("1", 7)]
