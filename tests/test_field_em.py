import numpy as np
from pyspark.sql import functions as F

from veridex.operators import evaluate as V
from veridex.operators import hardem as H


def _as_graph(e, held):
    ids = sorted({x for r in e for x in (r.u, r.v)})
    at = {a: i for i, a in enumerate(ids)}
    names = {x: i for i, x in enumerate(sorted({r.x for r in held}))}
    items = [[] for _ in ids]
    for r in held:
        items[at[r.a]].append(names[r.x])
    return ids, H.Graph(len(ids), np.array([at[r.u] for r in e]), np.array([at[r.v] for r in e]), np.array([r.weight for r in e]), [np.array(x, np.int64) for x in items], len(names))


def test_one_labelling_as_within_one_task(spark):
    nodes, edges, held = V.cluster_graph(spark, 90, 3, seed=3)
    e = edges.select(F.col("u").cast("long"), F.col("v").cast("long"), "weight").orderBy("u", "v")
    ends = e.select(F.explode(F.array("u", "v")).alias("a")).distinct()
    h = held.select(F.col("a").cast("long"), F.col("x").cast("string")).join(ends, "a", "left_semi")
    ids, g = _as_graph(e.collect(), h.collect())
    start = nodes.select(F.col("id").cast("long").alias("a"), F.when(F.col("id") % 4 == 0, (F.col("acluster") + 1) % 3).otherwise(F.col("acluster")).alias("z")).join(ends, "a", "left_semi")
    first = {r.a: r.z for r in start.collect()}
    ll, z = H.run_restart(g, 3, 0.7, 3, 0, np.array([first[a] for a in ids]))
    near = e.select(F.col("u").alias("a"), F.col("v").cast("string").alias("x")).unionByName(e.select(F.col("v").alias("a"), F.col("u").cast("string").alias("x")))
    found = H.field_em(ends, e, [H.Prior(), H.Items(h), H.Items(near)], 3, 0.7, 1, 3, start=start).collect()
    got = {r.a: r.cluster for r in found}
    assert np.mean([got[a] == int(z[i]) for i, a in enumerate(ids)]) > 0.97 and abs(found[0].ll - ll) < 0.01 * abs(ll)


def test_older_model_on_the_small_graph(spark):
    nodes, edges = V.small_graph(spark)
    n = nodes.withColumn("a", F.col("id").cast("long"))
    e = edges.select(F.col("u").cast("long"), F.col("v").cast("long"), "weight").withColumn("denom", F.lit(5))
    start = n.select("a", F.when(F.col("a") <= 3, 0).otherwise(1).alias("z"))
    kept = H.older_hard_em(n, e, 2, 1, 0, 0.8, None, start=start).collect()
    assert abs(kept[0].ll + 43.490385136) < 1e-6 and {r.a: r.cluster for r in kept} == {1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: 1}
    best = H.older_hard_em(n, e, 2, 6, 5, 0.8, None).collect()
    assert best[0].ll >= -56.5 and {r.a for r in best} == set(range(1, 7))


def test_large_components_are_smoothed(spark):
    nodes, edges, held = V.cluster_graph(spark, 60, 2, seed=1)
    e = edges.select(F.col("u").cast("long"), F.col("v").cast("long"), "weight")
    ends = e.select(F.explode(F.array("u", "v")).alias("a")).distinct()
    h = held.select(F.col("a").cast("long"), F.col("x").cast("string"))
    found = H.field_em(ends, e, [H.Prior(), H.Items(h)], 2, 0.7, 2, 3, task_edges=3)
    assert found.count() == ends.count() and found.select("ll").distinct().count() == 1
