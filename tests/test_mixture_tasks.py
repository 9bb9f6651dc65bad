import pytest
from pyspark.sql import functions as F

from veridex.operators import mixture as X


@pytest.fixture(scope="module")
def links(spark):
    e = spark.range(400).select((F.col("id") % 40).alias("i"), F.pmod(F.xxhash64("id"), F.lit(15)).alias("j"))
    return e.where("(i < 20) = (j < 8) or i % 7 = 0").persist()


def test_a_restart_is_solved_in_one_task_as_in_the_dataflow(spark, links, monkeypatch):
    monkeypatch.setattr(X, "PACKED", 50)
    got = {r.i: (r.cluster, r.ll) for r in X.cluster(links, 2, 4, 3, seed=1).collect()}
    monkeypatch.setattr(X, "TASK_BYTES", 0)
    want = {r.i: (r.cluster, r.ll) for r in X.cluster(links, 2, 4, 3, seed=1).collect()}
    assert got.keys() == want.keys() and all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-6 for i in want)


def test_iterations_cost_no_spark_job_each(spark, links, monkeypatch):
    monkeypatch.setattr(X, "expectation", None)
    e = links.select(F.col("i").alias("u"), F.col("j").cast("string").alias("v"))
    found = X.cluster_bipartite(e.withColumn("u", F.col("u").cast("string")), 2, 2, iterations=30, runs=8).collect()
    assert {(r.part, r.id) for r in found} == {(1, r.u) for r in e.selectExpr("string(u) u").collect()} | {(2, r.v) for r in e.collect()}
    assert {r.cluster for r in found if r.part == 1} <= {0, 1} and {r.cluster for r in found if r.part == 2} <= {2, 3}


def test_no_edges_no_clusters(spark, links):
    assert X.cluster(links.where("i < 0"), 2, 3, 2).count() == 0
