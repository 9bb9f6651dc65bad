import math
import time
from collections import defaultdict

from pyspark.sql import functions as F

from veridex.plans import model_queries as M
from veridex.session import passed_on

SF = "/root/testdata/sf0.001"


def _smoothed(labels, scores, edges, turns, tau=0.7, rounds=4):
    k, near = math.log(tau) - math.log(1 - tau), defaultdict(list)
    for u, v, w in edges:
        near[u].append((v, w))
        near[v].append((u, w))
    for i in range(rounds):
        new = dict(labels)
        for a in labels:
            if turns[a] == i % 2:
                pull = defaultdict(float)
                for b, w in near[a]:
                    pull[labels[b]] += w * k
                new[a] = max(scores[a], key=lambda p: (scores[a][p] + pull[p], -p))
        labels = new
    return labels


def test_edges_are_found_once_and_labels_are_those_of_plain_python(spark, monkeypatch):
    found = M.edges(spark, SF)
    labels = {r.a: r.z for r in M._labels(spark, SF).collect()}
    scores = defaultdict(dict)
    for r in M._scores(spark, SF).collect():
        scores[r.a][r.p] = r.ll
    edges = [(r.u, r.v, r.weight) for r in M._projected(spark, SF).collect()]
    turns = {r.a: r.t for r in M._labels(spark, SF).select("a", F.pmod(F.xxhash64("a"), F.lit(2)).alias("t")).collect()}
    calls = []
    monkeypatch.setattr(M, "edges", lambda *args: calls.append(args) or found)
    got = {r.a: r.z for r in M.smooth_labels(spark, SF).collect()}
    assert len(calls) == 1
    assert got == _smoothed(labels, scores, edges, turns)


def test_shuffle_files_are_gone_once_a_table_is_written(spark):
    kept = lambda: sum("shuffle" in f for f in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString(" ").split())
    time.sleep(1)
    before = kept()
    df = passed_on(spark.range(1000).repartition(7).groupBy((F.col("id") % 10).alias("k")).count())
    for _ in range(50):
        if kept() <= before:
            break
        time.sleep(0.1)
    assert kept() <= before and df.count() == 10
