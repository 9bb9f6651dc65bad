import random
from collections import defaultdict
from datetime import date, timedelta

from pyspark.sql import functions as F

from veridex.operators.rolling import each_day, trailing_totals
from veridex.operators.skew import key_quantiles


def test_trailing_totals_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.choice("abc"), date(2012, 1, 1) + timedelta(rng.choice([0, 1, 2, 3, 40, 41, 75, 200])), float(rng.randint(1, 5))) for _ in range(300)]
    rows += [(None, date(2012, 1, 1), 1.0), ("a", None, 1.0), ("a", date(2012, 1, 1), None)]
    df = spark.createDataFrame(rows, "k string, d date, v double").withColumn("n", F.lit(1)).withColumn("e", F.lit("x"))
    got = {(r.k, r.day): (r.n_7, r.sum_7, r.n_30, r.sum_30) for r in each_day(trailing_totals(df, "k", "d", "v")).collect()}
    own = defaultdict(list)
    for k, d, v in rows:
        if None not in (k, d, v):
            own[k].append((d, v))
    for k, xs in own.items():
        day, end = min(d for d, _ in xs), max(d for d, _ in xs) + timedelta(30)
        while day <= end:
            want = [f(v for d, v in xs if timedelta(0) <= day - d < timedelta(w)) for w in (7, 30) for f in (lambda g: len(list(g)), sum)]
            assert list(got[k, day]) == want, (k, day)
            day += timedelta(1)
    assert trailing_totals(df.limit(0), "k", "d", "v").count() == 0


def test_key_quantiles_against_sorting(spark):
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.4 else f"m{rng.randint(0, 30)}", rng.choice(["p1", "p2", " ", None]), rng.choice([None, float("nan"), rng.gauss(0, 100), 5.0])) for _ in range(4000)]
    df = spark.createDataFrame(rows, "m string, p string, x double").withColumn("key", F.lit(1)).withColumn("v", F.lit(2))
    probs = (0.0, 0.1, 0.5, 0.99, 1.0)
    got = {(r.key_field, r.key_value): tuple(r)[2:] for r in key_quantiles(df, ["m", "p"], F.col("x"), probs).collect()}
    own = defaultdict(list)
    for m, p, x in rows:
        own["m", m].append(x)
        if p and p.strip():
            own["p", p].append(x)
    assert set(got) == set(own)
    for k, xs in own.items():
        good = sorted(x for x in xs if x is not None and x == x)
        want = (len(xs), len(good), *[good[max(1, -int(-p * len(good) // 1)) - 1] if good else None for p in probs])
        assert got[k] == want, k


def test_key_quantiles_share_and_empty(spark):
    df = spark.createDataFrame([("a", 1.0)] * 99 + [("b", 2.0)], "m string, x double")
    assert [r.key_value for r in key_quantiles(df, ["m"], F.col("x"), min_share=0.02).collect()] == ["a"]
    assert {r.key_value for r in key_quantiles(df, ["m"], F.col("x"), min_share=0.01).collect()} == {"a", "b"}
    assert key_quantiles(df.limit(0), ["m"], F.col("x")).count() == 0
