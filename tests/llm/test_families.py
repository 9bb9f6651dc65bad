import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridex.llm.neardup import near_duplicate_records
from veridex.llm.text import words


@pytest.mark.parametrize(("size", "changed"), [(200, 3), (200, 6), (2000, 6)])
def test_all_pairs_of_a_family_of_edits(spark, size, changed):
    rng = random.Random(size + changed)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(size):
        t = base[:]
        for at in rng.sample(range(60), changed):
            t[at] = f"x{rng.randrange(3000)}"
        texts.append((f"r{i:04}", " ".join(t)))
    others = [(f"s{i:04}", " ".join(rng.choices([f"y{k}" for k in range(3000)], k=60))) for i in range(2 * size)]  # a third of all is the family
    df = spark.createDataFrame(texts + others, "id string, txt string")
    at: dict[str, int] = {}
    held = np.zeros((size, 3100), np.float32)
    for i, (_, x) in enumerate(texts):
        for w in x.split():
            held[i, at.setdefault(w, len(at))] += 1  # words repeat within a text hardly ever, and then count as the lesser number
    shared = held @ held.T if held.max() == 1 else np.array([np.minimum(h, held).sum(1) for h in held])
    want = {(texts[i][0], texts[j][0]) for i, j in np.argwhere(np.triu(shared >= 0.7 * 60, 1))}
    got = near_duplicate_records(df, F.col("id"), words(F.col("txt")), F.array().cast("array<string>"), ["txt"])
    if size > 200:
        assert got.count() == len(want)  # each pair given is counted exactly
    else:
        found = {(r.key_a, r.key_b) for r in got.collect()}
        assert found == want, (len(found), len(want))
