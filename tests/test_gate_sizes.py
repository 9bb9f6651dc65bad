import math

import numpy as np
import pandas as pd

from veridex.operators import projection as P


def test_gate_of_a_hot_product_against_all_its_reviews(spark):
    """100,000 reviews over five years, half of them in twenty days: the gate must say what the unmerged series says."""
    rng = np.random.default_rng(5)
    n, day = 100_000, P.DAY
    days = np.concatenate([rng.uniform(0, 5 * 365, n // 2), rng.uniform(900, 920, n - n // 2)])
    ts = (days * day).astype(np.int64)
    got = P.burst_gate(spark.createDataFrame(pd.DataFrame({"p": 1, "t": ts})), 30 * day).first()
    # the same integral on a grid, by histogram and convolution
    step = day / 8
    lo, hi = ts.min() - 15 * day, ts.max() + 15 * day
    h = ts.std(ddof=1) * n**-0.2
    pad = 6 * h + 15 * day
    counts, at = np.histogram(ts, np.arange(lo - pad, hi + pad, step))
    k = np.arange(-int(6 * h / step), int(6 * h / step) + 1) * step / h
    density = np.convolve(counts, np.exp(-0.5 * k * k) / (n * h * math.sqrt(2 * math.pi)), "same")
    inside = np.convolve(density, np.ones(int(30 * day / step) + 1), "same") * step
    mid = (at[1:] + at[:-1]) / 2
    exact = (density * inside * step)[(mid > lo) & (mid < hi)].sum()
    assert got.n == n and abs(got.p_value - exact) < 0.01 * exact
