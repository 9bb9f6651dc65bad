"""Hard-EM clustering of authors over a pairwise Markov random field."""

from __future__ import annotations

import logging
import math
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint, passed_on
from .graph import connected_components
from .mixture import hashed_noise, ln_normal

log = logging.getLogger(__name__)

EPS = 1e-12
#: Denominator of an edge weight below which the edge is left out.
LEAST_DENOM = 3
SIGMA2 = 0.6
OLD_EPS = 0.001
#: Edges of a graph up to which a restart is solved within one task.
TASK_EDGES = 2_000_000


# --- factors, distributed: each takes (a, z) labels and returns parameters or (a, p, ll) scores ---


def prior_parameters(labels: DataFrame, eps: float = EPS) -> DataFrame:
    """(p, n, log_prior): logarithm of each cluster's share."""
    n = labels.groupBy(F.col("z").alias("p")).agg(F.count("*").alias("n"))
    return n.join(F.broadcast(labels.agg(F.count("*").alias("all")))).select("p", "n", F.ln(F.greatest(F.col("n") / F.col("all"), F.lit(eps))).alias("log_prior"))


def bernoulli_parameters(labels: DataFrame, features: DataFrame, flag: str) -> DataFrame:
    """(p, log_true, log_false) of a boolean feature, clipped away from 0 and 1."""
    share = labels.join(features, "a").groupBy(F.col("z").alias("p")).agg(F.avg(F.col(flag).cast("double")).alias("v"))
    v = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), F.col("v")))
    return share.select("p", F.ln(v).alias("log_true"), F.ln(1 - v).alias("log_false"))


def normal_parameters(labels: DataFrame, features: DataFrame, value: str, fixed: float | None = SIGMA2) -> DataFrame:
    """(p, mu, sigma2) of a number; the variance is fixed, or estimated where ``fixed`` is None (smoothed like the older model's)."""
    g = labels.join(features, "a").groupBy(F.col("z").alias("p"))
    n, m2 = F.count(value), F.var_pop(value) * F.count(value)
    var = F.lit(fixed) if fixed is not None else m2 / (n - 1 + OLD_EPS) + OLD_EPS
    return g.agg(F.avg(value).alias("mu"), var.alias("sigma2"))


def multinomial_parameters(labels: DataFrame, items: DataFrame, all_items: DataFrame | None = None) -> DataFrame:
    """(p, x, log_p): each cluster's distribution over what its authors hold, an item once per author, absent ones at EPS."""
    distinct = items.select("a", "x").distinct()
    counts = labels.join(distinct, "a").groupBy(F.col("z").alias("p"), "x").agg(F.count("*").alias("n"))
    grid = labels.select(F.col("z").alias("p")).distinct().join((items if all_items is None else all_items).select("x").distinct())  # clusters x items: the model itself
    full = grid.join(counts, ["p", "x"], "left").select("p", "x", (F.coalesce("n", F.lit(0)) + EPS).alias("n"))
    total = full.groupBy("p").agg(F.sum("n").alias("s"))
    return full.join(F.broadcast(total), "p").select("p", "x", F.ln(F.col("n") / F.col("s")).alias("log_p"))


def multinomial_scores(items: DataFrame, parameters: DataFrame) -> DataFrame:
    """(a, p, ll): sums over an author's items, repeated ones as often as held.

    An item's logarithms travel to its authors as one row, a value per cluster, and are taken apart there.
    """
    per = parameters.groupBy("x").agg(F.collect_list(F.struct("p", "log_p")).alias("of"))
    met = items.select("a", "x").join(per, "x").select("a", "of").repartition("a")
    return met.select("a", F.inline("of")).groupBy("a", "p").agg(F.sum("log_p").alias("ll"))


def node_scores(labels: DataFrame, prior: DataFrame, *parts: DataFrame) -> DataFrame:
    """(a, p, ll) for every author and cluster: the prior and all other factors; an author a factor says nothing of gets 0."""
    out = labels.select("a").join(F.broadcast(prior)).select("a", "p", F.col("log_prior").alias("ll"))
    for part in parts:
        out = out.join(part.withColumnRenamed("ll", "more"), ["a", "p"], "left").select("a", "p", (F.col("ll") + F.coalesce("more", F.lit(0.0))).alias("ll"))
    return out


def pair_term(edges: DataFrame, labels: DataFrame, tau: float) -> DataFrame:
    """One row: sum over edges (u, v, weight) of weight * ln tau where labels agree, else ln(1 - tau)."""
    a, b = labels.select(F.col("a").alias("u"), F.col("z").alias("zu")), labels.select(F.col("a").alias("v"), F.col("z").alias("zv"))
    same = F.when(F.col("zu") == F.col("zv"), math.log(tau)).otherwise(math.log(1 - tau))
    return edges.join(a, "u").join(b, "v").agg(F.coalesce(F.sum(F.col("weight") * same), F.lit(0.0)).alias("pair_ll"))


def total_log_likelihood(labels: DataFrame, scores: DataFrame, edges: DataFrame, tau: float) -> DataFrame:
    own = labels.join(scores, (labels.a == scores.a) & (labels.z == scores.p)).agg(F.sum("ll").alias("node_ll"))
    return own.join(pair_term(edges, labels, tau)).select("node_ll", "pair_ll", (F.col("node_ll") + F.col("pair_ll")).alias("ll"))


def strong_edges(edges: DataFrame, least: int = LEAST_DENOM) -> DataFrame:
    return edges.where(F.col("denom") >= least)


def smooth_labels(labels: DataFrame, scores: DataFrame, edges: DataFrame, tau: float, rounds: int = 4, by: Sequence[str] = ()) -> DataFrame:
    """E-step for components too large for one task: coordinate ascent, each half of the nodes in turn (an approximation of the relaxation).

    A node takes the cluster of the largest score plus its neighbours' agreement; the lowest of equals. ``by`` names columns that ``labels`` and
    ``scores`` have besides, such as the number of a restart. Every round reads scores and edges, so they are written once.
    """
    k = math.log(tau) - math.log(1 - tau)
    scores, edges = passed_on(scores), passed_on(edges.select("u", "v", "weight"))
    both = edges.select("u", "v", "weight").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "weight"))
    for i in range(rounds):
        near = both.join(labels.select(*by, F.col("a").alias("v"), F.col("z").alias("p")), "v").groupBy(*by, F.col("u").alias("a"), "p").agg((F.sum("weight") * k).alias("more"))
        total = scores.join(near, [*by, "a", "p"], "left").select(*by, "a", "p", (F.col("ll") + F.coalesce("more", F.lit(0.0))).alias("x"))
        best = total.groupBy(*by, "a").agg(F.max_by("p", F.struct("x", -F.col("p"))).alias("new"))
        turn = F.pmod(F.xxhash64("a"), F.lit(2)) == i % 2
        labels = passed_on(labels.join(best, [*by, "a"], "left").select(*by, "a", F.when(turn, F.coalesce("new", "z")).otherwise(F.col("z")).alias("z")))
    return labels


# --- one restart, within a task ---


@dataclass
class Graph:
    n: int
    u: np.ndarray
    v: np.ndarray
    weight: np.ndarray
    items: list[np.ndarray]  # per author, what it holds
    n_items: int


def project_simplex(x: np.ndarray) -> np.ndarray:
    """Nearest points of the probability simplex to the rows of ``x``."""
    s = -np.sort(-x, axis=1)
    c = (np.cumsum(s, axis=1) - 1) / np.arange(1, x.shape[1] + 1)
    k = (s > c).sum(1)
    return np.maximum(x - c[np.arange(len(x)), k - 1][:, None], 0)


def relaxed_labels(cost: np.ndarray, u: np.ndarray, v: np.ndarray, pull: np.ndarray, iterations: int = 600) -> np.ndarray:
    """Minimise sum(cost * alpha) + sum over edges of pull / 2 * |alpha_u - alpha_v| over simplices, and round to the largest.

    The linear relaxation of labelling with a uniform metric, solved by a primal-dual iteration.
    """
    n, p = cost.shape
    if not len(u):
        return cost.argmin(1)
    alpha = project_simplex(-cost + cost.min(1, keepdims=True))
    bar, dual = alpha.copy(), np.zeros((len(u), p))
    step = 0.99 / math.sqrt(2 * np.bincount(np.concatenate([u, v]), minlength=n).max())
    limit = (pull / 2)[:, None]
    for _ in range(iterations):
        dual = np.clip(dual + step * (bar[u] - bar[v]), -limit, limit)
        push = cost.copy()
        np.add.at(push, u, dual)
        np.subtract.at(push, v, dual)
        new = project_simplex(alpha - step * push)
        bar = 2 * new - alpha
        done = np.abs(new - alpha).max() < 1e-7
        alpha = new
        if done:
            break
    return alpha.argmax(1)


def run_restart(g: Graph, parts: int, tau: float, iterations: int, seed: int, start: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """(log-likelihood, labels) of one restart: prior, products and neighbours as factors, until labels and likelihood rest."""
    rng = np.random.default_rng(seed)
    near: list[list[int]] = [[] for _ in range(g.n)]
    for a, b in zip(g.u.tolist(), g.v.tolist(), strict=True):
        near[a].append(b)
        near[b].append(a)
    held = [(g.items, g.n_items), ([np.array(x, np.int64) for x in near], g.n)]
    flat = [(np.repeat(np.arange(g.n), [len(x) for x in h]), np.concatenate(h).astype(np.int64) if h else np.zeros(0, np.int64), size) for h, size in held]
    k = math.log(tau) - math.log(1 - tau)

    def fit(z: np.ndarray) -> list[np.ndarray]:
        out = [np.log(np.clip(np.bincount(z, minlength=parts) / g.n, EPS, 1))]
        for who, what, size in flat:
            once = np.unique(who * max(size, 1) + what)
            counts = np.full((parts, size), EPS)
            np.add.at(counts, (z[once // max(size, 1)], once % max(size, 1)), 1)
            out.append(np.log(counts / counts.sum(1, keepdims=True)))
        return out

    def scores(theta: list[np.ndarray]) -> np.ndarray:
        s = np.tile(theta[0], (g.n, 1))
        for (who, what, _), table in zip(flat, theta[1:], strict=True):
            np.add.at(s, who, table[:, what].T)
        return s

    if start is None:
        z = np.zeros(g.n, np.int64)
        theta = [np.log(rng.dirichlet([10.0] * parts))] + [np.log(np.maximum(rng.dirichlet([1.0] * size, parts), EPS)) if size else np.zeros((parts, 0)) for _, _, size in flat]
    else:
        z = start.copy()
        theta = fit(z)
    last = -math.inf
    for i in range(iterations):
        # random parameters say little, and neighbours would all agree on one cluster at once: the first step is without them
        pull = g.weight * (0.0 if start is None and i == 0 else k)
        new = relaxed_labels(-scores(theta), g.u, g.v, pull)
        changed = float((new != z).mean())
        z = new
        theta = fit(z)
        same = z[g.u] == z[g.v]
        ll = float(scores(theta)[np.arange(g.n), z].sum() + (g.weight * np.where(same, math.log(tau), math.log(1 - tau))).sum())
        if changed <= 1e-3 and abs(ll - last) <= 1e-3:
            last = ll
            break
        last = ll
    return last, z


def hard_em(edges: DataFrame, items: DataFrame, parts: int = 5, restarts: int = 16, iterations: int = 30, tau: float = 0.7, seed: int = 0) -> DataFrame:
    """(a, cluster, ll): labels of the likeliest restart, the earlier of equals.

    ``edges`` has u, v, weight, denom (weak ones are left out), ``items`` (a, x). The graph of a restart is solved within one task where its
    size is checked to allow; restarts run side by side, seeded by their number. Larger graphs go through :func:`field_em`.
    """
    strong = strong_edges(edges).select(F.col("u").cast("long"), F.col("v").cast("long"), F.col("weight").cast("double"))
    ends = strong.select(F.explode(F.array("u", "v")).alias("a")).distinct()
    held = items.select(F.col("a").cast("long"), F.col("x").cast("string")).join(ends, "a", "left_semi")
    if strong.limit(TASK_EDGES + 1).count() > TASK_EDGES or held.limit(TASK_EDGES + 1).count() > TASK_EDGES:
        near = strong.select(F.col("u").alias("a"), F.col("v").cast("string").alias("x")).unionByName(strong.select(F.col("v").alias("a"), F.col("u").cast("string").alias("x")))
        return field_em(ends, strong, [Prior(), Items(held), Items(near)], parts, tau, restarts, iterations, seed=seed)
    e, h = strong.orderBy("u", "v").toPandas(), held.orderBy("a", "x").toPandas()  # size checked above
    ids = np.unique(np.concatenate([e["u"], e["v"]])) if len(e) else np.zeros(0, np.int64)
    codes, names = pd.factorize(h["x"])
    who = np.searchsorted(ids, h["a"].to_numpy())
    order = np.argsort(who, kind="stable")
    per = np.split(codes[order].astype(np.int64), np.cumsum(np.bincount(who, minlength=len(ids)))[:-1]) if len(ids) else []
    g = Graph(len(ids), np.searchsorted(ids, e["u"]), np.searchsorted(ids, e["v"]), e["weight"].to_numpy(float), per, len(names))
    spark = edges.sparkSession

    def solve(key: tuple, _: pd.DataFrame) -> pd.DataFrame:
        if not g.n:
            return pd.DataFrame({"run": [], "ll": [], "a": [], "cluster": []}).astype({"run": "int64", "a": "int64", "cluster": "int32"})
        ll, z = run_restart(g, parts, tau, iterations, seed + int(key[0]))
        return pd.DataFrame({"run": int(key[0]), "ll": ll, "a": ids, "cluster": z.astype(np.int32)})

    runs = spark.range(restarts).repartition(min(restarts, 64), "id").groupBy("id").applyInPandas(solve, "run long, ll double, a long, cluster int")
    runs = checkpoint(runs)
    best = runs.groupBy("run", "ll").agg(F.count("*").alias("n")).orderBy(F.desc("ll"), "run").limit(1).select("run")
    return runs.join(F.broadcast(best), "run").select("a", "cluster", "ll")


# --- the same model on DataFrames: any number of restarts at once, no graph in the driver or in one task ---


class Factor(Protocol):
    """A part of the model: parameters from labels (run, a, z), and scores (run, a, p, ll) of every node that it says something of."""

    def scores(self, labels: DataFrame, parts: int) -> DataFrame: ...


def _grid(labels: DataFrame, parts: int) -> DataFrame:
    """(run, p): as many rows as runs and clusters."""
    return labels.select("run").distinct().select("run", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("p"))


@dataclass
class Prior:
    """Each cluster's share; ``smooth`` is the older model's smoothing, added outside and inside."""

    smooth: float | None = None

    def scores(self, labels: DataFrame, parts: int) -> DataFrame:
        n = labels.groupBy("run", F.col("z").alias("p")).agg(F.count("*").alias("n"))
        total = labels.groupBy("run").agg(F.count("*").alias("all"))
        e = self.smooth
        share = F.coalesce("n", F.lit(0))
        value = F.ln(F.greatest(share / F.col("all"), F.lit(EPS))) if e is None else F.ln(share / (F.col("all") + e) + e)
        model = _grid(labels, parts).join(n, ["run", "p"], "left").join(total, "run").select("run", "p", value.alias("ll"))
        return labels.select("run", "a").join(F.broadcast(model), "run")  # a row per run and cluster


@dataclass
class Flag:
    """A boolean of each node under the older model."""

    nodes: DataFrame
    flag: str
    smooth: float = OLD_EPS

    def scores(self, labels: DataFrame, parts: int) -> DataFrame:
        own = self.nodes.select("a", F.col(self.flag).cast("boolean").alias("v")).where("v is not null")
        sums = labels.join(own, "a").groupBy("run", F.col("z").alias("p")).agg(F.sum(F.col("v").cast("double")).alias("c"), F.count("*").alias("n"))
        rate = F.coalesce("c", F.lit(0.0)) / (F.coalesce("n", F.lit(0)) + self.smooth)
        model = _grid(labels, parts).join(sums, ["run", "p"], "left").select("run", "p", F.ln(rate + self.smooth).alias("yes"), F.ln(1 - rate + self.smooth).alias("no"))
        return labels.select("run", "a").join(own, "a").join(F.broadcast(model), "run").select("run", "a", "p", F.when(F.col("v"), F.col("yes")).otherwise(F.col("no")).alias("ll"))


@dataclass
class Number:
    """A number of each node, normal with an estimated variance as in the older model, or a fixed one."""

    nodes: DataFrame
    value: str
    fixed: float | None = None
    smooth: float = OLD_EPS

    def scores(self, labels: DataFrame, parts: int) -> DataFrame:
        own = self.nodes.select("a", F.col(self.value).cast("double").alias("v")).where("v is not null")
        sums = labels.join(own, "a").groupBy("run", F.col("z").alias("p")).agg(F.avg("v").alias("m"), F.var_pop("v").alias("s"), F.count("*").alias("n"))
        n = F.coalesce("n", F.lit(0))
        var = F.lit(self.fixed) if self.fixed is not None else F.coalesce("s", F.lit(0.0)) * n / (n - 1 + self.smooth) + self.smooth
        model = _grid(labels, parts).join(sums, ["run", "p"], "left").select("run", "p", F.coalesce("m", F.lit(0.0)).alias("mu"), var.alias("var"))
        return labels.select("run", "a").join(own, "a").join(F.broadcast(model), "run").select("run", "a", "p", ln_normal(F.col("v"), F.col("mu"), F.col("var"), self.smooth).alias("ll"))


@dataclass
class Items:
    """What a node holds (a, x STRING): each cluster's distribution, an item once per node, scored as often as held."""

    items: DataFrame

    def scores(self, labels: DataFrame, parts: int) -> DataFrame:
        counts = labels.join(self.items.distinct(), "a").groupBy("run", F.col("z").alias("p"), "x").agg(F.count("*").alias("n"))
        # what a cluster does not hold has EPS, so only its total is needed besides what it holds
        kinds = self.items.agg(F.count_distinct("x").alias("kinds"))
        total = _grid(labels, parts).join(counts.groupBy("run", "p").agg(F.sum("n").alias("s")), ["run", "p"], "left").join(F.broadcast(kinds)).select("run", "p", F.ln(F.coalesce("s", F.lit(0)) + F.col("kinds") * EPS).alias("total"))
        held = self.items.groupBy("a", "x").agg(F.count("*").alias("times"))
        per = held.groupBy("a").agg(F.sum("times").alias("times"))
        base = labels.select("run", "a").join(per, "a").join(F.broadcast(total), "run").select("run", "a", "p", (F.col("times") * (math.log(EPS) - F.col("total"))).alias("ll"))
        more = held.join(counts, "x").select("run", "a", "p", (F.col("times") * (F.ln(F.col("n") + EPS) - math.log(EPS))).alias("ll"))
        return base.unionByName(more).groupBy("run", "a", "p").agg(F.sum("ll").alias("ll"))


def _solved(edges: DataFrame, places: DataFrame, scores: DataFrame, parts: int, pull: float) -> DataFrame:
    """(run, a, z): the relaxed labelling of each group of components (``places``: a, bucket), a group and run at a time, each within its task."""
    rows = scores.groupBy("run", "a").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "ll"))), lambda x: x["ll"]).alias("ll")).join(places, "a")
    runs = scores.select("run").distinct()
    links = edges.join(places.select(F.col("a").alias("u"), "bucket"), "u").join(F.broadcast(runs)).select(F.col("run").alias("of_run"), F.col("bucket").alias("of_bucket"), "u", "v", "weight")  # a row per restart

    def solve(nodes: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        if not len(nodes):
            return pd.DataFrame({"run": [], "a": [], "z": []}).astype({"run": "int32", "a": "int64", "z": "int32"})
        nodes = nodes.sort_values("a")
        near = near.sort_values(["u", "v"])
        ids = nodes["a"].to_numpy()
        z = relaxed_labels(-np.stack(nodes["ll"].to_numpy()), np.searchsorted(ids, near["u"]), np.searchsorted(ids, near["v"]), near["weight"].to_numpy(float) * pull)
        return pd.DataFrame({"run": nodes["run"].astype("int32"), "a": ids, "z": z.astype(np.int32)})

    return rows.groupBy("run", "bucket").cogroup(links.groupBy("of_run", "of_bucket")).applyInPandas(solve, "run int, a long, z int")


def field_em(nodes: DataFrame, edges: DataFrame, factors: Sequence[Factor], parts: int, tau: float, restarts: int = 1, iterations: int = 30, least_change: float = 1e-3, seed: int = 0, start: DataFrame | None = None, ignore: DataFrame | None = None, task_edges: int = TASK_EDGES) -> DataFrame:
    """(a, cluster, ll): hard EM over nodes (a) and edges (u, v, weight) with any factors; the likeliest restart, the earlier of equals.

    All restarts run in one dataflow. The relaxation of an E-step falls apart into the connected components of the graph, which are solved side by side,
    many small ones a task; a component of more than ``task_edges`` edges is smoothed by :func:`smooth_labels`. M-step and likelihood are aggregates. It
    ends when no restart's likelihood moves by more than ``least_change``, or after ``iterations``. ``start`` (a, z) fixes the first labels; else they are a
    hash of node and run, and the first E-step goes without neighbours. ``ignore`` (u, v, weight) counts in the likelihood alone.
    """
    edges = checkpoint(edges.select("u", "v", F.col("weight").cast("double").alias("weight")))
    of = checkpoint(connected_components(edges, "u", "v")).withColumnRenamed("id", "a")
    sizes = checkpoint(edges.join(of.select(F.col("a").alias("u"), "component"), "u").groupBy("component").agg(F.count("*").alias("n")))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(8, -(-4 * total // task_edges))
    sized = nodes.select("a").distinct().join(of, "a", "left").join(sizes, "component", "left")
    placed = checkpoint(sized.select("a", (F.coalesce("n", F.lit(0)) > task_edges).alias("large"), F.pmod(F.xxhash64(F.coalesce("component", "a")), F.lit(buckets)).alias("bucket")))
    small, large = placed.where("not large").select("a", "bucket"), placed.where("large").select("a")
    split = not large.isEmpty()
    runs = nodes.sparkSession.range(restarts).select(F.col("id").cast("int").alias("run"))
    first = nodes.select("a").distinct().join(F.broadcast(runs))
    if start is None:
        labels = first.select("run", "a", F.floor(hashed_noise("a", "run", seed=seed) * parts).cast("int").alias("z"))
    else:
        labels = first.join(start, "a").select("run", "a", F.col("z").cast("int").alias("z"))
    labels, last = checkpoint(labels), None
    all_edges = edges if ignore is None else edges.unionByName(ignore.select("u", "v", F.col("weight").cast("double").alias("weight")))
    k = math.log(tau) - math.log(1 - tau)

    def scored(labels: DataFrame) -> DataFrame:
        out = factors[0].scores(labels, parts)
        for f in factors[1:]:
            out = out.unionByName(f.scores(labels, parts))
        return checkpoint(out.groupBy("run", "a", "p").agg(F.sum("ll").alias("ll")))

    def likelihood(labels: DataFrame, scores: DataFrame) -> dict[int, float]:
        own = labels.join(scores, ["run", "a"]).where("z = p").groupBy("run").agg(F.sum("ll").alias("ll"))
        a, b = labels.select("run", F.col("a").alias("u"), F.col("z").alias("zu")), labels.select("run", F.col("a").alias("v"), F.col("z").alias("zv"))
        pair = F.col("weight") * F.when(F.col("zu") == F.col("zv"), math.log(tau)).otherwise(math.log(1 - tau))
        linked = all_edges.join(a, "u").join(b, ["run", "v"]).groupBy("run").agg(F.sum(pair).alias("ll"))
        return {r.run: r.ll for r in own.unionByName(linked).groupBy("run").agg(F.sum("ll").alias("ll")).collect()}  # a row per restart

    scores = scored(labels)
    for i in range(iterations):
        pull = 0.0 if start is None and i == 0 else k
        new = _solved(edges, small, scores, parts, pull)
        if split:
            keep = lambda df: df.join(large, "a", "left_semi")
            own = keep(scores).groupBy("run", "a").agg(F.max_by("p", F.struct("ll", -F.col("p"))).alias("z"))
            new = new.unionByName((smooth_labels(keep(labels), keep(scores), edges, tau, 8, ["run"]) if pull else own).select("run", "a", F.col("z").cast("int").alias("z")))
        labels = checkpoint(new)
        scores = scored(labels)
        now = likelihood(labels, scores)
        for run, ll in sorted(now.items()):
            log.info("restart %d, iteration %d: log-likelihood %.6f, delta %s", run, i + 1, ll, None if last is None else ll - last[run])
        if last is not None and all(abs(now[r] - last[r]) <= least_change for r in now):
            last = now
            break
        last = now
    last = last or likelihood(labels, scores)
    best = min(last, key=lambda r: (-last[r], r)) if last else 0
    return labels.where(F.col("run") == best).select("a", F.col("z").alias("cluster"), F.lit(last.get(best)).cast("double").alias("ll"))


def older_hard_em(nodes: DataFrame, edges: DataFrame, parts: int = 5, restarts: int = 8, iterations: int = 5, tau: float = 0.5001, least_denom: int | None = LEAST_DENOM, flags: Sequence[str] = ("hlpful_fav_unfav", "isRealName"), value: str = "revLen", **how) -> DataFrame:
    """(a, cluster, ll) under the older model: prior, two flags and a number with estimated variance, over ``nodes`` (a, flags, value).

    Edges of fewer than ``least_denom`` count in the likelihood, not in the labelling. The oldest form has tau 0.8, one restart, up to 20 iterations
    and no such limit (None).
    """
    factors = [Prior(OLD_EPS), *[Flag(nodes, f) for f in flags], Number(nodes, value)]
    weak = edges.where(F.col("denom") < least_denom) if least_denom is not None else None
    strong = edges if least_denom is None else strong_edges(edges, least_denom)
    return field_em(nodes.select("a"), strong, factors, parts, tau, restarts, iterations, least_change=0.1, ignore=weak, **how)


def older_log_likelihood(nodes: pd.DataFrame, edges: Sequence[tuple[int, int, float]], z: Sequence[int], tau: float = 0.8, flags: Sequence[str] = ("hlpful_fav_unfav", "isRealName"), value: str = "revLen") -> tuple[float, dict]:
    """Log-likelihood of a labelling and its parameters under the older model: prior, two Bernoullis, a normal with estimated variance.

    ``nodes`` is indexed by id in the order of ``z``; small graphs only (it scores enumerated partitions).
    """
    z = np.asarray(z)
    n, total, parameters = len(z), 0.0, {}
    for p in np.unique(z):
        own = nodes[z == p]
        c = len(own)
        x = own[value].to_numpy(float)
        mu, var = x.mean(), ((x - x.mean()) ** 2).sum() / (c - 1 + OLD_EPS) + OLD_EPS
        rate = {f: own[f].sum() / (c + OLD_EPS) for f in flags}
        prior = math.log(c / (n + OLD_EPS) + OLD_EPS)
        parameters[int(p)] = {"log_prior": prior, "mu": float(mu), "sigma2": float(var)} | {f: float(r) for f, r in rate.items()}
        total += c * prior
        for f, r in rate.items():
            k = own[f].sum()
            total += k * math.log(r + OLD_EPS) + (c - k) * math.log(1 - r + OLD_EPS)
        total += float((-((x - mu) ** 2) / (2 * var + OLD_EPS) - (math.log(2 * math.pi) + math.log(var)) / 2).sum())
    at = {a: i for i, a in enumerate(nodes.index)}
    total += sum(w * math.log(tau if z[at[a]] == z[at[b]] else 1 - tau) for a, b, w in edges)
    return total, parameters


__all__ = ["Factor", "Flag", "Graph", "Items", "Number", "Prior", "field_em", "hard_em", "ln_normal", "older_hard_em", "run_restart"]
