"""Mixture clustering of nodes by whom they link to, all random restarts in one dataflow."""

from __future__ import annotations

import math

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import checkpoint, passed_on
from .graph import without_isolated

#: Stands for the probability zero, so that its logarithm is finite.
TINY = 1e-300
#: Memory of a restart (8 bytes an edge, six arrays over nodes and clusters) up to which it is solved within one task.
TASK_BYTES = 400_000_000
#: Edges in a packed row.
PACKED = 1_000_000


def hashed_noise(*cols: Column, seed: int = 0) -> Column:
    """A repeatable number in [0, 1) per combination of values."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1_000_003)) / F.lit(1_000_003.0)


def initial_parameters(edges: DataFrame, clusters: int, runs: int = 1, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(run, r, pi) nearly uniform, and (run, r, j, theta) nearly uniform over the neighbours j, both with centred noise."""
    spark = edges.sparkSession
    grid = spark.range(runs).select(F.col("id").cast("int").alias("run")).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(clusters - 1))))
    raw = grid.withColumn("x", 1 / F.lit(clusters) + (hashed_noise("run", "r", seed=seed) - 0.5) / 20)
    pi = raw.select("run", "r", (F.col("x") / F.sum("x").over(W.partitionBy("run"))).alias("pi"))
    weight = edges.select("j").distinct().join(F.broadcast(grid)).withColumn("x", (1 + hashed_noise("run", "r", "j", seed=seed + 1)))  # grid is runs * clusters rows
    total = weight.groupBy("run", "r").agg(F.sum("x").alias("s"))
    return pi, weight.join(F.broadcast(total), ["run", "r"]).select("run", "r", "j", (F.col("x") / F.col("s")).alias("theta"))


def expectation(edges: DataFrame, pi: DataFrame, theta: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """(run, i, r, q): membership of each node, shifted by its largest exponent before exponentiation.

    ``extra`` (run, i, r, x) is added to the exponents.
    """
    linked = edges.join(theta, "j").groupBy("run", "i", "r").agg(F.sum(F.ln(F.greatest("theta", F.lit(TINY)))).alias("x"))
    logs = linked.join(F.broadcast(pi), ["run", "r"]).select("run", "i", "r", (F.col("x") + F.ln(F.greatest("pi", F.lit(TINY)))).alias("x"))
    if extra is not None:
        logs = logs.join(extra.withColumnRenamed("x", "more"), ["run", "i", "r"]).select("run", "i", "r", (F.col("x") + F.col("more")).alias("x"))
    node = W.partitionBy("run", "i")
    e = logs.withColumn("e", F.exp(F.col("x") - F.max("x").over(node)))
    return e.select("run", "i", "r", (F.col("e") / F.sum("e").over(node)).alias("q"))


def maximization(edges: DataFrame, q: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New (run, r, pi) and (run, r, j, theta)."""
    pi = q.groupBy("run", "r").agg(F.avg("q").alias("pi"))
    weight = edges.join(q, "i").groupBy("run", "r", "j").agg(F.sum("q").alias("x"))
    total = weight.groupBy("run", "r").agg(F.sum("x").alias("s"))
    return pi, weight.join(F.broadcast(total), ["run", "r"]).select("run", "r", "j", F.coalesce(F.try_divide("x", "s"), F.lit(0.0)).alias("theta"))


def assignments(q: DataFrame) -> DataFrame:
    """(run, i, g): the likeliest cluster, the lowest of equals."""
    return q.groupBy("run", "i").agg(F.max_by("r", F.struct("q", -F.col("r"))).alias("g"))


def log_likelihood(edges: DataFrame, pi: DataFrame, theta: DataFrame, g: DataFrame) -> DataFrame:
    """(run, ll) of the data with every node in its cluster."""
    own = g.join(F.broadcast(pi), [g.run == pi.run, g.g == pi.r]).groupBy(g.run).agg(F.sum(F.ln(F.greatest("pi", F.lit(TINY)))).alias("a"))
    t = theta.select(F.col("run").alias("trun"), F.col("r"), F.col("j").alias("tj"), "theta")
    linked = edges.join(g, "i").join(t, (F.col("run") == F.col("trun")) & (F.col("g") == F.col("r")) & (F.col("j") == F.col("tj")), "left")
    links = linked.groupBy("run").agg(F.sum(F.ln(F.greatest(F.coalesce("theta", F.lit(0.0)), F.lit(TINY)))).alias("b"))
    return own.join(links, "run").select("run", (F.col("a") + F.col("b")).alias("ll"))


def length_terms(lengths: DataFrame, q: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Weighted mean and variance of log review lengths per cluster, and the (run, i, r, x) they add to the exponents.

    ``lengths`` has i, n, s, ss: each node's number, sum and sum of squares of log lengths.
    """
    joined = lengths.join(q, "i")
    mu = joined.groupBy("run", "r").agg(F.try_divide(F.sum(F.col("q") * F.col("s")), F.sum(F.col("q") * F.col("n"))).alias("mu"))
    spread = F.col("ss") - 2 * F.col("mu") * F.col("s") + F.col("n") * F.col("mu") * F.col("mu")
    less = F.sum(F.col("q") * (F.col("n") - 1))
    var = joined.join(F.broadcast(mu), ["run", "r"]).groupBy("run", "r", "mu").agg((F.sum(F.col("q") * spread) / F.when(less == 0, 1.0).otherwise(less)).alias("sigma2"))
    added = lengths.join(F.broadcast(var)).select("run", "i", "r", (-spread / F.greatest("sigma2", F.lit(1e-12))).alias("x"))  # one row per run and cluster
    return var, added


# --- one restart, within a task ---


def run_restart(chunks: list[tuple[np.ndarray, np.ndarray]], n: int, pi: np.ndarray, theta: np.ndarray, iterations: int) -> tuple[float, np.ndarray]:
    """(log-likelihood, clusters of the ``n`` nodes i) after ``iterations`` steps from (r,) ``pi`` and (r, j) ``theta``; ``chunks`` are edges, as numbers (i, j)."""
    parts, m = theta.shape
    ln = lambda x: np.log(np.maximum(x, TINY))
    q = np.zeros((parts, n))
    for _ in range(iterations):
        logs = ln(theta)
        q[:] = ln(pi)[:, None]
        for i, j in chunks:
            for r in range(parts):
                q[r] += np.bincount(i, logs[r][j], n)
        q -= q.max(0)
        np.exp(q, out=q)
        q /= q.sum(0)
        pi, theta = q.mean(1), np.zeros((parts, m))
        for i, j in chunks:
            for r in range(parts):
                theta[r] += np.bincount(j, q[r][i], m)
        s = theta.sum(1, keepdims=True)
        theta /= np.where(s == 0, 1.0, s)
    g = q.argmax(0)
    logs = ln(theta)
    return float(ln(pi)[g].sum() + sum(logs[g[i], j].sum() for i, j in chunks)), g


def _numbered(ids: DataFrame, name: str, at: str) -> DataFrame:
    """(name, at): the distinct ids that are not null, numbered from 0 without gaps."""
    t = passed_on(ids.where(F.col(name).isNotNull()).distinct().withColumn(at, F.monotonically_increasing_id()))
    part, before, rows = F.shiftright(at, 33), 0, []
    for r in t.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():  # a row per partition
        rows.append((r.part, before))
        before += r.n
    starts = F.broadcast(ids.sparkSession.createDataFrame(rows, "part long, before long"))
    return t.withColumn("part", part).join(starts, "part").select(name, (F.col("before") + F.col(at).bitwiseAND((1 << 33) - 1)).alias(at))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []

    def row() -> pa.RecordBatch:
        both = np.concatenate(held, axis=1)
        held.clear()
        return pa.RecordBatch.from_pydict({"e": pa.array([both.tobytes()], pa.binary())})

    for b in batches:
        held.append(np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]).astype(np.int32))
        if sum(x.shape[1] for x in held) >= PACKED:
            yield row()
    if held:
        yield row()


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for g, ll in zip(b.column(0), b.column(1), strict=True):
            all_g = np.frombuffer(g.as_buffer(), np.int32)
            for k in range(0, len(all_g), 100_000):
                part = all_g[k : k + 100_000]
                yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(k, k + len(part))), "cluster": pa.array(part), "ll": pa.array(np.full(len(part), ll.as_py()))})


def _cluster_in_tasks(edges: DataFrame, left: DataFrame, right: DataFrame, n: int, m: int, clusters: int, iterations: int, runs: int, seed: int) -> DataFrame:
    """:func:`cluster` with a restart a task: the edges go to each as packed pairs of numbers, never through the driver."""
    spark = edges.sparkSession
    # a key for each restart that falls into a partition of its own
    keys = [r.k for r in spark.range(64 * runs).groupBy(F.pmod(F.hash("id"), F.lit(runs)).alias("s")).agg(F.min("id").alias("k")).orderBy("s").collect()]
    assert len(keys) == runs
    of = F.broadcast(spark.createDataFrame(list(zip(range(runs), keys, strict=True)), "run int, key long"))
    first = {(r.run, r.r): r.pi for r in initial_parameters(edges, clusters, runs, seed)[0].collect()}  # a row per restart and cluster
    packed = passed_on(edges.join(left, "i").join(right, "j").select("i_at", "j_at").mapInArrow(_packed, "e binary"))
    noise = [(1 + hashed_noise("run", F.lit(r), "j", seed=seed + 1)).alias(f"x{r}") for r in range(clusters)]
    starts = right.join(of).select("key", "run", "j_at", *noise)

    def solve(e: pa.Table, x: pa.Table) -> pa.Table:
        chunks = [np.frombuffer(v.as_buffer(), np.int32).reshape(2, -1) for c in e["e"].chunks for v in c]
        run, at = x["run"][0].as_py(), x["j_at"].to_numpy()
        theta = np.zeros((clusters, m))
        for r in range(clusters):
            theta[r, at] = x[f"x{r}"].to_numpy()
        theta /= theta.sum(1, keepdims=True)
        ll, g = run_restart([(c[0], c[1]) for c in chunks], n, np.array([first[run, r] for r in range(clusters)]), theta, iterations)
        return pa.table({"run": pa.array([run], pa.int32()), "ll": [ll], "g": pa.array([g.astype(np.int32).tobytes()], pa.binary())})

    each = packed.join(of.select(F.col("key").alias("to"))).repartition(runs, "to")  # a copy per restart
    found = passed_on(each.groupBy("to").cogroup(starts.repartition(runs, "key").groupBy("key")).applyInArrow(solve, "run int, ll double, g binary"))
    best = found.orderBy(F.desc("ll"), "run").limit(1).select("g", "ll").mapInArrow(_unpacked, "at long, cluster int, ll double")
    return left.join(best.withColumnRenamed("at", "i_at"), "i_at").select("i", "cluster", "ll")


def cluster(edges: DataFrame, clusters: int, iterations: int = 10, runs: int = 6, seed: int = 0, lengths: DataFrame | None = None) -> DataFrame:
    """(i, cluster, ll): the restart of the largest likelihood, the earlier of equals.

    ``edges`` has i (clustered) and j (linked to); an undirected graph is given in both directions. ``lengths`` adds log review
    lengths to the exponents, but not to the likelihood that picks the restart. Edges without both ends are left out. A restart is solved
    within one task where the size of the graph is checked to allow, else all restarts in one dataflow.
    """
    edges = passed_on(edges.select("i", "j").where("i is not null and j is not null"))
    if lengths is None:
        left, right = _numbered(edges.select("i"), "i", "i_at"), _numbered(edges.select("j"), "j", "j_at")
        n, m = left.count(), right.count()
        if 8 * edges.count() + 48 * clusters * (n + m) <= TASK_BYTES and n and iterations:
            return _cluster_in_tasks(edges, left, right, n, m, clusters, iterations, runs, seed)
    pi, theta = initial_parameters(edges, clusters, runs, seed)
    q, extra = None, None
    if lengths is not None:
        spark = edges.sparkSession
        grid = spark.range(runs).select(F.col("id").cast("int").alias("run")).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(clusters - 1))))
        extra = lengths.join(F.broadcast(grid)).select("run", "i", "r", (-F.col("ss")).alias("x"))  # mean 0, variance 1
    for _ in range(iterations):
        q = checkpoint(expectation(edges, pi, theta, extra))
        pi, theta = maximization(edges, q)
        theta = checkpoint(theta)
        if lengths is not None:
            extra = checkpoint(length_terms(lengths, q)[1])
    g = assignments(q)
    best = log_likelihood(edges, pi, theta, g).orderBy(F.desc("ll"), "run").limit(1)
    return g.join(F.broadcast(best), "run").select("i", F.col("g").alias("cluster"), "ll")


def cluster_bipartite(edges: DataFrame, left: int, right: int, iterations: int = 10, runs: int = 6, seed: int = 0) -> DataFrame:
    """(part, id, cluster): each side clustered by its links to the other; the right side's clusters count on from the left's."""
    edges = passed_on(edges.select("u", "v"))  # read for either side
    a = cluster(edges.select(F.col("u").alias("i"), F.col("v").alias("j")), left, iterations, runs, seed).select(F.lit(1).alias("part"), F.col("i").alias("id"), "cluster")
    b = cluster(edges.select(F.col("v").alias("i"), F.col("u").alias("j")), right, iterations, runs, seed).select(F.lit(2).alias("part"), F.col("i").alias("id"), (F.col("cluster") + left).alias("cluster"))
    return a.unionByName(b)


def cluster_nodes(nodes: DataFrame, edges: DataFrame, clusters: int, **how) -> DataFrame:
    """``nodes`` (id, ...) with the cluster of an undirected graph's nodes; null for nodes without edges."""
    both = edges.select(F.col("u").alias("i"), F.col("v").alias("j")).unionByName(edges.select(F.col("v").alias("i"), F.col("u").alias("j")))
    kept = without_isolated(nodes, edges, ["u", "v"])
    found = cluster(both, clusters, **how).select(F.col("i").alias("id"), "cluster")
    return nodes.join(found.join(kept.select("id"), "id", "left_semi"), "id", "left")


def rand_index(df: DataFrame, a: str, b: str) -> DataFrame:
    """Share of pairs on which two labellings agree, from the table of their counts (no pairs are formed)."""
    choose = lambda n: n * (n - 1) / 2
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    both = cells.agg(F.sum(choose(F.col("n"))).alias("both"), F.sum("n").alias("total"))
    one = lambda c, out: cells.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(choose(F.col("n"))).alias(out))
    joined = both.join(one(a, "in_a")).join(one(b, "in_b"))  # one row each
    pairs = choose(F.col("total"))
    return joined.select(F.try_divide(pairs + 2 * F.col("both") - F.col("in_a") - F.col("in_b"), pairs).alias("rand"))


def ln_normal(x: Column, mu: Column, var: Column, eps: float = 0.0) -> Column:
    return -((x - mu) ** 2) / (2 * var + eps) - (math.log(2 * math.pi) + F.ln(var)) / 2
