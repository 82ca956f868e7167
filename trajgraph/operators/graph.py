"""Graph metrics of all graphs of an edge table at once.

A graph has nodes 1..n, isolated ones included; its edges are the rows (keys, i <= j, w), self-loops among them. Counting metrics are
joins and groupings by (keys, node, ...). Metrics of paths and of powers take one task a graph, as a matrix, up to DENSE_NODES nodes
(32 MB); larger graphs, or graphs of unknown size, go by rounds of joins.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajgraph.functions.tables import kept
from trajgraph.operators.compare import dense, guarded

DENSE_NODES = 2000


class Matrix:
    """One graph as its full symmetric matrix; what several metrics share is computed once."""

    def __init__(self, a: np.ndarray):
        self.a, self.n = a, len(a)

    @cached_property
    def hops(self) -> np.ndarray:
        return hops(self.a)

    @cached_property
    def own(self) -> np.ndarray:
        return largest(self.a, self.hops)

    @cached_property
    def components(self) -> np.ndarray:
        """Sizes of all components."""
        joined = np.isfinite(self.hops)
        return np.bincount(joined.argmax(1), minlength=self.n)

    @cached_property
    def parts(self) -> np.ndarray:
        return greedy_parts(self.a)

    def edges(self) -> int:
        return int(np.count_nonzero(np.triu(self.a)))

    def degrees(self, weighted: bool) -> np.ndarray:
        """Strengths or degrees; a self-loop counts twice."""
        a = self.a if weighted else (self.a != 0).astype(float)
        return a.sum(1) + np.diag(a)

    def clustering(self) -> float:
        c = np.cbrt(self.a / self.a.max()) if self.a.any() else self.a.copy()
        np.fill_diagonal(c, 0.0)
        d = (c != 0).sum(1)
        return float((np.einsum("ij,ji->i", c @ c, c) / np.maximum(d * (d - 1), 1)).sum() / self.n)

    def assortativity(self) -> float:
        s, (i, j) = self.degrees(True), np.nonzero(self.a)
        x, y = s[i], s[j]
        if len(x) < 2 or any(v.var() * len(v) <= 1e-12 * (v * v).sum() for v in (x, y)):
            return np.nan
        return float(np.corrcoef(x, y)[0, 1])

    def path_length(self) -> float:
        d = lengths(np.divide(1.0, self.own, out=np.zeros_like(self.own), where=self.own != 0))
        return d.sum() / (len(d) * (len(d) - 1)) if len(d) > 1 else np.nan

    def global_efficiency(self) -> float:
        return spread(self.hops)

    def local_efficiency(self) -> float:
        return sum(spread(hops(self.a[np.ix_(r != 0, r != 0)])) for r in self.a) / self.n

    def betweenness(self) -> float:
        k = len(self.own)
        return inner_nodes(self.own) / (k * (k - 1) * (k - 2)) if k > 2 else np.nan

    def eigenvector(self, rounds: int = 1000, tolerance: float = 1e-6) -> float:
        x = np.full(len(self.own), 1 / np.sqrt(max(1, len(self.own))))
        for _ in range(rounds if len(self.own) > 2 else 0):
            y = x + self.own @ x
            y /= np.linalg.norm(y)
            if np.abs(y - x).sum() < tolerance:
                return float(y.mean())
            x = y
        return np.nan

    def modularity(self) -> float:
        m, k = np.triu(self.a).sum(), np.bincount(self.parts, self.degrees(True))
        inside = np.bincount(self.parts, (np.triu(self.a) * (self.parts[:, None] == self.parts)).sum(1), len(k))
        return float((inside / m - (k / (2 * m)) ** 2).sum()) if m else np.nan


#: Metrics of a graph that fits one task, by tier.
TIERS: dict[str, dict[str, Callable[[Matrix], float]]] = {
    "basic": {
        "num_nodes": lambda g: g.n, "num_edges": Matrix.edges, "density": lambda g: 2 * g.edges() / (g.n * (g.n - 1)), "n_components": lambda g: np.count_nonzero(g.components), "largest": lambda g: g.components.max(),
        "average_clustering": Matrix.clustering, "degree_assortativity": Matrix.assortativity,
    },
    "advanced": {"average_path_length": Matrix.path_length, "global_efficiency": Matrix.global_efficiency, "local_efficiency": Matrix.local_efficiency},
    "centrality": {"average_degree_centrality": lambda g: g.degrees(False).sum() / (g.n - 1) / g.n, "average_betweenness": Matrix.betweenness, "average_eigenvector_centrality": Matrix.eigenvector},
    "community": {"modularity": Matrix.modularity, "num_communities": lambda g: len(np.unique(g.parts))},
}


def by_graph(e: DataFrame, keys: list[str], n: int, names: list[str]) -> DataFrame:
    """(keys, names): metrics of each graph from its full symmetric matrix, all from one pass with one graph a group; nan is null."""
    measure = {name: f for tier in TIERS.values() for name, f in tier.items() if name in names}

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        g = Matrix(dense(pdf, n))
        return pd.DataFrame({c: [pdf[c].iloc[0]] for c in keys} | {m: np.array([measure[m](g)], dtype=float) for m in names})

    shape = T.StructType([*[e.schema[c] for c in keys], *[T.StructField(m, T.DoubleType()) for m in names]])
    out = e.select(*keys, "i", "j", "w").groupBy(*keys).applyInPandas(work, shape)
    return out.withColumns({m: F.when(~F.isnan(m), F.col(m)) for m in names})


def hops(a: np.ndarray) -> np.ndarray:
    """Least number of edges between any two nodes, inf where there is no path."""
    near = a != 0
    d = np.where(np.eye(len(a), dtype=bool), 0.0, np.inf)
    front, k = near & np.isinf(d), 1
    while front.any():
        d[front] = k
        front, k = (front.astype(np.float32) @ near.astype(np.float32) > 0) & np.isinf(d), k + 1
    return d


def lengths(a: np.ndarray) -> np.ndarray:
    """Least sums of edge lengths between any two nodes; a is 0 where there is no edge."""
    d = np.where(a != 0, a, np.inf)
    np.fill_diagonal(d, 0.0)
    for k in range(len(d)):
        np.minimum(d, d[:, k : k + 1] + d[k : k + 1], out=d)
    return d


def largest(a: np.ndarray, apart: np.ndarray | None = None) -> np.ndarray:
    """The matrix of the largest component of nodes with an edge (of equal ones that of the smallest node); apart: hops of a, if known."""
    joined = np.isfinite(hops(a) if apart is None else apart) & ((a != 0).any(0)[:, None])
    own = joined[int(joined.sum(1).argmax())]
    return a[np.ix_(own, own)]


def spread(apart: np.ndarray) -> float:
    """Mean of 1 / hops over ordered pairs."""
    d = apart[~np.eye(len(apart), dtype=bool)]
    return float((1 / d).sum() / len(d)) if len(d) else 0.0


def greedy_parts(a: np.ndarray) -> np.ndarray:
    """The community of each node by greedy merging: the two joined communities whose merger raises modularity most become one (of
    equal gains those of the smallest numbers), as long as the gain isn't negative. A community has the number of its smallest node.

    Gains wait in a heap; a community that was merged since is known by its version, and its old gains are passed over. A pair's gain
    is w / m - 2 a b, with the weight w between the two, the total weight m, and their shares a, b of all ends of edges; it changes
    only with one of the two.
    """
    m = np.triu(a).sum()
    part = np.arange(len(a))
    if not m > 0:
        return part
    share = (a.sum(1) + np.diag(a)) / (2 * m)
    near = [{int(k): float(r[k]) for k in np.flatnonzero(r) if k != i} for i, r in enumerate(a)]
    version, heap = [0] * len(a), []

    def offer(u: int, v: int) -> None:
        u, v = min(u, v), max(u, v)
        heapq.heappush(heap, (2 * share[u] * share[v] - near[u][v] / m, u, v, version[u], version[v]))

    for u, links in enumerate(near):
        for v in links:
            if u < v:
                offer(u, v)
    while heap:
        loss, u, v, at_u, at_v = heapq.heappop(heap)
        if (at_u, at_v) != (version[u], version[v]):
            continue
        if loss > 0:
            break
        for k, w in near[v].items():
            del near[k][v]
            if k != u:
                near[u][k] = near[k][u] = near[u].get(k, 0.0) + w
        near[v] = {}
        share[u] += share[v]
        part[part == v] = u
        version[u] += 1
        version[v] = -1
        for k in near[u]:
            offer(u, k)
    return part


def inner_nodes(a: np.ndarray) -> float:
    """Sum over ordered pairs of the mean number of nodes inside their shortest paths, with a as edge lengths."""
    d, n, total = lengths(a), len(a), 0.0
    for s in range(n):
        paths, inner = np.zeros(n), np.zeros(n)
        paths[s] = 1.0
        for t in np.argsort(d[s], kind="stable"):
            if t == s or not np.isfinite(d[s, t]):
                continue
            ends = (a[:, t] != 0) & (np.arange(n) != t) & (np.abs(d[s] + a[:, t] - d[s, t]) <= 1e-9 * np.abs(d[s, t]))
            paths[t] = paths[ends].sum()
            inner[t] = inner[ends].sum() + paths[ends & (np.arange(n) != s)].sum()
            total += inner[t] / paths[t]
    return total


def both_ways(e: DataFrame, keys: list[str], w: str | Column = "w") -> DataFrame:
    """(keys, s, t, w): each edge from both ends; a self-loop once."""
    w = F.col(w) if isinstance(w, str) else w
    ends = F.array(F.struct(F.col("i").alias("s"), F.col("j").alias("t")), F.struct(F.col("j").alias("s"), F.col("i").alias("t")))
    return e.select(*keys, w.alias("w"), F.explode(F.when(F.col("i") == F.col("j"), F.slice(ends, 1, 1)).otherwise(ends)).alias("x")).select(*keys, "x.s", "x.t", "w")


def size_and_density(e: DataFrame, keys: list[str], n: int) -> DataFrame:
    m = F.count(F.lit(1))
    return e.groupBy(*keys).agg(F.lit(n).alias("num_nodes"), m.alias("num_edges"), (2 * m / (n * (n - 1))).alias("density"))


def component_labels(e: DataFrame, keys: list[str], rounds: int = 200) -> DataFrame:
    """(keys, node, label): the smallest node of its component, for every node with an edge.

    Each round takes the least label of the neighbours and then the label of that label, so paths halve.
    """
    links = kept(both_ways(e, keys).select(*keys, "s", "t").distinct())
    labels = kept(links.groupBy(*keys, F.col("s").alias("node")).agg(F.least(F.min("t"), F.first("s")).alias("label")))
    for _ in range(rounds):
        near = links.join(labels.select(*keys, F.col("node").alias("t"), "label"), [*keys, "t"]).groupBy(*keys, F.col("s").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, [*keys, "node"]).select(*keys, "node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(*keys, F.col("node").alias("label"), F.col("label").alias("jumped"))
        after = kept(step.join(jump, [*keys, "label"], "left").select(*keys, "node", "old", F.least("label", F.coalesce("jumped", "label")).alias("label")))
        labels = after.drop("old")
        if after.where(F.col("old") != F.col("label")).limit(1).count() == 0:
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def components(e: DataFrame, keys: list[str], n: int) -> DataFrame:
    """(keys, n_components, largest); isolated nodes are components of one."""
    sizes = component_labels(e, keys).groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("k"))
    s = sizes.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"), F.sum("k").alias("seen"), F.max("k").alias("largest"))
    return s.select(*keys, (F.col("c") + n - F.col("seen")).alias("n_components"), "largest")


def largest_component(e: DataFrame, keys: list[str]) -> DataFrame:
    """The edges of each graph's largest component (of equal ones that of the smallest node)."""
    labels = kept(component_labels(e, keys))
    sizes = labels.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("k"))
    best = sizes.groupBy(*keys).agg(F.max_by("label", F.struct("k", -F.col("label"))).alias("label"))
    nodes = labels.join(best, [*keys, "label"], "left_semi").select(*keys, F.col("node").alias("i"))
    return e.join(nodes, [*keys, "i"], "left_semi")


def average_clustering(e: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Mean over all nodes of the geometric mean weight of their triangles (weights to the largest), by degree without loops."""
    top = e.groupBy(*keys).agg(F.max("w").alias("top"))
    s = e.where(F.col("i") != F.col("j")).join(top, keys).select(*keys, "i", "j", (F.col("w") / F.col("top")).alias("w"))
    ab = s.select(*keys, F.col("i").alias("a"), F.col("j").alias("b"), F.col("w").alias("w1"))
    ac = s.select(*keys, F.col("i").alias("a"), F.col("j").alias("c"), F.col("w").alias("w2"))
    bc = s.select(*keys, F.col("i").alias("b"), F.col("j").alias("c"), F.col("w").alias("w3"))
    tri = ab.join(ac, [*keys, "a"]).where(F.col("b") < F.col("c")).join(bc, [*keys, "b", "c"])
    tri = tri.select(*keys, F.cbrt(F.col("w1") * F.col("w2") * F.col("w3")).alias("g"), F.explode(F.array("a", "b", "c")).alias("node"))
    per = tri.groupBy(*keys, "node").agg(F.sum("g").alias("g"))
    degree = both_ways(s, keys).groupBy(*keys, F.col("s").alias("node")).agg(F.count(F.lit(1)).alias("d"))
    c = per.join(degree, [*keys, "node"]).groupBy(*keys).agg((F.sum(2 * F.col("g") / (F.col("d") * (F.col("d") - 1))) / n).alias("c"))
    return e.select(*keys).distinct().join(c, keys, "left").select(*keys, F.coalesce("c", F.lit(0.0)).alias("average_clustering"))


def reciprocal(e: DataFrame) -> DataFrame:
    return e.withColumn("w", F.try_divide(F.lit(1.0), F.col("w"))).where(F.col("w").isNotNull())


def distances(arcs: DataFrame, keys: list[str], rounds: int = 40) -> DataFrame:
    """(keys, s, t, d) of all s != t that are joined: paths double in every round until none gets shorter."""
    d = kept(arcs.where(F.col("s") != F.col("t")).groupBy(*keys, "s", "t").agg(F.min("w").alias("d")))
    for _ in range(rounds):
        left = d.select(*keys, "s", F.col("t").alias("v"), F.col("d").alias("d1"))
        right = d.select(*keys, F.col("s").alias("v"), "t", F.col("d").alias("d2"))
        longer = left.join(right, [*keys, "v"]).where(F.col("s") != F.col("t")).select(*keys, "s", "t", (F.col("d1") + F.col("d2")).alias("d"), F.lit(1).alias("new"))
        best = longer.union(d.select("*", F.lit(0).alias("new"))).groupBy(*keys, "s", "t").agg(F.min("d").alias("d"), F.min(F.when(F.col("new") == 0, F.col("d"))).alias("old"))
        best = kept(best)
        d = best.drop("old")
        if best.where(F.col("old").isNull() | (F.col("d") < F.col("old"))).limit(1).count() == 0:
            return d
    raise RuntimeError(f"paths got shorter after {rounds} rounds of doubling")


def average_path_length(e: DataFrame, keys: list[str], n: int | None = None) -> DataFrame:
    """Mean shortest path over ordered pairs of the largest component, with 1/w as length; null for a single node."""
    if n is not None and n <= DENSE_NODES:
        return by_graph(e, keys, n, ["average_path_length"])
    d = distances(both_ways(reciprocal(largest_component(e, keys)), keys), keys)
    out = d.groupBy(*keys).agg(F.avg("d").alias("average_path_length"))
    return e.select(*keys).distinct().join(out, keys, "left")


def global_efficiency(e: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Mean of 1 / hops over ordered pairs of all nodes; pairs that aren't joined add 0."""
    if n <= DENSE_NODES:
        return by_graph(e, keys, n, ["global_efficiency"])
    d = distances(both_ways(e, keys, F.lit(1.0)), keys)
    s = d.groupBy(*keys).agg((F.sum(1 / F.col("d")) / (n * (n - 1))).alias("g"))
    return e.select(*keys).distinct().join(s, keys, "left").select(*keys, F.coalesce("g", F.lit(0.0)).alias("global_efficiency"))


def local_efficiency(e: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Mean over all nodes of the global efficiency among their neighbours (a self-loop makes a node its own neighbour)."""
    if n <= DENSE_NODES:
        return by_graph(e, keys, n, ["local_efficiency"])
    near = both_ways(e, keys).select(*keys, F.col("s").alias("ego"), F.col("t").alias("node"))
    own = e.join(near.withColumnRenamed("node", "i"), [*keys, "i"]).join(near.withColumnRenamed("node", "j"), [*keys, "ego", "j"]).select(*keys, "ego", "i", "j")
    d = distances(both_ways(own.withColumn("w", F.lit(1.0)), [*keys, "ego"]), [*keys, "ego"])
    size = near.groupBy(*keys, "ego").agg(F.count(F.lit(1)).alias("k"))
    per = d.groupBy(*keys, "ego").agg(F.sum(1 / F.col("d")).alias("s")).join(size, [*keys, "ego"])
    s = per.groupBy(*keys).agg((F.sum(F.col("s") / (F.col("k") * (F.col("k") - 1))) / n).alias("g"))
    return e.select(*keys).distinct().join(s, keys, "left").select(*keys, F.coalesce("g", F.lit(0.0)).alias("local_efficiency"))


def strengths(e: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, strength, degree); a self-loop counts twice."""
    m = F.when(F.col("s") == F.col("t"), 2).otherwise(1)
    return both_ways(e, keys).groupBy(*keys, F.col("s").alias("node")).agg(F.sum(m * F.col("w")).alias("strength"), F.sum(m).alias("degree"))


def degree_assortativity(e: DataFrame, keys: list[str]) -> DataFrame:
    """Pearson's r of the strengths at both ends of the directed edges; null where they don't vary."""
    k = strengths(e, keys)
    ends = both_ways(e, keys).join(k.select(*keys, F.col("node").alias("s"), F.col("strength").alias("x")), [*keys, "s"]).join(k.select(*keys, F.col("node").alias("t"), F.col("strength").alias("y")), [*keys, "t"])
    x, y = F.col("x"), F.col("y")
    s = ends.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"))
    return s.select(*keys, guarded(*[F.col(c) for c in ("k", "sx", "sy", "sxx", "syy", "sxy")]).alias("degree_assortativity"))


def average_degree_centrality(e: DataFrame, keys: list[str], n: int) -> DataFrame:
    return strengths(e, keys).groupBy(*keys).agg((F.sum("degree") / (n - 1) / n).alias("average_degree_centrality"))


def average_eigenvector_centrality(e: DataFrame, keys: list[str], n: int | None = None, rounds: int = 1000, tolerance: float = 1e-6) -> DataFrame:
    """Mean of the unit eigenvector by power iteration of A + I over the largest component; null for up to two nodes, and if it
    doesn't settle in so many rounds."""
    if n is not None and n <= DENSE_NODES:
        return by_graph(e, keys, n, ["average_eigenvector_centrality"])
    own = largest_component(e, keys)
    arcs = kept(both_ways(own, keys))
    x = arcs.select(*keys, F.col("s").alias("node")).distinct()
    size = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"))
    x = kept(x.join(size, keys).where(F.col("k") > 2).select(*keys, "node", "k", (1 / F.sqrt("k")).alias("x")))
    for _ in range(rounds):
        pushed = arcs.join(x.select(*keys, F.col("node").alias("t"), "x"), [*keys, "t"]).groupBy(*keys, F.col("s").alias("node")).agg(F.sum(F.col("w") * F.col("x")).alias("p"))
        y = x.join(pushed, [*keys, "node"]).withColumn("y", F.col("x") + F.col("p"))
        norm = y.groupBy(*keys).agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("norm"))
        y = kept(y.join(norm, keys).select(*keys, "node", "k", "x", (F.col("y") / F.col("norm")).alias("y")))
        moved = y.groupBy(*keys).agg(F.sum(F.abs(F.col("y") - F.col("x"))).alias("moved")).where(F.col("moved") >= tolerance).limit(1).count()
        x = y.select(*keys, "node", "k", F.col("y").alias("x"))
        if not moved:
            break
    else:
        x = x.limit(0)
    return e.select(*keys).distinct().join(x.groupBy(*keys).agg(F.avg("x").alias("average_eigenvector_centrality")), keys, "left")


def average_betweenness(e: DataFrame, keys: list[str], n: int | None = None) -> DataFrame:
    """Mean normalised betweenness over the largest component, with the weight as distance; null for up to two nodes.

    The mean needs only the mean number of nodes inside the shortest paths of each pair: paths are counted by their number of
    edges, along edges that are tight.
    """
    if n is not None and n <= DENSE_NODES:
        return by_graph(e, keys, n, ["average_betweenness"])
    own = kept(largest_component(e, keys))
    arcs = both_ways(own, keys).where(F.col("s") != F.col("t"))
    d = distances(arcs, keys)
    size = both_ways(own, keys).groupBy(*keys).agg(F.countDistinct("s").alias("k"))
    last = arcs.select(*keys, F.col("s").alias("v"), "t", "w")
    equal = lambda a, b: F.abs(a - b) <= 1e-9 * F.greatest(F.abs(a), F.abs(b))
    front = kept(arcs.join(d, [*keys, "s", "t"]).where(equal(F.col("w"), F.col("d"))).select(*keys, "s", "t", F.lit(1.0).alias("paths")))
    counted = front.select(*keys, "s", "t", "paths", F.lit(0).alias("inner"))
    inner = 0
    while front.limit(1).count():
        inner += 1
        so_far = front.select(*keys, "s", F.col("t").alias("v"), "paths").join(d.select(*keys, "s", F.col("t").alias("v"), F.col("d").alias("dv")), [*keys, "s", "v"])
        step = so_far.join(last, [*keys, "v"]).where(F.col("s") != F.col("t")).join(d, [*keys, "s", "t"]).where(equal(F.col("dv") + F.col("w"), F.col("d")))
        front = kept(step.groupBy(*keys, "s", "t").agg(F.sum("paths").alias("paths")))
        counted = counted.union(front.select(*keys, "s", "t", "paths", F.lit(inner).alias("inner")))
    per = counted.groupBy(*keys, "s", "t").agg((F.sum(F.col("paths") * F.col("inner")) / F.sum("paths")).alias("inside"))
    s = per.groupBy(*keys).agg(F.sum("inside").alias("inside")).join(size, keys).where(F.col("k") > 2)
    mean = F.col("inside") / (F.col("k") * (F.col("k") - 1) * (F.col("k") - 2))
    return e.select(*keys).distinct().join(s.select(*keys, mean.alias("average_betweenness")), keys, "left")


def modularity(e: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, modularity, num_communities) of a partition (keys, node, part) of all nodes with an edge."""
    m = e.groupBy(*keys).agg(F.sum("w").alias("m"))
    a = parts.select(*keys, F.col("node").alias("i"), F.col("part").alias("pi"))
    b = parts.select(*keys, F.col("node").alias("j"), F.col("part").alias("pj"))
    inside = e.join(a, [*keys, "i"]).join(b, [*keys, "j"]).where(F.col("pi") == F.col("pj")).groupBy(*keys, F.col("pi").alias("part")).agg(F.sum("w").alias("l"))
    degree = strengths(e, keys).join(parts, [*keys, "node"]).groupBy(*keys, "part").agg(F.sum("strength").alias("k"))
    q = degree.join(inside, [*keys, "part"], "left").join(m, keys)
    share = F.col("k") / (2 * F.col("m"))
    return q.groupBy(*keys).agg(F.sum(F.coalesce("l", F.lit(0.0)) / F.col("m") - share * share).alias("modularity"), F.count(F.lit(1)).alias("num_communities"))


def label_communities(e: DataFrame, keys: list[str], rounds: int = 8) -> DataFrame:
    """(keys, node, part) by label propagation: each node takes the label of most weight among its neighbours and its own (the least
    of equals), a fixed number of rounds."""
    return propagated_labels(e, keys, rounds)[0]


def propagated_labels(e: DataFrame, keys: list[str], rounds: int = 8) -> tuple[DataFrame, DataFrame]:
    """label_communities, and (keys, settled): whether no label of a graph changed in the last round (labels may swap for ever)."""
    arcs = kept(both_ways(e, keys))
    labels = kept(arcs.select(*keys, F.col("s").alias("node")).distinct().withColumn("part", F.col("node")))
    for _ in range(rounds):
        votes = arcs.join(labels.select(*keys, F.col("node").alias("t"), "part"), [*keys, "t"]).groupBy(*keys, F.col("s").alias("node"), "part").agg(F.sum("w").alias("v"))
        best = votes.groupBy(*keys, "node").agg(F.max_by("part", F.struct(F.round("v", 9), -F.col("part"))).alias("part"))
        last, labels = labels, kept(best)
    same = labels.join(last.withColumnRenamed("part", "before"), [*keys, "node"]).groupBy(*keys).agg(F.min(F.col("part") == F.col("before")).alias("settled"))
    return labels, same


def greedy_communities(e: DataFrame, keys: list[str], n: int) -> DataFrame:
    """(keys, node, part) of all nodes 1..n: greedy_parts up to DENSE_NODES nodes, moved_communities beyond; part is a node of it."""
    if n > DENSE_NODES:
        alone = e.select(*keys).distinct().withColumn("node", F.explode(F.sequence(F.lit(1), F.lit(n))))
        return alone.join(moved_communities(e, keys), [*keys, "node"], "left").select(*keys, "node", F.coalesce("part", "node").alias("part"))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({c: [pdf[c].iloc[0]] * n for c in keys} | {"node": np.arange(1, n + 1), "part": greedy_parts(dense(pdf, n)) + 1})

    shape = T.StructType([*[e.schema[c] for c in keys], T.StructField("node", T.IntegerType()), T.StructField("part", T.IntegerType())])
    return e.select(*keys, "i", "j", "w").groupBy(*keys).applyInPandas(work, shape)


def community_score(e: DataFrame, keys: list[str], n: int) -> DataFrame:
    """(keys, modularity, num_communities) of the greedy communities; isolated nodes are communities of one."""
    if n <= DENSE_NODES:
        return by_graph(e, keys, n, list(TIERS["community"]))
    parts = kept(greedy_communities(e, keys, n))
    number = parts.groupBy(*keys).agg(F.countDistinct("part").cast("double").alias("num_communities"))
    return modularity(e, parts, keys).drop("num_communities").join(number, keys)


def moved_communities(e: DataFrame, keys: list[str], rounds: int = 20, levels: int = 20, least: float = 1e-9) -> DataFrame:
    """(keys, node, part) of the nodes with an edge, by local moving in rounds of joins, for graphs that fit no task.

    In a round half of the nodes (by a hash of node and round, so that neighbours don't swap for ever) move to the neighbouring
    community that raises modularity most; a graph keeps a round only if its modularity rose by `least`. When no graph gains any more,
    communities become nodes of a smaller graph and the rounds go on there, until a level merges nothing.
    """
    graph = kept(e.groupBy(*keys, "i", "j").agg(F.sum("w").alias("w")))
    total = kept(graph.groupBy(*keys).agg(F.sum("w").alias("m")))
    of = None
    for _ in range(levels):
        arcs, own = kept(both_ways(graph, keys)), kept(strengths(graph, keys).select(*keys, "node", "strength"))
        labels = kept(own.select(*keys, "node", F.col("node").alias("part")))
        score = kept(modularity(graph, labels, keys).select(*keys, F.col("modularity").alias("q")))
        merged = False
        for k in range(rounds):
            placed = labels.join(own, [*keys, "node"])
            size = placed.groupBy(*keys, "part").agg(F.sum("strength").alias("size"))
            votes = arcs.where(F.col("s") != F.col("t")).join(labels.select(*keys, F.col("node").alias("t"), "part"), [*keys, "t"]).groupBy(*keys, F.col("s").alias("node"), "part").agg(F.sum("w").alias("v"))
            stay = placed.select(*keys, "node", "part", F.lit(0.0).alias("v"))
            options = votes.unionByName(stay).groupBy(*keys, "node", "part").agg(F.sum("v").alias("v"))
            options = options.join(placed.withColumnRenamed("part", "at"), [*keys, "node"]).join(size, [*keys, "part"]).join(total, keys)
            others = F.col("size") - F.when(F.col("part") == F.col("at"), F.col("strength")).otherwise(0.0)
            gain = F.round(F.col("v") / F.col("m") - F.col("strength") * others / (2 * F.col("m") * F.col("m")), 12)
            best = options.groupBy(*keys, "node").agg(F.max_by("part", F.struct(gain, (F.col("part") == F.col("at")), -F.col("part"))).alias("to"), F.first("at").alias("at"))
            turn = F.pmod(F.xxhash64("node", F.lit(k)), F.lit(2)) == 0
            moved = kept(best.select(*keys, "node", F.when(turn, F.col("to")).otherwise(F.col("at")).alias("part")))
            after = modularity(graph, moved, keys).select(*keys, F.col("modularity").alias("new")).join(score, keys).withColumn("better", F.col("new") > F.col("q") + least)
            after = kept(after)
            if after.where("better").limit(1).count():
                labels = kept(moved.join(after, keys).join(labels.withColumnRenamed("part", "old"), [*keys, "node"]).select(*keys, "node", F.when(F.col("better"), F.col("part")).otherwise(F.col("old")).alias("part")))
                score = kept(after.select(*keys, F.greatest("q", "new").alias("q")))
                merged = True
            elif k % 2:
                break
        of = labels if of is None else kept(of.withColumnRenamed("part", "node_").join(labels.withColumnRenamed("node", "node_"), [*keys, "node_"]).select(*keys, "node", "part"))
        if not merged:
            break
        a, b = (labels.select(*keys, F.col("node").alias(x), F.col("part").alias(f"p{x}")) for x in "ij")
        joined = graph.join(a, [*keys, "i"]).join(b, [*keys, "j"])
        graph = kept(joined.groupBy(*keys, F.least("pi", "pj").alias("i"), F.greatest("pi", "pj").alias("j")).agg(F.sum("w").alias("w")))
    return of


def graph_metrics(e: DataFrame, keys: list[str], n: int, tiers: tuple[str, ...] = ("basic",)) -> DataFrame:
    """(keys, metric, value) in long form. Tiers: basic, advanced, centrality, community; what can't be computed is null.

    Up to DENSE_NODES nodes all metrics of a graph come from one pass over its matrix; beyond it each metric has its joins.
    """
    if n <= DENSE_NODES:
        names = [m for tier in tiers for m in TIERS[tier]]
        return by_graph(e, keys, n, names).unpivot(keys, names, "metric", "value")
    parts = {
        "basic": [lambda: size_and_density(e, keys, n), lambda: components(e, keys, n), lambda: average_clustering(e, keys, n), lambda: degree_assortativity(e, keys)],
        "advanced": [lambda: average_path_length(e, keys, n), lambda: global_efficiency(e, keys, n), lambda: local_efficiency(e, keys, n)],
        "centrality": [lambda: average_degree_centrality(e, keys, n), lambda: average_betweenness(e, keys, n), lambda: average_eigenvector_centrality(e, keys, n)],
        "community": [lambda: community_score(e, keys, n)],
    }
    out = None
    for tier in tiers:
        for make in parts[tier]:
            df = make()
            values = [c for c in df.columns if c not in keys]
            long_ = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in values]).unpivot(keys, values, "metric", "value")
            out = long_ if out is None else out.unionByName(long_)
    return out
