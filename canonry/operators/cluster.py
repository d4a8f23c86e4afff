"""Clusters of a group's values."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from canonry.functions.text import GROUP
from canonry.operators.components import connected_components
from canonry.operators.dense import near_links
from canonry.plans.scratch import cut

#: Groups with more links than this go through distributed rounds, not through one task.
ONE_TASK_LINKS = 200_000


def components(edges: DataFrame, keys: list[str] | None = None, one_task: int = ONE_TASK_LINKS) -> DataFrame:
    """(*keys, node, component) of edges (*keys, v1, v2); groups of a checked size take one task each."""
    keys = GROUP if keys is None else keys
    most = edges.groupBy(*keys).count().agg(F.max("count")).first()[0]
    if (most or 0) > one_task:
        return connected_components(edges, "v1", "v2", keys)

    def union(pdf: pd.DataFrame) -> pd.DataFrame:
        up: dict = {}

        def top(x):
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            return x

        for a, b in zip(pdf["v1"], pdf["v2"]):
            a, b = top(a), top(b)
            if a != b:
                up[max(a, b)] = min(a, b)
        nodes = list(up)
        out = pd.DataFrame({"node": nodes, "component": [top(x) for x in nodes]})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "node", "component"]]

    types = dict(edges.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), f"node {types['v1']}", f"component {types['v1']}"])
    return edges.select(*keys, "v1", "v2").groupBy(*keys).applyInPandas(union, schema)


def with_singles(values: DataFrame, comp: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(*keys, value, cluster): every value, alone in its cluster if it is in no component."""
    keys = GROUP if keys is None else keys
    v = values.select(*keys, "value").distinct()
    return v.join(comp.withColumnRenamed("node", "value"), [*keys, "value"], "left").select(*keys, "value", F.coalesce("component", "value").alias("cluster"))


def hac_single_link(values: DataFrame, sims: DataFrame, threshold: float) -> DataFrame:
    """Single-link agglomeration down to a threshold: the components of links at or above it. At 0 or below a group is one cluster."""
    if threshold <= 0:
        return values.select(*GROUP, "value").distinct().withColumn("cluster", F.min("value").over(W.partitionBy(*GROUP)))
    return with_singles(values, components(sims.where(F.col("sim") >= threshold)))


def dbscan(values: DataFrame, distances: DataFrame, eps: float = 0.5) -> DataFrame:
    """DBSCAN with two points as the least: components of distances up to eps; all points without a neighbour are one cluster, null."""
    comp = components(distances.where(F.col("dist") <= eps)).withColumnRenamed("node", "value")
    return values.select(*GROUP, "value").distinct().join(comp, [*GROUP, "value"], "left").select(*GROUP, "value", F.col("component").alias("cluster"))


def dbscan_vectors(embeddings: DataFrame, eps: float = 0.5) -> DataFrame:
    """dbscan() of (attr, con, value, embedding) by Euclidean distance, without writing out the pairs."""
    links = cut(near_links(embeddings, eps), "near-links")
    return dbscan(embeddings, links.withColumn("dist", F.lit(0.0)), eps)


def modularity(edges: DataFrame, clusters: DataFrame, gamma: float = 1.0) -> DataFrame:
    """(attr, con, modularity) of clusters (attr, con, value, cluster) over weighted links."""
    c = clusters.select(*GROUP, "value", "cluster")
    e = edges.join(c.select(*GROUP, F.col("value").alias("v1"), F.col("cluster").alias("c1")), [*GROUP, "v1"]).join(c.select(*GROUP, F.col("value").alias("v2"), F.col("cluster").alias("c2")), [*GROUP, "v2"])
    ends = e.select(*GROUP, F.explode(F.array(F.struct(F.col("c1").alias("c"), F.col("sim"), F.when(F.col("c1") == F.col("c2"), F.col("sim")).otherwise(0.0).alias("inner")), F.struct(F.col("c2").alias("c"), F.col("sim"), F.lit(0.0).alias("inner")))).alias("x"))
    per = ends.groupBy(*GROUP, "x.c").agg(F.sum("x.sim").alias("d"), F.sum("x.inner").alias("l"))
    m = edges.groupBy(*GROUP).agg(F.sum("sim").alias("m"))
    return per.join(m, GROUP).where("m > 0").groupBy(*GROUP).agg(F.sum(F.col("l") / F.col("m") - gamma * (F.col("d") / (2 * F.col("m"))) ** 2).alias("modularity"))


def _louvain(pdf: pd.DataFrame, gamma: float) -> dict:
    """Node to community by greedy local moves and contraction, nodes in ascending order."""
    graph: dict = {}
    for a, b, w in zip(pdf["v1"], pdf["v2"], pdf["sim"]):
        if a != b and w > 0:
            graph.setdefault(a, {})[b] = graph.setdefault(a, {}).get(b, 0.0) + w
            graph.setdefault(b, {})[a] = graph.setdefault(b, {}).get(a, 0.0) + w
    place = {v: v for v in graph}
    m2 = sum(sum(x.values()) for x in graph.values())
    while m2:
        com = {v: v for v in graph}
        deg = {v: sum(x.values()) for v, x in graph.items()}
        tot, moved, any_move = dict(deg), True, False
        while moved:
            moved = False
            for v in sorted(graph):
                near: dict = {}
                for u, w in graph[v].items():
                    if u != v:
                        near[com[u]] = near.get(com[u], 0.0) + w
                old = com[v]
                tot[old] -= deg[v]
                best, gain = old, near.get(old, 0.0) - gamma * tot[old] * deg[v] / m2
                for c in sorted(near):
                    g = near[c] - gamma * tot[c] * deg[v] / m2
                    if g > gain + 1e-12:
                        best, gain = c, g
                tot[best] += deg[v]
                if best != old:
                    com[v], moved, any_move = best, True, True
        if not any_move:
            break
        place = {v: com[c] for v, c in place.items()}
        small: dict = {}
        for v, x in graph.items():
            own = small.setdefault(com[v], {})
            for u, w in x.items():
                own[com[u]] = own.get(com[u], 0.0) + w
        graph = small
    return place


def louvain(values: DataFrame, sims: DataFrame, threshold: float = 0.0, resolution: float = 0.8) -> DataFrame:
    """(attr, con, value, cluster) by Louvain; a group is one task. resolution is a time: larger gives larger communities."""
    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        place = _louvain(pdf, 1 / resolution)
        low: dict = {}
        for v, c in place.items():
            low[c] = min(low.get(c, v), v)
        out = pd.DataFrame({"node": list(place), "component": [low[c] for c in place.values()]})
        out.insert(0, "con", pdf["con"].iloc[0])
        out.insert(0, "attr", pdf["attr"].iloc[0])
        return out

    found = sims.where(F.col("sim") >= threshold).groupBy(*GROUP).applyInPandas(apply, "attr string, con string, node string, component string")
    return with_singles(values, found)


def elbow(inertias: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, k): after the largest change of (*keys, k, inertia) from k to k + 1, the first of equal ones."""
    w = W.partitionBy(*keys).orderBy("k")
    d = inertias.withColumn("d", F.lead("inertia").over(w) - F.col("inertia")).where("d is not null")
    return d.groupBy(*keys).agg(F.max_by(F.when(F.col("d") < 0, F.col("k") + 1).otherwise(F.col("k")), F.struct(F.abs("d").alias("a"), (-F.col("k")).alias("b"))).alias("k"))


def _seeds(x: np.ndarray, seed: int) -> np.ndarray:
    """All points in an order whose first k are far apart: each next one is farthest from those before, ties by place."""
    x2 = (x**2).sum(axis=1)
    order = [int(np.random.default_rng(seed).integers(len(x)))]
    far = np.full(len(x), np.inf)
    while True:
        last = order[-1]
        apart = x2 + x2[last] - 2 * (x @ x[last])
        (rows,) = np.nonzero(~(apart - 1e-12 * (x2 + x2[last]) > far))  # the rest are no nearer, even with rounding
        far[rows] = np.minimum(far[rows], ((x[rows] - x[last]) ** 2).sum(axis=1))
        far[last] = -1
        if len(order) == len(x):
            return np.array(order)
        order.append(int(far.argmax()))


#: Distances that are laid out at a time.
BLOCK = 1 << 17


def _nearest(x: np.ndarray, x2: np.ndarray, rows: np.ndarray, centers: np.ndarray, c2: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared distance, center) of the nearest of some centers to each of some rows, the first of equal ones; x2 and c2 are the squared lengths."""
    step = max(16, BLOCK // max(1, len(among)))
    whole = len(rows) == len(x) or (len(rows) > len(x) / 2 and len(among) <= 16)  # sooner than taking rows out
    n = len(x) if whole else len(rows)
    apart, at, room = np.empty(n), np.empty(n, np.int64), np.empty((min(n, step), len(among)))
    turned, lengths = -2 * centers[among].T, c2[among]
    for k in range(0, n, step):
        part = x[k : k + step] if whole else x[rows[k : k + step]]
        d = np.matmul(part, turned, out=room[: len(part)])
        d += lengths
        i = d.argmin(axis=1)
        apart[k : k + step], at[k : k + step] = d[np.arange(len(part)), i], i
    if n > len(rows):
        apart, at = apart[rows], at[rows]
    apart += x2[rows]
    apart[apart < 1e-13 * x2[rows]] = 0  # equal but for rounding
    return apart, among[at]


def _sums(x: np.ndarray, of: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of the rows of x by `of`, each number below len(size) in it, size[i] times."""
    rows, end = x[np.argsort(of, kind="stable")], np.cumsum(size)
    if len(rows) < 8 * len(size):
        return np.add.reduceat(rows, end - size, axis=0)
    return np.array([rows[e - n : e].sum(axis=0) for n, e in zip(size.tolist(), end.tolist())])


def _from(x: np.ndarray, rows: np.ndarray, centers: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Squared distances of some rows from their own centers."""
    out = np.empty(len(rows))
    for k in range(0, len(rows), 1024):
        some = rows[k : k + 1024]
        d = x[some] - centers[own[some]]
        out[k : k + 1024] = np.einsum("ij,ij->i", d, d)
    return out


class Start:
    """The first round from the first k seeds, for ascending k: `own` and `apart` tell of the nearest seed to each point,
    `centers` are these clusters' means, `then` and `gap` tell of the nearest of them.

    From k to k only the means of clusters that lost points are new, so points are compared with these, and with all if
    their own mean has moved away.
    """

    def __init__(self, x: np.ndarray, order: np.ndarray):
        self.x, self.order, self.k = x, order, 0
        self.x2 = (x**2).sum(axis=1)
        self.own, self.apart = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
        self.then, self.gap = self.own.copy(), self.apart.copy()
        self.centers, self.c2 = x[order], self.x2[order]

    def upto(self, k: int) -> None:
        x, seeds, new = self.x, self.order[:k], np.arange(self.k, k)
        apart, own = _nearest(x, self.x2, np.arange(len(x)), x[seeds], self.x2[seeds], new)
        nearer = apart < self.apart
        fresh = np.zeros(k, bool)
        fresh[self.own[nearer]] = True
        fresh[new] = True
        self.own[nearer], self.apart[nearer], self.k = own[nearer], apart[nearer], k
        self.apart[seeds[self.own[seeds] == np.arange(k)]] = 0
        self._means(fresh)

    def _means(self, fresh: np.ndarray) -> None:
        """The means of some clusters anew, and the nearest mean to each point; a point alone is its own seed."""
        x, k, centers = self.x, self.k, self.centers
        size = np.bincount(self.own, minlength=k)
        (at,) = np.nonzero(fresh)
        centers[at] = x[self.order[at]]
        (some,) = np.nonzero(fresh & (size > 1))
        if len(some):
            place = np.full(k, -1)
            place[some] = np.arange(len(some))
            (members,) = np.nonzero(place[self.own] >= 0)
            centers[some] = _sums(x[members], place[self.own[members]], size[some]) / size[some, None]
        self.c2[at] = (centers[at] ** 2).sum(axis=1)
        now = self.gap.copy()
        (rows,) = np.nonzero(fresh[self.then] & (now < np.inf))
        now[rows] = _from(x, rows, centers, self.then)
        away = now > self.gap
        (rows,) = np.nonzero(~away & (now > 0))
        d, c = _nearest(x, self.x2, rows, centers, self.c2, at)
        nearer = d < now[rows]
        self.then[rows[nearer]], now[rows[nearer]] = c[nearer], d[nearer]
        (rows,) = np.nonzero(away)
        now[rows], self.then[rows] = _nearest(x, self.x2, rows, centers, self.c2, np.arange(k))
        self.gap = now


def _lloyd(start: Start, rounds: int = 20) -> tuple[np.ndarray, float]:
    """(cluster of each point, inertia) by Lloyd's rounds from the first start.k seeds; a cluster that loses all points keeps its center.

    The first round is start's. A round compares a point with the centers that moved; with all only if its own moved
    away from it, as else no other can have become nearer. A point that is its own center stays.
    """
    x, x2, k = start.x, start.x2, start.k
    centers, c2, own, every = start.centers[:k].copy(), start.c2[:k].copy(), start.own, np.arange(k)
    new, now = start.then, start.gap
    if rounds == 1 or not (centers != x[start.order[:k]]).any():
        new = own
    for r in range(1, rounds):
        (other,) = np.nonzero(new != own)
        if not len(other):
            break
        changed = np.zeros(k, bool)
        changed[own[other]] = changed[new[other]] = True
        own, apart = new, now
        size = np.bincount(own, minlength=k)
        (at,) = np.nonzero(changed & (size > 0))
        place = np.full(k, -1)
        place[at] = np.arange(len(at))
        (members,) = np.nonzero(place[own] >= 0)
        sums = _sums(x[members], place[own[members]], size[at]) / size[at, None]
        differs = (sums != centers[at]).any(axis=1)
        moved = at[differs]
        centers[moved] = sums[differs]
        if r == rounds - 1 or not len(moved):
            break
        c2[moved] = (centers[moved] ** 2).sum(axis=1)
        is_moved = np.zeros(k, bool)
        is_moved[moved] = True
        now = apart.copy()
        (rows,) = np.nonzero(is_moved[own])
        now[rows] = _from(x, rows, centers, own)
        away = now > apart
        new = own.copy()
        (rows,) = np.nonzero(~away & (now > 0))
        d, c = _nearest(x, x2, rows, centers, c2, moved)
        nearer = (d < now[rows]) & (c != own[rows])
        new[rows[nearer]], now[rows[nearer]] = c[nearer], d[nearer]
        (rows,) = np.nonzero(away)
        now[rows], new[rows] = _nearest(x, x2, rows, centers, c2, every)
    return own.copy(), float(_from(x, np.arange(len(x)), centers, own).sum())


@contextmanager
def _blocks_kept() -> Iterator[None]:
    """Meanwhile freed blocks of up to 32 MB stay with the process, which else asks the system for each large array anew."""
    libc = ctypes.CDLL(None)
    if not hasattr(libc, "mallopt"):
        yield
        return
    libc.mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD
    try:
        yield
    finally:
        libc.mallopt(-3, 128 << 10)
        libc.malloc_trim(0)


def kmeans_elbow(embeddings: DataFrame, largest: int | None = None, seed: int = 42, most_values: int = 20_000) -> DataFrame:
    """(value, cluster) of one group of (value, embedding) by KMeans with the k of the elbow, of all k up to the number of values or to `largest`.

    The fits of all k are spread over the cluster, a task takes runs of neighbouring k, as each fit's first round follows
    from that of the k before. A group is held whole by every task, as one fit needs all of it, so one of more than
    most_values values is refused rather than cut.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select("value", F.col("embedding").cast("array<double>").alias("e")).orderBy("value").limit(most_values + 1).collect()
    n = len(rows)
    if n > most_values:
        raise ValueError(f"the group has more than {most_values} values")
    x = np.array([r.e for r in rows], np.float64).reshape(n, -1)
    label = np.zeros(n, np.int64)
    if n >= 3:
        sent = spark.sparkContext.broadcast((x, order := _seeds(x, seed)))
        most = min(largest or n, n)
        longest, runs = max(1, -(-most // max(64, 4 * spark.sparkContext.defaultParallelism))), [1]
        while runs[-1] <= most:  # small k take longest
            runs.append(min(most + 1, runs[-1] + min(longest, max(1, runs[-1] // 16))))
        tasks = min(len(runs) - 1, max(8, 4 * spark.sparkContext.defaultParallelism))

        def fits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for first in b.column(0).to_pylist():
                    costs = {}
                    with _blocks_kept():
                        for i in range(first, len(runs) - 1, tasks):
                            start = Start(*sent.value)
                            for k in range(runs[i], runs[i + 1]):
                                start.upto(k)
                                costs[k] = _lloyd(start)[1]
                    yield pa.RecordBatch.from_pydict({"k": pa.array(list(costs), pa.int32()), "inertia": pa.array(list(costs.values()), pa.float64())})

        costs = spark.range(0, tasks, 1, tasks).mapInArrow(fits, "k int, inertia double").withColumn("g", F.lit(1))
        start = Start(x, order)
        start.upto(elbow(costs, ["g"]).first()["k"])
        label = _lloyd(start)[0]
    return spark.createDataFrame([(r.value, int(c)) for r, c in zip(rows, label)], "value string, cluster int")


def star_clusters(values: DataFrame, yes: DataFrame) -> DataFrame:
    """(attr, con, cluster, value): each value with the later ones judged the same, singles for values in no such pair; they overlap."""
    stars = yes.select(*GROUP, F.col("v1").alias("cluster"), F.explode(F.array("v1", "v2")).alias("value")).distinct()
    return stars.unionByName(unclustered(values, stars).select(*GROUP, F.col("value").alias("cluster"), "value"))


def pair_clusters(values: DataFrame, yes: DataFrame) -> DataFrame:
    """(attr, con, v1, v2): each pair judged the same is a cluster; a single has v2 null."""
    used = yes.select(*GROUP, F.explode(F.array("v1", "v2")).alias("value"))
    return yes.select(*GROUP, "v1", "v2").distinct().unionByName(unclustered(values, used).select(*GROUP, F.col("value").alias("v1"), F.lit(None).cast("string").alias("v2")))


def unclustered(values: DataFrame, clustered: DataFrame) -> DataFrame:
    return values.select(*GROUP, "value").distinct().join(clustered.select(*GROUP, "value").distinct(), [*GROUP, "value"], "left_anti")
