"""Review of clusters: doubtful members are evicted, doubtful cluster pairs merged."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from canonry.functions.text import GROUP, r4, verdict_class
from canonry.operators.cluster import components
from canonry.operators.judge import rule_answer

CLUSTER = [*GROUP, "cluster_id"]


def profile(members: DataFrame, sims: DataFrame) -> DataFrame:
    """(attr, con, cluster_id, n, center, all_ave_sim, min_sim, ave_sim) of members (attr, con, cluster_id, value).

    The center has the largest sum of similarities to the others (of equal ones the first value), for two members the
    first value. A pair without a similarity has 0. A cluster of one has its value as center and null statistics.
    """
    m = members.select(*CLUSTER, "value").distinct()
    a, b = m.withColumnRenamed("value", "v1"), m.withColumnRenamed("value", "v2")
    pairs = a.join(b, CLUSTER).where("v1 < v2").join(sims.select(*GROUP, "v1", "v2", "sim"), [*GROUP, "v1", "v2"], "left").withColumn("sim", F.coalesce("sim", F.lit(0.0)))
    ends = pairs.select(*CLUSTER, F.explode(F.array(F.col("v1"), F.col("v2"))).alias("value"), "sim")
    # Sums of whole ten-thousandths do not depend on their order, so ties are ties.
    sums = ends.groupBy(*CLUSTER, "value").agg(F.sum(F.floor(F.col("sim") * 10000 + 0.5)).alias("s"), F.count("*").alias("k"))
    best = F.row_number().over(W.partitionBy(*CLUSTER).orderBy(F.desc("s"), F.asc("value")))
    center = sums.withColumn("r", best).where("r = 1").select(*CLUSTER, F.col("value").alias("center"), r4(F.col("s") / F.col("k") / 10000).alias("ave_sim"))
    stats = pairs.groupBy(*CLUSTER).agg(r4(F.sum(F.floor(F.col("sim") * 10000 + 0.5)) / F.count("*") / 10000).alias("all_ave_sim"), r4(F.min("sim")).alias("min_sim"))
    size = m.groupBy(*CLUSTER).agg(F.count("*").alias("n"), F.min("value").alias("first"))
    out = size.join(center, CLUSTER, "left").join(stats, CLUSTER, "left")
    return out.select(*CLUSTER, "n", F.coalesce("center", "first").alias("center"), "all_ave_sim", "min_sim", "ave_sim")


def center_pairs(profiles: DataFrame, sims: DataFrame) -> DataFrame:
    """(attr, con, c1, c2, v1, v2, sim): centers of every two clusters of a group; a missing similarity is 0."""
    p = profiles.select(*CLUSTER, "center")
    a = p.select(*GROUP, F.col("cluster_id").alias("c1"), F.col("center").alias("x"))
    b = p.select(*GROUP, F.col("cluster_id").alias("c2"), F.col("center").alias("y"))
    pairs = a.join(b, GROUP).where("c1 < c2").select(*GROUP, "c1", "c2", F.least("x", "y").alias("v1"), F.greatest("x", "y").alias("v2"))
    return pairs.join(sims.select(*GROUP, "v1", "v2", "sim"), [*GROUP, "v1", "v2"], "left").select(*GROUP, "c1", "c2", "v1", "v2", F.coalesce("sim", F.lit(0.0)).alias("sim"))


def group_stats(profiles: DataFrame, sims: DataFrame) -> DataFrame:
    """(attr, con, intra_ave_sim, intra_min, inter_ave_sim, inter_min_sim) of each group.

    Without a cluster of two the first is inter_ave_sim and intra_min is intra_ave_sim; with one cluster the inter
    figures are null.
    """
    whole = lambda c: F.sum(F.floor(F.col(c) * 10000 + 0.5)) / F.count(c) / 10000
    intra = profiles.groupBy(*GROUP).agg(r4(whole("ave_sim")).alias("a"), r4(F.min("min_sim")).alias("m"))
    inter = center_pairs(profiles, sims).groupBy(*GROUP).agg(r4(whole("sim")).alias("inter_ave_sim"), r4(F.min("sim")).alias("inter_min_sim"))
    both = intra.join(inter, GROUP, "left").withColumn("intra_ave_sim", F.coalesce("a", "inter_ave_sim"))
    return both.select(*GROUP, "intra_ave_sim", F.coalesce("m", "intra_ave_sim").alias("intra_min"), "inter_ave_sim", "inter_min_sim")


def intra_candidates(members: DataFrame, profiles: DataFrame, stats: DataFrame, sims: DataFrame) -> DataFrame:
    """(attr, con, cluster_id, value, center, sim): members less similar to the center than the group's or cluster's average."""
    m = members.select(*CLUSTER, "value").distinct().join(profiles.where("n > 1").select(*CLUSTER, "center", "ave_sim"), CLUSTER).where("value <> center").join(stats.select(*GROUP, "intra_ave_sim"), GROUP)
    m = m.withColumn("v1", F.least("value", "center")).withColumn("v2", F.greatest("value", "center"))
    m = m.join(sims.select(*GROUP, "v1", "v2", "sim"), [*GROUP, "v1", "v2"], "left").withColumn("sim", F.coalesce("sim", F.lit(0.0)))
    return m.where("sim < intra_ave_sim or sim < ave_sim").select(*CLUSTER, "value", "center", "sim")


def evicted(candidates: DataFrame, answer: Callable[[Column, Column], Column] = rule_answer) -> DataFrame:
    """Candidates judged no (or unknow): they leave their cluster."""
    return candidates.where(verdict_class(answer(F.least("value", "center"), F.greatest("value", "center"))) == "no").select(*CLUSTER, "value", "center", "sim")


THRESHOLDS = {"intra": "intra_ave_sim", "inter": "intra_min"}


def inter_candidates(profiles: DataFrame, out: DataFrame, stats: DataFrame, sims: DataFrame, mode: str = "intra") -> DataFrame:
    """(attr, con, id1, id2, v1, v2, sim): centers, and centers with evicted values, more similar than the threshold.

    An id is a cluster's number as text, or "v:" and the evicted value. mode: intra, inter, or mid (the middle of the
    group's similarities). The center of the last cluster is not compared with evicted values.
    """
    clusters = center_pairs(profiles, sims).select(*GROUP, F.col("c1").cast("string").alias("id1"), F.col("c2").cast("string").alias("id2"), "v1", "v2", "sim")
    last = F.max("cluster_id").over(W.partitionBy(*GROUP))
    p = profiles.select(*CLUSTER, "center").withColumn("last", last).where("cluster_id < last")
    e = p.join(out.select(*GROUP, "value").distinct(), GROUP).where("value <> center")
    e = e.select(*GROUP, F.col("cluster_id").cast("string").alias("id1"), F.concat(F.lit("v:"), "value").alias("id2"), F.least("value", "center").alias("v1"), F.greatest("value", "center").alias("v2"))
    e = e.join(sims.select(*GROUP, "v1", "v2", "sim"), [*GROUP, "v1", "v2"]).select(*GROUP, "id1", "id2", "v1", "v2", "sim")
    if mode == "mid":
        limit = sims.groupBy(*GROUP).agg(((F.min("sim") + F.max("sim")) / 2).alias("limit"))
    else:
        limit = stats.select(*GROUP, F.col(THRESHOLDS[mode]).alias("limit"))
    return clusters.unionByName(e).join(limit, GROUP).where("sim > limit").drop("limit")


def merged(members: DataFrame, out: DataFrame, yes: DataFrame, cannot: DataFrame | None = None) -> DataFrame:
    """(attr, con, value, cluster): clusters without evicted members, united along yes-links of (id1, id2).

    cluster is the smallest id in the union. With `cannot` (id1, id2), links are taken in order and one that would
    join two ids that cannot be together is skipped; a group's links are then one task.
    """
    stay = members.select(*CLUSTER, "value").distinct().join(out.select(*CLUSTER, "value"), [*CLUSTER, "value"], "left_anti").select(*GROUP, F.col("cluster_id").cast("string").alias("id"), "value")
    alone = out.select(*GROUP, F.concat(F.lit("v:"), "value").alias("id"), "value").distinct()
    nodes = stay.unionByName(alone)
    links = yes.select(*GROUP, F.col("id1").alias("v1"), F.col("id2").alias("v2"))
    comp = components(links) if cannot is None else _constrained(yes, cannot)
    return nodes.join(comp.withColumnRenamed("node", "id"), [*GROUP, "id"], "left").select(*GROUP, "value", F.coalesce("component", "id").alias("cluster")).distinct()


def _constrained(yes: DataFrame, cannot: DataFrame) -> DataFrame:
    both = yes.select(*GROUP, "id1", "id2", "sim", F.lit(True).alias("link")).unionByName(cannot.select(*GROUP, "id1", "id2", F.lit(0.0).alias("sim"), F.lit(False).alias("link")))

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        up: dict = {}
        apart: dict = {}

        def top(x):
            while up.setdefault(x, x) != x:
                x = up[x]
            return x

        for a, b in pdf.loc[~pdf["link"], ["id1", "id2"]].itertuples(index=False):
            apart.setdefault(a, set()).add(b)
            apart.setdefault(b, set()).add(a)
        own: dict = {}
        for a, b in pdf[pdf["link"]].sort_values(["sim", "id1", "id2"], ascending=[False, True, True])[["id1", "id2"]].itertuples(index=False):
            x, y = top(a), top(b)
            left, right = own.setdefault(x, {x}), own.setdefault(y, {y})
            if x != y and not any(apart.get(v, set()) & right for v in left):
                lo, hi = min(x, y), max(x, y)
                up[hi], own[lo] = lo, left | right
        return pd.DataFrame({"attr": pdf["attr"].iloc[0], "con": pdf["con"].iloc[0], "node": list(up), "component": [top(x) for x in up]})

    return both.groupBy(*GROUP).applyInPandas(apply, "attr string, con string, node string, component string")


def correct(members: DataFrame, sims: DataFrame, answer: Callable[[Column, Column], Column] = rule_answer, mode: str = "intra") -> DataFrame:
    """(attr, con, value, cluster): the whole review of members (attr, con, cluster_id, value)."""
    profiles = profile(members, sims)
    stats = group_stats(profiles, sims)
    out = evicted(intra_candidates(members, profiles, stats, sims), answer)
    pairs = inter_candidates(profiles, out, stats, sims, mode)
    yes = pairs.where(verdict_class(answer(F.col("v1"), F.col("v2"))) == "yes")
    return merged(members, out, yes)
