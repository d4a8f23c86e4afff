"""Metrics of predicted clusters against gold clusters, a row a group.

gold: (attr, con, cluster_name, value, kind) with kind cluster, single or error; pred: (attr, con, cluster_id, value).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from canonry.functions.text import GROUP, r4
from canonry.operators.cluster import components


def overlap(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(attr, con, cluster_name, cluster_id, n): values common to a gold and a predicted cluster."""
    g = gold.where("kind <> 'error'").select(*GROUP, "cluster_name", "value").distinct()
    return g.join(pred.select(*GROUP, "cluster_id", "value").distinct(), [*GROUP, "value"]).groupBy(*GROUP, "cluster_name", "cluster_id").agg(F.count("*").alias("n"))


def labels(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(attr, con, value, y_true, y_pred): ranks of the clusters, gold ones by size; overlapping clusters share a label."""
    def side(rows: DataFrame, key: str, out: str) -> DataFrame:
        r = rows.select(*GROUP, F.col(key).cast("string").alias("c"), "value").distinct()
        a, b = r.select(*GROUP, "value", F.col("c").alias("v1")), r.select(*GROUP, "value", F.col("c").alias("v2"))
        same = components(a.join(b, [*GROUP, "value"]).where("v1 < v2").select(*GROUP, "v1", "v2").distinct()).withColumnRenamed("node", "c")
        one = r.join(same, [*GROUP, "c"], "left").select(*GROUP, "value", F.coalesce("component", "c").alias("c")).distinct()
        size = one.groupBy(*GROUP, "c").agg(F.count("*").alias("n"))
        rank = size.withColumn(out, F.row_number().over(W.partitionBy(*GROUP).orderBy(F.desc("n"), F.asc("c"))) - 1)
        return one.join(rank.select(*GROUP, "c", out), [*GROUP, "c"]).select(*GROUP, "value", out)

    g = side(gold.where("kind <> 'error'"), "cluster_name", "y_true")
    return g.join(side(pred, "cluster_id", "y_pred"), [*GROUP, "value"])


def contingency(labelled: DataFrame) -> DataFrame:
    """(attr, con, y_true, y_pred, n, a, b, total) with the marginals."""
    n = labelled.groupBy(*GROUP, "y_true", "y_pred").agg(F.count("*").alias("n"))
    over = lambda *k: F.sum("n").over(W.partitionBy(*GROUP, *k))
    return n.withColumn("a", over("y_true")).withColumn("b", over("y_pred")).withColumn("total", over())


def _sums(labelled: DataFrame) -> DataFrame:
    """Sums over the contingency table; marginals count once by weighting cells with n / a and n / b."""
    t = contingency(labelled)
    n, a, b, N = (F.col(x).cast("double") for x in ("n", "a", "b", "total"))
    return t.groupBy(*GROUP).agg(
        F.max("total").cast("double").alias("N"),
        F.sum(n * n).alias("nn"), F.sum(n * a).alias("aa"), F.sum(n * b).alias("bb"),
        F.sum(-n / N * F.ln(a / N)).alias("ht"), F.sum(-n / N * F.ln(b / N)).alias("hp"),
        F.sum(-n / N * F.ln(n / b)).alias("ht_p"), F.sum(-n / N * F.ln(n / a)).alias("hp_t"),
        F.sum(n / N * F.ln(n * N / (a * b))).alias("mi"),
    )


def fmi(labelled: DataFrame) -> DataFrame:
    s = _sums(labelled)
    tp, p, q = F.col("nn") - F.col("N"), F.col("bb") - F.col("N"), F.col("aa") - F.col("N")
    return s.select(*GROUP, F.when((p > 0) & (q > 0), r4(tp / F.sqrt(p * q))).otherwise(F.lit(0.0)).alias("fmi"))


def vmeasure(labelled: DataFrame) -> DataFrame:
    s = _sums(labelled)
    h = F.when(F.col("ht") > 1e-12, 1 - F.col("ht_p") / F.col("ht")).otherwise(1.0)
    c = F.when(F.col("hp") > 1e-12, 1 - F.col("hp_t") / F.col("hp")).otherwise(1.0)
    return s.select(*GROUP, r4(h + 1e-9).alias("homogeneity"), r4(c + 1e-9).alias("completeness"), F.when(h + c > 1e-12, r4(2 * h * c / (h + c) + 1e-9)).otherwise(0.0).alias("v_measure"))


def ari(labelled: DataFrame) -> DataFrame:
    s = _sums(labelled)
    pairs = lambda x: (F.col(x) - F.col("N")) / 2
    every = F.col("N") * (F.col("N") - 1) / 2
    expected = pairs("aa") * pairs("bb") / every
    most = (pairs("aa") + pairs("bb")) / 2
    return s.select(*GROUP, F.when((every > 0) & (F.abs(most - expected) > 1e-12), r4((pairs("nn") - expected) / (most - expected) + 1e-9)).otherwise(1.0).alias("ari"))


def nmi(labelled: DataFrame) -> DataFrame:
    both = (F.col("ht") + F.col("hp")) / 2
    return _sums(labelled).select(*GROUP, F.when(both > 1e-12, r4(F.col("mi") / both + 1e-9)).otherwise(1.0).alias("nmi"))


def accuracy(labelled: DataFrame) -> DataFrame:
    """Equal labels as they are: only of use when labels align."""
    return labelled.groupBy(*GROUP).agg(r4(F.avg((F.col("y_true") == F.col("y_pred")).cast("double"))).alias("acc"))


def purity(labelled: DataFrame, true_ids_only: bool = False) -> DataFrame:
    """Share of values in the largest gold part of their cluster. true_ids_only leaves out predicted labels that no gold label has."""
    t = contingency(labelled)
    if true_ids_only:
        t = t.join(labelled.select(*GROUP, F.col("y_true").alias("y_pred")).distinct(), [*GROUP, "y_pred"], "left_semi")
    best = t.groupBy(*GROUP, "y_pred").agg(F.max("n").alias("n"), F.max("total").alias("total"))
    return best.groupBy(*GROUP).agg(r4(F.sum("n") / F.max("total")).alias("purity"))


def averages(metric: DataFrame, name: str, sizes: DataFrame) -> DataFrame:
    """Over groups: plain mean and mean weighted by sizes (attr, con, n)."""
    return metric.join(sizes, GROUP).agg(r4(F.avg(name)).alias("macro"), r4(F.sum(F.col(name) * F.col("n")) / F.sum("n")).alias("weighted"))


def _f1(p, r):
    return F.when(p + r > 0, r4(2 * p * r / (p + r))).otherwise(0.0)


def _prf(rows: DataFrame, prefix: str, right_p, of_p, right_r, of_r) -> DataFrame:
    div = lambda a, b: F.when(b > 0, r4(a / b)).otherwise(0.0)
    out = rows.select(*GROUP, div(right_p, of_p).alias("p"), div(right_r, of_r).alias("r"))
    return out.select(*GROUP, F.col("p").alias(f"{prefix}_p"), F.col("r").alias(f"{prefix}_r"), _f1(F.col("p"), F.col("r")).alias(f"{prefix}_f1"))


def _cluster_counts(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """A row a group: clusters of both sides, contained and identical ones, best overlaps, distinct gold values."""
    g = gold.where("kind <> 'error'").select(*GROUP, "cluster_name", "value").distinct()
    p = pred.select(*GROUP, "cluster_id", "value").distinct()
    gs = g.groupBy(*GROUP, "cluster_name").agg(F.count("*").alias("gn"))
    ps = p.groupBy(*GROUP, "cluster_id").agg(F.count("*").alias("pn"))
    o = overlap(gold, pred).join(gs, [*GROUP, "cluster_name"]).join(ps, [*GROUP, "cluster_id"])
    by_p = o.groupBy(*GROUP, "cluster_id").agg(F.max((F.col("n") == F.col("pn")).cast("int")).alias("in_gold"), F.max(((F.col("n") == F.col("pn")) & (F.col("n") == F.col("gn"))).cast("int")).alias("same"), F.max("n").alias("best"))
    by_g = o.groupBy(*GROUP, "cluster_name").agg(F.max((F.col("n") == F.col("gn")).cast("int")).alias("in_pred"), F.max(((F.col("n") == F.col("pn")) & (F.col("n") == F.col("gn"))).cast("int")).alias("same"), F.max("n").alias("best"))
    parts = [
        gs.groupBy(*GROUP).agg(F.count("*").alias("n_gold")),
        ps.groupBy(*GROUP).agg(F.count("*").alias("n_pred")),
        g.groupBy(*GROUP).agg(F.countDistinct("value").alias("n_values")),
        by_p.groupBy(*GROUP).agg(F.sum("in_gold").alias("p_in"), F.sum("same").alias("p_same"), F.sum("best").alias("p_best")),
        by_g.groupBy(*GROUP).agg(F.sum("in_pred").alias("g_in"), F.sum("same").alias("g_same"), F.sum("best").alias("g_best")),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.join(x, GROUP, "left")
    return out.na.fill(0)


def macro_f1(gold: DataFrame, pred: DataFrame) -> DataFrame:
    c = F.col
    return _prf(_cluster_counts(gold, pred), "macro", c("p_in"), c("n_pred"), c("g_in"), c("n_gold"))


def micro_f1(gold: DataFrame, pred: DataFrame) -> DataFrame:
    c = F.col
    return _prf(_cluster_counts(gold, pred), "micro", c("p_best"), c("n_values"), c("g_best"), c("n_values"))


def exact_f1(gold: DataFrame, pred: DataFrame) -> DataFrame:
    c = F.col
    return _prf(_cluster_counts(gold, pred), "exact", c("p_same"), c("n_pred"), c("g_same"), c("n_gold"))


def pair_counts(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(attr, con, tp, n_pred, n_gold): distinct pairs of values in one cluster; gold pairs of kind cluster only."""
    def pairs(rows: DataFrame, key: str) -> DataFrame:
        r = rows.select(*GROUP, key, "value").distinct()
        return r.withColumnRenamed("value", "v1").join(r.withColumnRenamed("value", "v2"), [*GROUP, key]).where("v1 < v2").select(*GROUP, "v1", "v2").distinct()

    g, p = pairs(gold.where("kind = 'cluster'"), "cluster_name").withColumn("g", F.lit(1)), pairs(pred, "cluster_id").withColumn("p", F.lit(1))
    both = g.join(p, [*GROUP, "v1", "v2"], "full")
    return both.groupBy(*GROUP).agg(F.count(F.col("g") + F.col("p")).alias("tp"), F.count("p").alias("n_pred"), F.count("g").alias("n_gold"))


def pair_f1(gold: DataFrame, pred: DataFrame) -> DataFrame:
    return _prf(pair_counts(gold, pred), "pair", F.col("tp"), F.col("n_pred"), F.col("tp"), F.col("n_gold"))


def missed(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Gold values that no predicted cluster has."""
    return gold.where("kind <> 'error'").select(*GROUP, "value").distinct().join(pred.select(*GROUP, "value"), [*GROUP, "value"], "left_anti")


def report(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """All metrics side by side."""
    y = labels(gold, pred)
    out = pair_f1(gold, pred)
    for x in (macro_f1(gold, pred), micro_f1(gold, pred), exact_f1(gold, pred), purity(y), ari(y), fmi(y), nmi(y), vmeasure(y)):
        out = out.join(x, GROUP)
    return out
