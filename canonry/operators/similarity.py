"""Pair similarities within a group. Pairs are canonical: v1 < v2."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canonry.functions.text import GROUP, r4
from canonry.operators import dense


def all_pairs(values: DataFrame) -> DataFrame:
    """Every unordered pair of a group's distinct values: the caller asks for a quadratic result, so groups are small."""
    v = values.select(*GROUP, "value").distinct()
    return v.withColumnRenamed("value", "v1").join(v.withColumnRenamed("value", "v2"), GROUP).where("v1 < v2")


def shared_pieces(pieces: DataFrame, weight: str) -> DataFrame:
    """(attr, con, v1, v2, shared): pairs with a common piece by an inverted index, with the sum of `weight` over common pieces."""
    a = pieces.select(*GROUP, "piece", F.col("value").alias("v1"), F.col(weight).alias("w"))
    b = pieces.select(*GROUP, "piece", F.col("value").alias("v2"))
    return a.join(b, [*GROUP, "piece"]).where("v1 < v2").groupBy(*GROUP, "v1", "v2").agg(F.sum("w").alias("shared"))


def weighted_jaccard(pieces: DataFrame) -> DataFrame:
    """Pieces common to two values over pieces of either, weighted by the group's counts; pairs without a common piece (0) are absent."""
    corpus = pieces.groupBy(*GROUP, "piece").agg(F.sum("cnt").alias("w"))
    weighed = pieces.select(*GROUP, "value", "piece").distinct().join(corpus, [*GROUP, "piece"])
    whole = weighed.groupBy(*GROUP, "value").agg(F.sum("w").alias("whole"))
    pairs = shared_pieces(weighed, "w")
    for v in ("v1", "v2"):
        pairs = pairs.join(whole.select(*GROUP, F.col("value").alias(v), F.col("whole").alias(f"w{v}")), [*GROUP, v])
    return pairs.select(*GROUP, "v1", "v2", r4(F.col("shared") / (F.col("wv1") + F.col("wv2") - F.col("shared"))).alias("sim"))


def sparse_cosine(vectors: DataFrame) -> DataFrame:
    """Cosine of sparse vectors (attr, con, value, piece, w) for all pairs; a zero vector has 0 with everything."""
    a = vectors.select(*GROUP, "piece", F.col("value").alias("v1"), F.col("w").alias("wa"))
    b = vectors.select(*GROUP, "piece", F.col("value").alias("v2"), F.col("w").alias("wb"))
    dot = a.join(b, [*GROUP, "piece"]).where("v1 < v2").groupBy(*GROUP, "v1", "v2").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    norm = vectors.groupBy(*GROUP, "value").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    pairs = all_pairs(vectors).join(dot, [*GROUP, "v1", "v2"], "left")
    for v in ("v1", "v2"):
        pairs = pairs.join(norm.select(*GROUP, F.col("value").alias(v), F.col("norm").alias(f"n{v}")), [*GROUP, v])
    both = F.col("nv1") * F.col("nv2")
    return pairs.select(*GROUP, "v1", "v2", F.when(both > 0, r4(F.coalesce("dot", F.lit(0.0)) / both)).otherwise(F.lit(0.0)).alias("sim"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit_vectors(embeddings: DataFrame) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    return embeddings.select(*GROUP, "value", e.alias("e")).withColumn("norm", F.sqrt(_dot(F.col("e"), F.col("e")))).where("norm > 0")


def dense_cosine(embeddings: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Cosine of (attr, con, value, embedding), for all pairs of a group or the given (attr, con, v1, v2)."""
    v = unit_vectors(embeddings)
    if pairs is None:
        return dense.cosines(v).select(*GROUP, "v1", "v2", r4(F.col("cos")).alias("sim"))
    a = v.select(*GROUP, F.col("value").alias("v1"), F.col("e").alias("e1"), F.col("norm").alias("n1"))
    b = v.select(*GROUP, F.col("value").alias("v2"), F.col("e").alias("e2"), F.col("norm").alias("n2"))
    met = pairs.select(*GROUP, "v1", "v2").join(a, [*GROUP, "v1"]).join(b, [*GROUP, "v2"])
    return met.select(*GROUP, "v1", "v2", r4(_dot(F.col("e1"), F.col("e2")) / (F.col("n1") * F.col("n2"))).alias("sim"))


def dense_distance(embeddings: DataFrame) -> DataFrame:
    """Euclidean distance of all pairs of a group, as dist."""
    e = embeddings.select(*GROUP, "value", F.col("embedding").cast("array<double>").alias("e"))
    a = e.select(*GROUP, F.col("value").alias("v1"), F.col("e").alias("e1"))
    b = e.select(*GROUP, F.col("value").alias("v2"), F.col("e").alias("e2"))
    gap = F.aggregate(F.zip_with("e1", "e2", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return a.join(b, GROUP).where("v1 < v2").select(*GROUP, "v1", "v2", r4(F.sqrt(gap)).alias("dist"))


def blend(a: DataFrame, b: DataFrame, alpha: float) -> DataFrame:
    """alpha * a + (1 - alpha) * b on pairs in both; at 1 or 0 one side as it is."""
    if alpha in (0, 1):
        return a if alpha == 1 else b
    both = a.withColumnRenamed("sim", "s1").join(b.withColumnRenamed("sim", "s2"), [*GROUP, "v1", "v2"])
    return both.select(*GROUP, "v1", "v2", (F.lit(alpha) * F.col("s1") + F.lit(1 - alpha) * F.col("s2")).alias("sim"))


def extent(sims: DataFrame) -> DataFrame:
    return sims.groupBy(*GROUP).agg(F.min("sim").alias("min_sim"), F.max("sim").alias("max_sim"), r4((F.min("sim") + F.max("sim")) / 2).alias("mid_sim"))


def lookup(pairs: DataFrame, sims: DataFrame, default: float | None = 0.0) -> DataFrame:
    """sim of each pair, given in either order; a missing one has the default, or is left out if that is None."""
    canon = pairs.withColumn("lo", F.least("v1", "v2")).withColumn("hi", F.greatest("v1", "v2"))
    s = sims.select(*GROUP, F.col("v1").alias("lo"), F.col("v2").alias("hi"), "sim")
    met = canon.join(s, [*GROUP, "lo", "hi"], "inner" if default is None else "left").drop("lo", "hi")
    return met if default is None else met.withColumn("sim", F.coalesce("sim", F.lit(default)))


@dataclass(frozen=True)
class SimSpec:
    kind: str
    second: str | None
    alpha: float


def parse_sim_type(name: str) -> SimSpec:
    """A similarity by name: a last digit d mixes with weight d/10, the second leg is named in it."""
    m = re.fullmatch(r"(.*?)(\d)?", name, re.S)
    alpha = int(m[2]) / 10 if m[2] else 1.0
    body = m[1]
    if body.startswith("text_emb"):
        second = next((k for p, k in (("cp_w_f", "cp_w_freq"), ("cp_wo_f", "cp_wo_freq"), ("tfidf", "wp_tfidf"), ("wp_idf", "wp_idf")) if p in body), None)
        return SimSpec("text_emb", second, alpha if second else 1.0)
    if body not in ("cp_w_freq", "cp_wo_freq", "wp_tfidf", "wp_idf"):
        raise ValueError(f"no similarity {name}")
    return SimSpec(body, None, alpha)
