"""Connected components by alternating large-star and small-star rounds, all DataFrame joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canonry.plans.scratch import cut, discard


def _large_star(edges: DataFrame, keys: list[str]) -> DataFrame:
    both = edges.unionByName(edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy(*keys, "u").agg(F.min("v").alias("m")).select(*keys, "u", F.least("u", "m").alias("m"))
    return both.join(low, [*keys, "u"]).where("v > u").select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, keys: list[str]) -> DataFrame:
    low = edges.groupBy(*keys, "u").agg(F.min("v").alias("m"))
    moved = edges.join(low, [*keys, "u"]).where("v <> m").select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select(*keys, "u", F.col("m").alias("v"))).distinct()


def _settled(edges: DataFrame, keys: list[str]) -> bool:
    """Every node hangs on one other that hangs on none: the distinct edges are stars around their smallest nodes."""
    ends = edges.select(*keys, F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(*keys, F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy(*keys, "node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.where("up + down > 1").agg(F.count("*")).first()[0] == 0


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", keys: list[str] | None = None, max_rounds: int = 60) -> DataFrame:
    """Label every node that has a link with the smallest node it reaches.

    edges: (*keys, src, dst), nodes of any orderable type; components never cross `keys`. Self links, repeated links
    and links with a null end are allowed and change nothing; a node only in self links is absent. Returns
    (*keys, node, component); an empty input gives an empty result. Each round is a written table, so a lost
    executor costs one round at most. A hub only meets its own minimum, which partial aggregation keeps small.
    """
    keys = list(keys or [])
    e = edges.select(*keys, F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst))).distinct()
    e = cut(e, "cc")
    for _ in range(max_rounds):
        if _settled(e, keys):
            break
        before, e = e, cut(_small_star(_large_star(e, keys), keys), "cc")
        discard(before)
    else:
        raise RuntimeError("connected components did not settle")
    return e.select(*keys, F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(*keys, F.col("v").alias("node"), F.col("v").alias("component")).distinct())
