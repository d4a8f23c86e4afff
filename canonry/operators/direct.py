"""Direct judging of ranked pairs: top k, early stop, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from canonry.functions.text import GROUP
from canonry.operators.cluster import components, pair_clusters, star_clusters, with_singles
from canonry.operators.judge import judged



def _order() -> list:
    return [F.desc("sim"), F.asc("v1"), F.asc("v2")]


def ranked(sims: DataFrame) -> DataFrame:
    """(…, rank): pairs of a group by similarity, ties by value."""
    return sims.withColumn("rank", F.row_number().over(W.partitionBy(*GROUP).orderBy(*_order())))


def top_k(sims: DataFrame, k: int = 200) -> DataFrame:
    return ranked(sims).where(F.col("rank") <= k)


def early_stop(ranked_answers: DataFrame, stop: int) -> DataFrame:
    """Rows (…, rank, answer) up to the stop-th "no" in a row; yes begins anew, other answers are neutral. -1: all rows."""
    if stop < 0:
        return ranked_answers
    w = W.partitionBy(*GROUP).orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    island = ranked_answers.withColumn("island", F.sum((F.col("answer") == "yes").cast("int")).over(w))
    wi = W.partitionBy(*GROUP, "island").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    run = island.withColumn("run", F.sum((F.col("answer") == "no").cast("int")).over(wi))
    end = F.min(F.when((F.col("answer") == "no") & (F.col("run") >= stop), F.col("rank"))).over(W.partitionBy(*GROUP))
    return run.withColumn("end", end).where("end is null or rank <= end").drop("island", "run", "end")


def stratified_cap(candidates: DataFrame, key: str = "cluster_id", cap: int = 2000) -> DataFrame:
    """If a group has more than cap candidates, each cluster keeps its share, rounded down, in order of its pairs."""
    total = F.count("*").over(W.partitionBy(*GROUP))
    n = F.count("*").over(W.partitionBy(*GROUP, key))
    rank = F.row_number().over(W.partitionBy(*GROUP, key).orderBy("v1", "v2"))
    return candidates.withColumn("total", total).withColumn("n", n).withColumn("rank", rank).where(F.expr(f"total <= {cap} OR rank <= floor({cap} * n / total)")).drop("total", "n", "rank")


def direct_clusters(values: DataFrame, sims: DataFrame, mode: str = "topk", k: int = 200, stop: int = 20, verdicts: DataFrame | None = None, shape: str = "closure") -> DataFrame:
    """Clusters from judged pairs. mode: topk, all or early_stop; shape: closure (transitive), star or pairs."""
    pairs = top_k(sims, k) if mode == "topk" else ranked(sims)
    answers = judged(pairs, verdicts)
    if mode == "early_stop":
        answers = early_stop(pairs.join(answers.select(*GROUP, "v1", "v2", "answer"), [*GROUP, "v1", "v2"]), stop)
    yes = answers.where("answer = 'yes'").select(*GROUP, "v1", "v2")
    if shape == "star":
        return star_clusters(values, yes)
    return pair_clusters(values, yes) if shape == "pairs" else with_singles(values, components(yes))
