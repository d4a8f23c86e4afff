"""The engine's queries over the test tables, each with its SQL equivalent where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canonry.functions import text as T
from canonry.functions import weights as M
from canonry.functions.text import GROUP, r4
from canonry.operators import cluster as C
from canonry.operators import direct as L
from canonry.operators import evaluate as E
from canonry.operators import judge as J
from canonry.operators import review as R
from canonry.operators import similarity as V
from canonry.plans.scratch import new_path
from canonry.sources import io
from canonry.sources import testdata as D

Query = Callable[[SparkSession, str], DataFrame]
THRESHOLD = 0.7
TEMPLATE = "Do these two values mean the same?\nInput:\n"
ROWS_ONLY = ("kmeans_elbow", "louvain_communities", "subsequence_expand")


def _sims(s: SparkSession, d: str) -> DataFrame:
    return V.weighted_jaccard(T.char_pieces(D.part_values(s, d)))


def _wp(s: SparkSession, d: str) -> DataFrame:
    return T.word_pieces(D.values(s, d))


def _tfidf_cos(s: SparkSession, d: str) -> DataFrame:
    return V.sparse_cosine(M.tfidf(_wp(s, d), D.values(s, d)))


def _yes(s: SparkSession, d: str) -> DataFrame:
    sims = _sims(s, d).where("sim >= 0.5")
    return J.judged(sims).where("answer = 'yes'").select(*GROUP, "v1", "v2")


def _review(s: SparkSession, d: str) -> dict[str, DataFrame]:
    m, sims = D.members(s, d), _sims(s, d)
    p = R.profile(m, sims)
    g = R.group_stats(p, sims)
    cand = R.intra_candidates(m, p, g, sims)
    out = R.evicted(cand)
    inter = R.inter_candidates(p, out, g, sims)
    yes = inter.where(T.verdict_class(J.rule_answer(F.col("v1"), F.col("v2"))) == "yes")
    return {"m": m, "sims": sims, "p": p, "g": g, "cand": cand, "out": out, "inter": inter, "yes": yes}


def _asked(s: SparkSession, d: str) -> DataFrame:
    answer = J.rule_answer(F.col("v1"), F.col("v2"))
    return _sims(s, d).select(*GROUP, "v1", "v2", T.prompt(F.lit(TEMPLATE), F.col("v1"), F.col("v2"), "review").alias("prompt"), answer.alias("raw"), F.when(F.length("v1") % 2 == 0, "cache").otherwise("new").alias("source"))


def _center_star(s: SparkSession, d: str) -> DataFrame:
    v = D.vectors(s, d).select(*GROUP, "value")
    first = v.groupBy(*GROUP).agg(F.min("value").alias("v1"))
    return v.join(first, GROUP).where("value <> v1").select(*GROUP, "v1", F.col("value").alias("v2"))


def _trivial(s: SparkSession, d: str) -> DataFrame:
    n, r = D.table(s, d, "nation"), D.table(s, d, "region")
    v = n.join(r, n.n_regionkey == r.r_regionkey).select(F.lit("n_name").alias("attr"), F.col("r_name").alias("con"), "n_name")
    return J.trivial_yes(v.select(*GROUP, F.col("n_name").alias("v1")).join(v.select(*GROUP, F.lower("n_name").alias("v2")), GROUP))


def _roundtrip(s: SparkSession, d: str) -> DataFrame:
    path = new_path(s, "sim-file")
    io.sim_lines(_sims(s, d)).write.text(path)
    files = s.read.text(path, wholetext=True)
    one = new_path(s, "sim-file-one")
    files.write.text(one)
    return io.read_sim_file(s, one)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Char pieces, weighted Jaccard, components at the threshold, and the medoid of every cluster."""
    values = D.part_values(spark, d)
    sims = _sims(spark, d)
    found = C.hac_single_link(values, sims, THRESHOLD).withColumnRenamed("cluster", "cluster_id")
    return R.profile(found, sims)


def queries() -> dict[str, Query]:
    c = F.col
    lab = lambda s, d: E.labels(D.gold(s, d), D.members(s, d))
    gp = lambda f: lambda s, d: f(D.gold(s, d), D.members(s, d))
    rv = lambda k: lambda s, d: _review(s, d)[k]
    return {
        # sources
        "gold_values": lambda s, d: io.gold_values(D.gold(s, d)),
        "embeddings_scan": lambda s, d: D.table(s, d, "embeddings").select("vec_id", F.size("embedding").alias("dim"), r4(F.aggregate(c("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x)).alias("norm2")),
        "value_freq": D.values,
        "sim_roundtrip": _roundtrip,
        "target_values": lambda s, d: io.gold_values(io.target_filter(D.gold(s, d), ["p_name_ECONOMY", "p_name_PROMO"], True)),
        # filters and predicates
        "strip_suffix": lambda s, d: D.table(s, d, "customer").select("c_custkey", T.strip_suffix(F.concat("c_name", F.lit(T.SUFFIX), "c_mktsegment")).alias("value")),
        "target_filter": lambda s, d: io.target_filter(D.values(s, d), ["o_orderpriority"], False),
        "sim_threshold_edges": lambda s, d: _sims(s, d).where(f"sim >= {THRESHOLD}"),
        "verdict_class": lambda s, d: _asked(s, d).select(*GROUP, "v1", "v2", T.verdict_class(c("raw")).alias("verdict")),
        "trivial_yes": _trivial,
        # text
        "char_pieces_w_freq": lambda s, d: T.char_pieces(D.part_values(s, d)),
        "char_piece_counts": lambda s, d: T.char_pieces(D.part_values(s, d)).groupBy(*GROUP, "piece").agg(F.sum("cnt").alias("cnt")),
        "char_pieces_wo_freq": lambda s, d: T.char_pieces(D.values(s, d), weighted=False),
        "word_pieces": _wp,
        "word_contains": lambda s, d: T.contained_words(D.values(s, d)),
        "strip_numbers": lambda s, d: D.table(s, d, "conversations").select("conv_id", "turn", T.strip_numbers(c("text")).alias("value")),
        "script_filter": lambda s, d: D.table(s, d, "documents").select("doc_id", T.in_script(c("text")).alias("has_script")),
        "subsequence_expand": lambda s, d: D.part_values(s, d).select(*GROUP, "value", T.spelled_out(c("value")).alias("expanded")),
        "prompt_build": lambda s, d: _sims(s, d).select(*GROUP, "v1", "v2", *[T.prompt(F.lit(TEMPLATE), c("v1"), c("v2"), k).alias(k) for k in ("pair", "topk", "early", "review")]),
        "parse_answer": lambda s, d: D.table(s, d, "conversations").select("conv_id", "turn", T.parse_answer(c("text")).alias("answer")),
        "parse_answer_llama": lambda s, d: _asked(s, d).select(*GROUP, "v1", "v2", T.parse_completion(F.concat(F.lit("Input:\nx\ny\nOutput: no\nInput:\n"), "v1", F.lit("\n"), "v2", F.lit("\nOutput： "), "raw", F.lit("\n")), c("v1"), c("v2")).alias("answer")),
        # weights
        "tf": lambda s, d: M.tf(_wp(s, d)),
        "weighted_df": lambda s, d: M.weighted_df(_wp(s, d), D.values(s, d)),
        "idf": lambda s, d: M.idf(_wp(s, d), D.values(s, d)),
        "tfidf": lambda s, d: M.tfidf(_wp(s, d), D.values(s, d)),
        "idf_vector": lambda s, d: M.idf_vector(_wp(s, d), D.values(s, d)),
        # joins and similarities
        "all_pairs": lambda s, d: V.all_pairs(D.part_values(s, d)),
        "shared_piece_pairs": lambda s, d: V.shared_pieces(T.char_pieces(D.part_values(s, d)), "cnt"),
        "wjaccard_w_freq": _sims,
        "wjaccard_wo_freq": lambda s, d: V.weighted_jaccard(T.char_pieces(D.part_values(s, d), weighted=False)),
        "tfidf_cosine_pairs": _tfidf_cos,
        "idf_cosine_pairs": lambda s, d: V.sparse_cosine(M.idf_vector(_wp(s, d), D.values(s, d))),
        "cosine_pairs": lambda s, d: V.dense_cosine(D.vectors(s, d)),
        "cosine_for_pairs": lambda s, d: V.dense_cosine(D.vectors(s, d), _center_star(s, d)),
        "blended_sims": lambda s, d: V.blend(_sims(s, d), _tfidf_cos(s, d), 0.6).withColumn("sim", r4(c("sim"))),
        "pair_lookup_default0": lambda s, d: V.lookup(V.all_pairs(D.part_values(s, d)).select(*GROUP, c("v2").alias("v1"), c("v1").alias("v2")), _sims(s, d)),
        "sim_extent": lambda s, d: V.extent(_sims(s, d)),
        "sim_saturated": lambda s, d: V.dense_cosine(D.vectors(s, d)).where("sim >= 1").unionByName(_tfidf_cos(s, d).where("sim >= 1")),
        "center_pairs": lambda s, d: (lambda x: R.center_pairs(x["p"], x["sims"]))(_review(s, d)),
        # clusters
        "hac_single_link": lambda s, d: C.hac_single_link(D.part_values(s, d), _sims(s, d), THRESHOLD),
        "transitive_closure": lambda s, d: C.with_singles(D.part_values(s, d), C.components(_yes(s, d))),
        "star_clusters": lambda s, d: C.star_clusters(D.part_values(s, d), _yes(s, d)),
        "pair_clusters": lambda s, d: C.pair_clusters(D.part_values(s, d), _yes(s, d)),
        "unclustered_singletons": lambda s, d: C.unclustered(D.part_values(s, d), _yes(s, d).select(*GROUP, F.explode(F.array("v1", "v2")).alias("value"))),
        "dbscan_eps": lambda s, d: C.dbscan_vectors(D.vectors(s, d), 1.1),
        "modularity": lambda s, d: C.modularity(_sims(s, d), D.members(s, d).withColumnRenamed("cluster_id", "cluster")).withColumn("modularity", r4(c("modularity") + 1e-9)),
        "louvain_communities": lambda s, d: C.louvain(D.part_values(s, d), _sims(s, d)),
        "kmeans_elbow": lambda s, d: C.kmeans_elbow(D.vectors(s, d)),
        # direct judging
        "ranked_pairs": lambda s, d: L.ranked(_sims(s, d)),
        "topk_pairs": lambda s, d: L.top_k(_sims(s, d)),
        "early_stop_pairs": lambda s, d: L.early_stop(L.ranked(_sims(s, d)).withColumn("answer", J.rule_answer(c("v1"), c("v2"))), 5),
        "verdict_hits": lambda s, d: J.hits(_sims(s, d), D.verdicts(_sims(s, d))),
        "verdict_misses": lambda s, d: J.misses(_sims(s, d), D.verdicts(_sims(s, d))),
        "budgeted_misses": lambda s, d: J.budgeted(J.misses(_sims(s, d), D.verdicts(_sims(s, d))), 100),
        "stratified_cap": lambda s, d: L.stratified_cap(_sims(s, d).select(*GROUP, F.ascii("v1").alias("cluster_id"), "v1", "v2"), cap=500),
        "cost_report": lambda s, d: J.cost_report(_asked(s, d)),
        # review
        "cluster_medoid": lambda s, d: _review(s, d)["p"].select(*GROUP, "cluster_id", "center"),
        "cluster_profile": rv("p"),
        "group_sim_stats": rv("g"),
        "intra_candidates": rv("cand"),
        "evicted_members": rv("out"),
        "inter_candidates": rv("inter"),
        "merged_clusters": lambda s, d: (lambda x: R.merged(x["m"], x["out"], x["yes"]))(_review(s, d)),
        "corrected_clusters": lambda s, d: R.correct(D.members(s, d), _sims(s, d)),
        # evaluation
        "gold_pred_overlap": gp(E.overlap),
        "label_vectors": lab,
        "pair_prf": gp(E.pair_counts),
        "eval_pair_f1": gp(E.pair_f1),
        "eval_macro_f1": gp(E.macro_f1),
        "eval_micro_f1": gp(E.micro_f1),
        "eval_exact_f1": gp(E.exact_f1),
        "eval_fmi": lambda s, d: E.fmi(lab(s, d)),
        "eval_vmeasure": lambda s, d: E.vmeasure(lab(s, d)),
        "eval_ari": lambda s, d: E.ari(lab(s, d)),
        "eval_nmi": lambda s, d: E.nmi(lab(s, d)),
        "eval_acc": lambda s, d: E.accuracy(lab(s, d)),
        "eval_purity": lambda s, d: E.purity(lab(s, d)),
        "eval_purity_compat": lambda s, d: E.purity(lab(s, d), True),
        "eval_report": gp(E.report),
    }


def oracle_sql() -> dict[str, str]:
    from canonry import oracle

    return oracle.statements()
