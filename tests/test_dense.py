"""Dense vectors by blocks: odd vectors, values that repeat, several blocks, and no join of all pairs."""

import random

from pyspark.sql import functions as F

from canonry.operators import cluster, dense, similarity
from tests.conftest import DATA, rows_of

SCHEMA = "attr string, con string, value string, embedding array<double>"


def _rows():
    rng = random.Random(3)
    rows = [("a", str(i % 2), f"v{i}", [rng.choice([0.0, 0.5, 1.0, -0.25]) for _ in range(4)]) for i in range(60)]
    odd = [[1.0], [2.0], [], [], [1.0, None, 1.0, 1.0], [1e200] * 4, [1e-200] * 4, [0.0] * 4, None]
    return rows + [("a", "0", f"w{i}", e) for i, e in enumerate(odd)] + [("a", "0", "v0", [1.0, 1.0, 0.0, 0.0]), (None, "0", "n", [1.0] * 4), ("a", "0", None, [1.0] * 4)]


def test_blocks_equal_pair_by_pair(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK", 7)
    e = spark.createDataFrame(_rows(), SCHEMA)
    v = similarity.unit_vectors(e)
    a = v.select("attr", "con", F.col("value").alias("v1"), F.col("e").alias("x"), F.col("norm").alias("m"))
    b = v.select("attr", "con", F.col("value").alias("v2"), F.col("e").alias("y"), F.col("norm").alias("n"))
    want = a.join(b, ["attr", "con"]).where("v1 < v2").select("attr", "con", "v1", "v2", similarity.r4(similarity._dot(F.col("x"), F.col("y")) / (F.col("m") * F.col("n"))).alias("sim"))
    got = similarity.dense_cosine(e)
    assert rows_of(got.toPandas()) == rows_of(want.toPandas())
    for eps in (0.0, 0.5, 1.1):
        assert rows_of(cluster.dbscan_vectors(e, eps).toPandas()) == rows_of(cluster.dbscan(e, similarity.dense_distance(e), eps).toPandas())


def test_no_plan_joins_all_pairs(spark):
    from canonry import catalogue

    plan = lambda name: catalogue.queries()[name](spark, f"{DATA}/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "GroupsInArrow" in plan("cosine_pairs") and "zip_with" not in plan("dbscan_eps")
