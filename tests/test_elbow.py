"""The elbow is looked for among all k."""

from canonry.operators import cluster


def test_elbow_beyond_eight(spark, monkeypatch):
    tried = []
    elbow = cluster.elbow
    monkeypatch.setattr(cluster, "elbow", lambda costs, keys: tried.extend(r.k for r in costs.collect()) or elbow(costs, keys))
    rows = [(f"v{i}", [float((i % 12 == j) * 100) + (i // 12) * 0.01 for j in range(12)]) for i in range(24)]
    got = cluster.kmeans_elbow(spark.createDataFrame(rows, "value string, embedding array<double>")).collect()
    assert sorted(tried) == list(range(1, 25)) and len(got) == 24
