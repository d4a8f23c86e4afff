"""Toxic documents are rejected by a model of all labels, at the rates of all labels."""

import numpy as np

from canonry.llm import toxicity
from canonry.llm.common import crc_mod

SCHEMA = "doc_id long, text string"


def test_bias_does_not_hang_on_sampling(spark):
    docs = spark.createDataFrame([(i, "one and the same text") for i in range(2000)], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(2000)], "doc_id long, toxic int")
    part = toxicity.score(docs.limit(1), toxicity.fit(docs, labels, clean=200)).first().score
    assert abs(part - 0.1) < 0.06


def test_all_labelled_rows_are_learned_from(spark):
    ids = [r.doc_id for r in spark.range(3000).toDF("doc_id").where(crc_mod("doc_id", 3) == 1).collect()]
    docs = spark.createDataFrame([(i, "vile words of abuse" if k % 2 else "fair weather by the sea") for k, i in enumerate(ids)], SCHEMA)
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, toxic int")
    assert toxicity.drop_toxic(docs, labels).select("text").distinct().collect() == [("fair weather by the sea",)]


def test_ftrl_equals_a_plain_loop():
    rng = np.random.default_rng(3)
    rows = [(np.unique(rng.integers(0, 60, 12)), int(rng.random() < 0.4)) for _ in range(80)]
    got = toxicity.ftrl(rows, passes=2)
    z, n, bias, bias_n = {}, {}, np.log((sum(y for _, y in rows) + 0.5) / (80 - sum(y for _, y in rows) + 0.5)), 1.0
    weight = lambda i: 0.0 if abs(z.get(i, 0)) <= toxicity.L1 else -(z[i] - np.sign(z[i]) * toxicity.L1) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)
    for _ in range(2):
        for f, y in rows:
            w = {i: weight(i) for i in f.tolist()}
            g = 1 / (1 + np.exp(-(sum(w.values()) + bias))) - y
            for i in w:
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / toxicity.ALPHA * w[i]
                n[i] = old + g * g
            bias_n += g * g
            bias -= 0.1 * g / bias_n**0.5
    want = {i: weight(i) for i in z if abs(z[i]) > toxicity.L1}
    assert set(got.index.tolist()) == set(want) and abs(got.bias - bias) < 1e-9
    assert all(abs(want[int(i)] - v) < 1e-4 for i, v in zip(got.index, got.value))


def test_rows_are_dropped_not_ids(spark):
    bad, good = "vile wretched scum " * 5, "a calm and pleasant day at the lake"
    docs = spark.createDataFrame([(i, bad if i % 3 == 0 else good, i) for i in range(300)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    rows = docs.unionByName(spark.createDataFrame([(None, bad, 1), (None, good, 2), (1, bad, 3), (400, None, 4), (401, good * 3000, 5)], "doc_id long, text string, toxic int"))
    left = toxicity.drop_toxic(rows, labels)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text) for r in left.collect() if r.doc_id is None or r.doc_id in (0, 1, 400, 401)) == sorted([(-1, good), (1, good), (400, None), (401, good * 3000)], key=lambda x: (x[0], x[1] or ""))
