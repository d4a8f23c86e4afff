"""Whole sets move only for pairs that may link, and shuffled files go when a table is written."""

import glob
import os

import numpy as np

from canonry.llm import ngram_join
from canonry.plans import scratch


def test_sets_of_pairs_that_cannot_link_are_not_moved(spark, monkeypatch):
    rng = np.random.default_rng(7)
    base = [f"w{i}" for i in range(1200)]
    far = [base[:700] + [f"{j}x{i}" for i in range(500)] for j in range(12)]  # 0.4 of their shingles shared
    near = [base[:600] + [f"{j}y"] + base[601:] for j in range(2)]
    sizes = [[f"z{i}" for i in range(n)] for n in (1000, 1100)]  # their bits are of different widths
    docs = [(i, " ".join(ws)) for i, ws in enumerate([*far, *near, *sizes, *([str(x) for x in rng.integers(0, 9**9, n)] for n in (0, 1, 3))])]
    rows = spark.createDataFrame(docs, "doc long, text string")
    n = len(docs)
    pairs = spark.createDataFrame([(a, b) for a in range(n) for b in range(a + 1, n)], "a long, b long")
    kept = {}
    plain = ngram_join.cut

    def cut(df, name):
        out = plain(df, name)
        kept[name] = out.count()
        return out

    monkeypatch.setattr(ngram_join, "cut", cut)
    got = {(r.a, r.b) for r in ngram_join._verify(pairs, rows, 5, 80).collect()}
    sets = [frozenset(tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)) for _, t in docs]
    want = {(a, b) for a in range(n) for b in range(a + 1, n) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert got == want and (12, 13) in got and (14, 15) in got
    assert kept["sets"] == 4  # all 19 before


def test_bits_differ_in_no_more_than_the_elements():
    rng = np.random.default_rng(8)
    for n in (1, 2, 31, 32, 33, 500, 1024, 5000):
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for m in (1, n // 3 + 1, n, 5 * n):
            y = np.unique(np.concatenate([x[: n - n // 4], rng.integers(0, 1 << 63, m).astype(np.uint64)]))
            assert ngram_join.bits_apart(ngram_join.wide(x), ngram_join.wide(y)) <= len(np.setxor1d(x, y))
        assert ngram_join.bits_apart(ngram_join.wide(x), ngram_join.wide(x)) == 0


def test_a_written_table_leaves_no_shuffled_files(spark):
    top = spark.conf.get("spark.local.dir", None) or os.environ.get("SPARK_LOCAL_DIRS") or "/tmp"
    files = lambda: set(glob.glob(f"{top}/blockmgr-*/*/shuffle_*.data"))
    before = files()
    asked = spark.conf.get(scratch.SHUFFLES_GO, None)
    out = scratch.cut(spark.range(10_000).selectExpr("id % 97 as k").groupBy("k").count().repartition(5, "count"), "counts")
    assert out.count() == 97 and not {f for f in files() - before if os.path.getsize(f) > 500}
    assert spark.conf.get(scratch.SHUFFLES_GO, None) == asked
