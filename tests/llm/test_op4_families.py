"""Families of near copies whose source is not among them."""

import random

from pyspark.sql import functions as F

from canonry.llm import ngram_join
from canonry.llm.common import small_batches


def test_members_that_share_only_what_the_named_one_lacks_are_no_pairs(spark, monkeypatch):
    rng, near = random.Random(5), []
    base = [f"w{i}" for i in range(100)]
    texts = []
    for i in range(120):
        words = list(base)
        for j in rng.sample(range(100), 4):
            words[j] = f"x{i}-{j}"
        texts.append((i, " ".join(words)))
    texts.append((120, texts[7][1].replace("x7-", "y7-", 1)))
    cut = ngram_join.cut
    monkeypatch.setattr(ngram_join, "cut", lambda df, name: (lambda out: near.append(out.count()) or out if name == "near" else out)(cut(df, name)))
    small_batches(spark)
    docs = spark.createDataFrame(texts, "doc long, text string")
    groups = docs.select(F.lit(0).cast("long").alias("grp"), "doc", F.col("doc").alias("comp"))
    sigs = ngram_join._met(docs.withColumn("th", F.col("doc")), 5, 80).where("n is not null")
    certain, pairs = ngram_join._within(groups, sigs.select("doc", "sid", "n", *ngram_join.SKETCH), docs, 5, 80)
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, t in texts for w in [t.split()]}
    links = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    found = {tuple(r) for r in certain.collect()} | {tuple(r) for r in pairs.collect()}
    assert (7, 120) in links and links <= found
    assert near[0] < 1000  # of 7260 pairs; all of them by the differences to document 0


def test_differences_are_counted_without_a_row_each(spark, monkeypatch):
    rng, plans = random.Random(6), []
    rows = []
    for g in (1, 2):
        base = [f"g{g}w{i}" for i in range(150)]
        for i in range(90):
            words = list(base)
            words[5] = "common" if i % 3 else words[5]
            for j in rng.sample(range(10, 150), 2):
                words[j] = rng.choice(["a", "b", f"x{i}"]) + str(j)
            rows.append((1000 * g + i, " ".join(words), 1000 * g))
    cut = ngram_join.cut
    monkeypatch.setattr(ngram_join, "cut", lambda df, name: plans.append((name, df._jdf.queryExecution().toString())) or cut(df, name))
    monkeypatch.setattr(ngram_join, "COUNTED", 1500, raising=False)  # several parts
    small_batches(spark)
    table = spark.createDataFrame(rows, "doc long, text string, grp long")
    docs = table.select("doc", "text")
    sigs = ngram_join._met(docs.withColumn("th", F.col("doc")), 5, 80).where("n is not null")
    certain, pairs = ngram_join._within(table.select("grp", "doc", F.col("doc").alias("comp")), sigs.select("doc", "sid", "n", *ngram_join.SKETCH), docs, 5, 80)
    assert not any("Generate" in plan for name, plan in plans if name == "differences")

    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, t, _ in rows for w in [t.split()]}
    links = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    sure = {tuple(r) for r in certain.collect()}
    near = {tuple(r) for r in pairs.collect()}
    assert links and sure <= links and all(_joined(sure, a, b) for a, b in links - near)


def _joined(edges, a, b):
    """a and b are joined by edges."""
    seen, todo = {a}, [a]
    while todo:
        v = todo.pop()
        new = {y if x == v else x for x, y in edges if v in (x, y)} - seen
        seen |= new
        todo += new
    return b in seen


def test_often_equals_counts(spark):
    rng = random.Random(7)
    rows, want = [], {}
    for g, c in ((1, 100), (2, 3), (3, 64)):
        held = []
        for _ in range(c):
            more = sorted(e for e in range(-30, 0) if rng.random() < (-e) / 31)
            less = sorted(e for e in range(1, 31) if rng.random() < e / 31)
            held.append((more, less))
            rows.append((g, c, 4, more, less))
        told, moved = [], set()
        for e in [*range(-30, 0), *range(1, 31)]:
            times = sum(e in x for m in held for x in m)
            if times > max(1, c / ngram_join.OFTEN):
                holds = times if e < 0 else c - times
                swap = (2 * holds > c) == (e < 0)
                moved |= {e} if swap else set()
                told.append((c - times if swap else times, e))
        want[g] = ([e for _, e in sorted(told)], moved)
    own = spark.createDataFrame(rows, "grp long, c long, parts long, more array<long>, less array<long>").repartition(5)
    got = {r.grp: (r.often, set(r.moved)) for r in ngram_join._often(own).collect()}
    assert got == want
