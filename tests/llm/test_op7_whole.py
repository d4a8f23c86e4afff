"""Repeated passages of any make are found."""

import glob
import numpy as np

from canonry.llm import substring_dedup

SCHEMA = "doc_id long, text string"


def test_passages_of_50_words_keep_their_runs():
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    for _ in range(400):
        p = text(50)
        (da, _, wa), (db, _, wb) = (substring_dedup.chunks(f"{text(40)} {p} {text(40)}") for _ in range(2))
        first, _ = substring_dedup.units(da, wa)
        x, at = substring_dedup.units(db, wb)
        hits = {int(k): 1 for u, k in zip(x, at) if u in set(first.tolist())}
        assert [n >= 20 for _, _, n, _ in substring_dedup.runs(hits, wb)] == [True]


def test_short_phrases_over_and_over(spark):
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), rng.integers(1, 9)))
    phrases = [" ".join(word() for _ in range(k)) for k in (1, 2, 3, 4, 5, 7, 9) for _ in range(12)]
    rows = []
    for p in phrases:
        for _ in range(2):
            rows.append((len(rows), " ".join(word() for _ in range(60)) + f" {' '.join([p] * 70)} " + " ".join(word() for _ in range(60))))
    got = {r.doc_id for r in substring_dedup.find_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i for i, _ in rows}


def test_chunks_hold_words_and_cover_the_text():
    for text in ("", " ", "\n \n", "a", " a", "a ", "a b c d", " a  b\n\nc d e f g h  \n ", "é 🙂 " * 30, "x " * 500):
        d, end, words = substring_dedup.chunks(text)
        assert int(words.sum()) == len(text.split()) and (not text or int(end[-1]) == len(text))
        assert len(d) < 2 or (words >= 1).all()


def brute_repeats(texts, words):
    """Texts with a run of so many words that stands in an earlier text or earlier in the same one."""
    seen, out = set(), set()
    for i, t in sorted(texts):
        w = t.split()
        for k in range(len(w) - words + 1):
            run = tuple(w[k : k + words])
            if run in seen:
                out.add(i)
            seen.add(run)
    return out


def test_all_repeated_runs_of_50_words_on_test_data(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    rows = substring_dedup.find_repeats(docs).collect()
    got = {r.doc_id for r in rows}
    assert brute_repeats(texts, 50) <= got
    assert got <= brute_repeats(texts, 5)
    held = dict(texts)
    joined = lambda i: " ".join(held[i].split())
    for r in rows:  # at least the middle of a passage stands whole in some text
        assert r.n_words >= 20 and r.first_doc_id <= r.doc_id
        run = held[r.doc_id][r.start : r.end].split()
        assert len(run) == r.n_words
        assert r.first_doc_id == r.doc_id or any(" ".join(run[k : k + 5]) in joined(r.first_doc_id) for k in range(len(run) - 4))


def test_rows_that_repeat_an_id_long_texts_and_ties(spark):
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    p, short, long = text(60), text(80), text(40_000)
    rows = [(1, f"{text(30)} {p} {text(30)}"), (2, long), (2, f"{short} {p}"), (3, f"{long} {p}"), (4, short), (4, short), (None, p)]
    got = substring_dedup.find_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    texts = {i: [t for j, t in rows if j == i] for i, _ in rows}
    assert {r.doc_id for r in got} == {2, 3, 4}
    for r in got:  # each passage is text of a row with that id, and stands in a row of the first
        assert any(t[r.start : r.end].strip() and any(t[r.start : r.end].strip() in f for f in texts[r.first_doc_id]) for t in texts[r.doc_id])
    left = sorted((r.doc_id or 0, len(r.text.split())) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect())
    assert len(left) == len(rows) and (2, 40_000) in left and (0, 60) in left and [n for i, n in left if i == 3][0] < 100


def test_units_are_gone_once_they_have_met(spark):
    from canonry.plans.scratch import shared_dir

    folder = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    before = set(glob.glob(f"{folder}/*"))
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, "a b c " + text)], "doc_id long, text string")
    assert [r.first_doc_id for r in substring_dedup.find_repeats(docs).collect()] == [1]
    assert {f.rsplit("/", 1)[1].split("-")[0] for f in set(glob.glob(f"{folder}/*")) - before} == {"hits"}
