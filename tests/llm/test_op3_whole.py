"""Items are found whatever stands around them."""

import numpy as np

from canonry.llm import decontam
from tests.conftest import DATA


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_items_in_repetitive_and_clean_surroundings():
    rng = np.random.default_rng(8)
    fold = rng.standard_normal((decontam.BUCKETS, 60)).astype(np.float32)
    space = decontam.Space(fold, np.ones(decontam.BUCKETS))
    word = lambda: f"w{rng.integers(0, 5000)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate(np.repeat([3, 5, 17, 18, 20, 33, 40, 60], 12))]
    finder = decontam.Finder(space, decontam.make_items(items, space))
    texts, want = [], []
    for i, t in items:
        w = t.split()
        kept = {j for j in range(len(w)) if j % 4}
        for version in (w, [x if j in kept else "zz" for j, x in enumerate(w)]):
            for around in (["junk"] * 90, [word() for _ in range(90)], ["a", "b"] * 45):
                cut = int(rng.integers(0, 90))
                texts.append([*around[:cut], *version, *around[cut:]])
                n, told = len(w), set(texts[-1])
                share = lcs(w, texts[-1]) / n
                item = decontam.make_items([(i, t)], space)[0]
                held = len(item.answer & set(decontam.words_of(" ".join(sorted(told))).tolist())) >= item.need
                whole = any(texts[-1][j : j + n] == w for j in range(len(texts[-1])))
                if whole if n < decontam.LEAST_WORDS else share >= decontam.SHARE and (share >= decontam.VERBATIM or held):
                    want.append((len(texts) - 1, i))
    got = {(d, i) for d, i, *_ in finder.find([decontam.words_of(" ".join(t)) for t in texts])}
    assert len(want) > 400
    assert not [p for p in want if p not in got]


def test_short_items_stand_word_after_word():
    space = decontam.Space(np.random.default_rng(1).standard_normal((decontam.BUCKETS, 60)).astype(np.float32), np.ones(decontam.BUCKETS))
    finder = decontam.Finder(space, decontam.make_items([(1, "red blue green")], space))
    texts = ["x red a1 a2 blue a3 a4 a5 green y", "so red blue green it is", "red blue", "Red, blue; GREEN!"]
    assert {d for d, *_ in finder.find([decontam.words_of(t) for t in texts])} == {1, 3}


def test_paraphrases_long_texts_ties_and_repeated_rows(spark):
    """Of items with up to 30 % of their words changed at least 0.9 are found, in clean and in very long texts."""
    import pyarrow.parquet as pq

    rng = np.random.default_rng(9)
    items = pq.read_table(f"{DATA}/sf0.1/benchmark.parquet").to_pylist()[:120]
    own = [(x["item_id"], x["text"]) for x in items]
    clean = " ".join(f"c{x}" for x in rng.integers(0, 3000, 150))
    rows, want = [], {}
    for share in (0.0, 0.1, 0.2, 0.3):
        for i, t in own:
            w = t.split()
            for j in rng.choice(len(w), int(share * len(w)), replace=False):
                w[j] = f"z{rng.integers(0, 900)}"
            want.setdefault(share, set()).add((len(rows), i))
            rows.append((len(rows), f"{clean} {' '.join(w)} {clean}"))
    long = len(rows)
    rows.append((long, " ".join([clean] * 300 + [own[0][1]] + [clean] * 300)))
    rows += [(long + 1, own[1][1])] * 2 + [(long + 1, clean), (None, own[2][1]), (long + 2, f"{own[3][1]} {clean} {own[3][1]}")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(i, t, "d") for i, t in own], "item_id long, text string, doc_id string")
    got = [(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, bench).collect()]
    for share, pairs in want.items():
        found = len(pairs & set(got)) / len(pairs)
        assert found >= (1 if share == 0 else 0.9), (share, found)
    assert (long, own[0][0]) in got and got.count((long + 1, own[1][0])) == 2 and got.count((long + 2, own[3][0])) == 1
    kept = [r.doc_id for r in decontam.drop_leaks(docs, bench).collect()]
    assert kept == [long + 1]


def test_each_distinct_piece_is_lowered_and_split_once():
    """The pattern of what parts words meets pieces between spaces, each of a batch once, and finds the words it finds in whole texts."""
    import re

    import pyarrow as pa
    import pyarrow.compute as pc
    import xxhash

    from canonry.llm.common import hash_words

    met = []
    texts = ["Red, blue;GREEN! red\tBlue_1 ", None, "", "  ", "ÀÉ中文。字 x-y z"] + ["word other-word again"] * 500
    flat, at = hash_words(pa.array(texts), decontam.BETWEEN, lambda t: pc.utf8_lower(met.append(t) or t), xxhash.xxh32_intdigest, np.uint32)
    for i, t in enumerate(texts):
        assert flat[at[i] : at[i + 1]].tolist() == [xxhash.xxh32_intdigest(w) for w in re.findall(r"\w+", (t or "").lower())], t
    assert sum(map(len, met)) < 20
