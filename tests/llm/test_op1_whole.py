"""Spans of runs of letters beyond LONGEST_WORD."""

import numpy as np

from canonry.llm import langid


def test_long_runs_can_switch_language(spark):
    rng = np.random.default_rng(9)
    word = lambda letters: "".join(rng.choice(list(letters), 30))
    docs = spark.createDataFrame([(i, " ".join(word(x) for _ in range(20)), lang) for i, (x, lang) in enumerate([("abcdef", "aa"), ("uvwxyz", "bb")] * 20)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    text = "x " + "".join(word("abcdef") for _ in range(13))[:384] + "".join(word("uvwxyz") for _ in range(20))
    spans = model.spans(text)
    assert spans[-2:] == [(spans[-2][0], 386, "aa"), (386, len(text), "bb")]
    assert model.label([text])[0][0] == max(spans, key=lambda s: s[1] - s[0])[2]


def test_texts_without_a_letter_are_undetermined_and_ties_go_by_name(spark):
    docs = spark.createDataFrame([(1, "hello old world", "en"), (2, "hello old world", "aa")], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    odd = ["½ ②", "①", "Ⅷ", "²³", "12 34", "_ _", "٣٤", "", None]
    assert model.label(odd) == [("und", 0.0)] * len(odd)
    rows = spark.createDataFrame([(1, "hello"), (1, "①"), (1, "hello")], "doc_id long, text string")
    assert sorted(tuple(r) for r in langid.identify(rows, model).collect()) == [(1, "aa", 1.0), (1, "aa", 1.0), (1, "und", 0.0)]


def test_words_end_at_numbers_and_are_found_fast():
    import re
    import time

    slow = re.compile(rf"[^\W\d_{langid.NUMBERS}]+")
    text = "maſs ½liter ①eins Ⅷacht x²y 東京三〇 été_année 12ab " + "größere Wörter stehen hier, прямо здесь " * 20000
    began = time.perf_counter()
    want = slow.findall(text)
    middle = time.perf_counter()
    assert langid.words_of(text) == want
    assert time.perf_counter() - middle < 0.7 * (middle - began)
    every = " ".join(f"{chr(c)}x{chr(c)}" for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    assert langid.WORD.findall(langid.letters_only(every)) == slow.findall(every)
