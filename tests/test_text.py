"""Tokens of any length in full."""

from pyspark.sql import functions as F

from canonry.functions import text as T
from canonry.operators.similarity import weighted_jaccard

LONG = "".join(chr(0x4E00 + 7 * i) for i in range(90))


def frame(spark, rows):
    return spark.createDataFrame([("a", "c", v, n) for v, n in rows], "attr string, con string, value string, freq long")


def test_pieces_of_long_tokens(spark):
    a, b = LONG, LONG[:80] + "x" * 10
    got = {(r.value, r.piece): r.cnt for r in T.char_pieces(frame(spark, [(a, 2), (b, 1)])).collect()}
    want = {}
    for v, n in ((a, 2), (b, 1)):
        for i in range(len(v)):
            for j in range(i + 1, len(v) + 1):
                want[v, v[i:j]] = want.get((v, v[i:j]), 0) + n
    assert got == want
    assert weighted_jaccard(T.char_pieces(frame(spark, [(a, 2), (b, 1)]))).first().sim < 1


def test_long_words_contain_themselves_and_others(spark):
    words = [LONG, LONG[20:85], LONG[70:74], "other", "the", "aa", "aaaa"]
    got = sorted((r.word, r.piece) for r in T.contained_words(frame(spark, [(" ".join(words), 1)])).collect())
    assert got == sorted((a, b) for a in words for b in words if b in a)


def test_expansion_of_long_texts(spark):
    text = "y" * 3 + LONG[:70]
    got = spark.createDataFrame([(text,), (LONG * 9,)], "v string").select("v", T.subsequence_expand(F.col("v"), longest=160).alias("x")).collect()
    assert got[0].x.startswith(f"{text}[SEP]{text}") and got[1].x == LONG * 9
