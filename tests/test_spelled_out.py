import random

from pyspark.sql import functions as F

from canonry.functions import text as T


def plain(text, mode, longest):
    known = lambda c: "一" <= c <= "鿿" or "㐀" <= c <= "䶿" or " " <= c <= "\x7f"
    runs = "".join(c if known(c) else "\0" for c in text).split("\0")
    runs = [r for r in runs if r]
    if not runs:
        return (text + "[SEP]" + text if len(text) + 1 <= longest else text) if mode == "l2s" else text
    top = max(map(len, runs))
    out = [] if mode == "l2s" and text in runs else list(text)
    for n in range(top, 0, -1) if mode == "l2s" else range(1, top):
        for r in runs:
            for i in range(len(r) - n + 1):
                piece = list(r[i : i + n])
                if len(out) + n <= longest:
                    out = out + ["[SEP]"] + piece if mode == "l2s" else piece + ["[SEP]"] + out
    return "".join(out)


def test_spelled_out_equals_plain_python(spark):
    draw = random.Random(1)
    texts = ["", "abc", "é", "éa", "a中é文b", "aa", "x" * 30, "中文" * 40] + ["".join(draw.choice("ab 中文é😀") for _ in range(draw.randint(0, 14))) for _ in range(60)]
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "v string")
    for mode in ("l2s", "s2l"):
        for longest in (12, 60, 509):
            got = {r.v: r.x for r in rows.select("v", T.spelled_out(F.col("v"), mode, longest).alias("x")).collect()}
            assert got == {t: plain(t, mode, longest) for t in texts} | {None: None}
    assert plain("abc", "l2s", 509) == "[SEP]abc[SEP]ab[SEP]bc[SEP]a[SEP]b[SEP]c"
    assert plain("abc", "s2l", 509) == "bc[SEP]ab[SEP]c[SEP]b[SEP]a[SEP]abc"


def test_completion_answers_are_taken_as_spelled(spark):
    text = "Input:\na\nb\nOutput: {}\nInput:\nc\nd\nOutput: no"
    rows = spark.createDataFrame([(text.format(x),) for x in ("yes", "Yes", "no", "NO", "maybe")] + [("Output: yes",)], "t string")
    got = [r.x for r in rows.select(T.parse_completion(F.col("t"), F.lit("a"), F.lit("b")).alias("x")).collect()]
    assert got == ["yes", "unsure", "no", "unsure", "unsure", "unknow"]
