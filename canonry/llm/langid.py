"""Language of texts and of spans in mixed-language texts."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canonry.llm.common import crc_mod, small_batches

# Blocks of letters by script (first, last code point, script), from the Unicode block table.
SCRIPTS = (
    (0x0041, 0x024F, "Latin"), (0x1E00, 0x1EFF, "Latin"), (0x0370, 0x03FF, "Greek"), (0x1F00, 0x1FFF, "Greek"),
    (0x0400, 0x052F, "Cyrillic"), (0x0530, 0x058F, "Armenian"), (0x0590, 0x05FF, "Hebrew"), (0x0600, 0x077F, "Arabic"),
    (0x0900, 0x097F, "Devanagari"), (0x0980, 0x09FF, "Bengali"), (0x0B80, 0x0BFF, "Tamil"), (0x0E00, 0x0E7F, "Thai"),
    (0x10A0, 0x10FF, "Georgian"), (0x1100, 0x11FF, "Hangul"), (0xAC00, 0xD7AF, "Hangul"), (0x3040, 0x309F, "Kana"),
    (0x30A0, 0x30FF, "Kana"), (0x3400, 0x4DBF, "Han"), (0x4E00, 0x9FFF, "Han"),
)
NAMES = sorted({s for *_, s in SCRIPTS}) + ["Other"]
_STARTS = np.array(sorted(a for a, _, _ in SCRIPTS))
_ENDS = np.array([b for _, b in sorted((a, b) for a, b, _ in SCRIPTS)])
_KIND = np.array([NAMES.index(s) for _, s in sorted((a, s) for a, _, s in SCRIPTS)])

#: Numbers that are neither decimal digits nor letters (fractions, circled and Roman numbers): no part of a word.
NUMBERS = "".join(c for c in map(chr, range(128, sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
WORD = re.compile(r"[^\W\d_]+")
#: Classes up to U+FFFF are looked up at once, others are gone through one by one: so the latter only where they may match.
NUMBER, HIGH_NUMBER = (re.compile(f"[{''.join(c for c in NUMBERS if (c > '\uffff') == high)}]") for high in (False, True))
HIGH = re.compile("[\U00010000-\U0010ffff]")
BUCKETS, LONGEST_GRAM = 1 << 17, 4
#: A word's evidence against a language is at most CLIP; changing the language between two words costs PENALTY.
CLIP, PENALTY = 6.0, 12.0
#: The model is fitted on about so many documents of each language, chosen by a hash of their ids.
TRAIN_DOCS = 4000
REMEMBERED = 300_000
LONGEST_WORD = 64  # letters of a word that its n-grams are taken from come first and last; longer runs are split


def script_of(codes: np.ndarray) -> np.ndarray:
    """Index into NAMES of each code point."""
    k = np.searchsorted(_STARTS, codes, side="right") - 1
    return np.where((k >= 0) & (codes <= _ENDS[k]), _KIND[k], len(NAMES) - 1)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, index of the word) of every n-gram of the words with their ends marked."""
    text = " " + " ".join(words) + " "
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    gap = codes == 32
    owner = np.cumsum(gap) - 1
    owner[gap] = -1
    owner_of_start = np.where(gap, np.cumsum(gap) - 1, owner)  # the gap before a word is its start mark
    buckets, owners = [], []
    h = np.zeros(len(codes), np.uint64)
    inner = np.zeros(len(codes), bool)
    for n in range(1, LONGEST_GRAM + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(n)
        if n > 2:
            inner = inner[:m] | gap[n - 2 : n - 2 + m]  # a gap that is neither first nor last
        else:
            inner = inner[:m]
        ok = ~inner & (owner_of_start[:m] < len(words))
        if n == 1:
            ok &= ~gap[:m]
        if n == 2:
            ok &= ~(gap[:m] & gap[1:])
        mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        buckets.append((mixed[ok] >> np.uint64(64 - 17)).astype(np.int64))
        owners.append(owner_of_start[:m][ok])
    return np.concatenate(buckets), np.concatenate(owners)


def letters_only(text: str) -> str:
    """The text with a space for each of NUMBERS: one pattern for both is several times slower."""
    if text.isascii():
        return text
    text = NUMBER.sub(" ", text)
    return HIGH_NUMBER.sub(" ", text) if HIGH.search(text) else text


def words_of(text: str) -> list[str]:
    words = WORD.findall(letters_only(text))
    if any(len(w) > LONGEST_WORD for w in words):
        words = [w[k : k + LONGEST_WORD] for w in words for k in range(0, len(w), LONGEST_WORD)]
    return words


@dataclass
class Model:
    """log P(n-gram | language) in hashed buckets, and the languages that use each script."""

    langs: list[str]
    table: np.ndarray  # BUCKETS x languages, float32
    allowed: np.ndarray  # scripts x languages, bool
    rows: dict = field(default_factory=dict)
    scores: np.ndarray | None = None

    def word_rows(self, words: list[str]) -> np.ndarray:
        """Rows of self.scores for the words; scores of new words are added."""
        rows = self.rows
        new = [w for w in dict.fromkeys(words) if w not in rows]
        if new:
            if len(rows) + len(new) > REMEMBERED:
                rows.clear()
                new = list(dict.fromkeys(words))
            s = self._score(new)
            base = len(rows)
            if self.scores is None or len(self.scores) < base + len(new):
                grown = np.empty((max(1024, 2 * (base + len(new))), len(self.langs)), np.float32)
                if base:
                    grown[:base] = self.scores[:base]
                self.scores = grown
            self.scores[base : base + len(new)] = s
            rows.update(zip(new, range(base, base + len(new))))
        return np.fromiter(map(rows.__getitem__, words), np.int64, len(words))

    def _score(self, words: list[str]) -> np.ndarray:
        bucket, owner = grams(words)
        out = np.empty((len(words), len(self.langs)), np.float64)
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(owner, self.table[bucket, k], len(words))
        first = script_of(np.array([ord(w[0]) for w in words], np.int64))
        ok = self.allowed[first]
        ok |= ~ok.any(axis=1, keepdims=True)
        out[~ok] = -np.inf
        return np.maximum(out - out.max(axis=1, keepdims=True), -CLIP)

    def path(self, words: list[list[str]]) -> list[np.ndarray]:
        """The best language of every word of each text: Viterbi over all texts at once, step by step."""
        order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        sizes = np.array([len(words[i]) for i in order], np.int64)
        flat = self.word_rows([w for i in order for w in words[i]])
        scores = self.scores[flat] if len(flat) else np.empty((0, len(self.langs)), np.float32)
        at = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        # A word where all texts' best language agrees needs no search: only texts with two winners are searched.
        best = scores.argmax(axis=1).astype(np.int16) if len(flat) else np.empty(0, np.int16)
        came = np.empty(len(flat), np.int16)  # the best language before each word
        moved = np.empty((len(flat), len(self.langs)), bool)
        active = len(order)
        v = np.zeros((0, len(self.langs)), np.float32)
        steps = int(sizes[0]) if len(sizes) else 0
        count = np.searchsorted(-sizes, -np.arange(steps), side="left")  # texts longer than t
        for t in range(steps):
            active = count[t]
            here = at[:active] + t
            if t == 0:
                v = scores[here].copy()
                continue
            v = v[:active]
            top = v.argmax(axis=1)
            high = v[np.arange(active), top][:, None] - PENALTY
            go = high > v
            moved[here], came[here] = go, top
            v = np.where(go, high, v) + scores[here]
            if t % 64 == 0:
                v -= v.max(axis=1, keepdims=True)
            best[here] = v.argmax(axis=1)
        if steps:
            best[at[sizes > 0]] = scores[at[sizes > 0]].argmax(axis=1)
        lang = best[at[: int((sizes > 0).sum())] + sizes[sizes > 0] - 1].copy() if steps else best
        for t in range(steps - 1, -1, -1):
            active = count[t]
            here = at[:active] + t
            last = sizes[:active] - 1 == t
            now = lang[:active]
            now[last] = best[here[last]]
            best[here] = now
            if t:
                lang[:active] = np.where(moved[here, now], came[here], now)
        out: list = [None] * len(words)
        for k, i in enumerate(order):
            out[i] = best[at[k] : at[k] + sizes[k]]
        return out

    def label(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, share of the letters in spans of it) of each text; ("und", 0) without a letter."""
        words = [words_of((t or "").lower()) for t in texts]
        out = []
        for w, p in zip(words, self.path(words)):
            if not w:
                out.append(("und", 0.0))
                continue
            letters = np.bincount(p, np.fromiter(map(len, w), np.int64, len(w)), len(self.langs))
            k = int(letters.argmax())
            out.append((self.langs[k], float(letters[k] / letters.sum())))
        return out

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, end, language) of the spans of a text, by code points; a span ends with its last word."""
        pieces = [(i, min(i + LONGEST_WORD, m.end())) for m in WORD.finditer(letters_only(text or "")) for i in range(m.start(), m.end(), LONGEST_WORD)]
        if not pieces:
            return []
        path = self.path([[text[a:b].lower()[:LONGEST_WORD] for a, b in pieces]])[0]
        out: list[tuple[int, int, str]] = []
        for (a, b), k in zip(pieces, path):
            lang = self.langs[int(k)]
            out[-1:] = [(out[-1][0], b, lang)] if out and out[-1][2] == lang else [*out[-1:], (a, b, lang)]
        return out


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", docs_per_lang: int = TRAIN_DOCS) -> Model:
    """Fit on rows of train with a text and a language.

    About docs_per_lang rows of each language are used, chosen by a hash of the id; every language of train is learned.
    What comes to the driver is at most BUCKETS counts for each language. Empty input gives a model without languages,
    which labels everything "und".
    """
    spark = train.sparkSession
    small_batches(spark)
    rows = train.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where("t is not null and l is not null")
    counts = rows.groupBy("l").agg(F.count("*").alias("n"))
    part = F.shiftrightunsigned(F.xxhash64("i"), 11) / float(1 << 53)
    chosen = rows.join(F.broadcast(counts), "l").where(part * F.col("n") < docs_per_lang).select("t", "l")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            by: dict[str, dict[str, int]] = {}
            for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = by.setdefault(lang, {})
                for w in words_of(t.lower()):
                    own[w] = own.get(w, 0) + 1
            for lang, own in by.items():
                if own:
                    words = list(own)
                    weight = np.fromiter(own.values(), np.float64, len(own))
                    bucket, owner = grams(words)
                    total = sums.setdefault(lang, np.zeros(BUCKETS + len(NAMES)))
                    total[:BUCKETS] += np.bincount(bucket, weight[owner], BUCKETS)
                    total[BUCKETS:] += np.bincount(script_of(np.array([ord(w[0]) for w in words])), weight, len(NAMES))
                else:
                    sums.setdefault(lang, np.zeros(BUCKETS + len(NAMES)))
        for lang, total in sums.items():
            (k,) = np.nonzero(total)
            k = k if len(k) else np.array([0])
            yield pa.RecordBatch.from_pydict({"l": pa.array([lang] * len(k), pa.string()), "k": pa.array(k, pa.int64()), "c": pa.array(total[k].astype(np.int64))})

    got = chosen.mapInArrow(count, "l string, k long, c long").groupBy("l", "k").agg(F.sum("c").alias("c")).toArrow()
    names = got.column("l").to_pylist()
    langs = sorted(set(names))
    place = {x: i for i, x in enumerate(langs)}
    table = np.zeros((BUCKETS + len(NAMES), len(langs)))
    table[got.column("k").to_numpy(), [place[x] for x in names]] = got.column("c").to_numpy()
    scripts = table[BUCKETS:]
    allowed = scripts >= np.maximum(1, 0.01 * scripts.sum(axis=0))
    grams_ = table[:BUCKETS] + 0.1
    return Model(langs, np.log(grams_ / grams_.sum(axis=0)).astype(np.float32), allowed)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = False) -> DataFrame:
    """doc_id, lang_pred, score (and spans: array of start, end, lang) of every row's whole text.

    A null text, and a text without a letter, is "und" with score 0. Ties go to the language whose name is smaller.
    Repeated and null ids keep their rows; other columns are ignored; no rows give no rows. The model's size depends
    on its parameters and the number of languages alone; it is sent once to each executor.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast((model.langs, model.table, model.allowed))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            found = own.label(texts) if own.langs else [("und", 0.0)] * len(texts)
            out = {"doc_id": b.column(0), "lang_pred": pa.array([x for x, _ in found], pa.string()), "score": pa.array([s for _, s in found], pa.float64())}
            if with_spans:
                out["spans"] = pa.array([[{"start": a, "end": e, "lang": x} for a, e, x in own.spans(t)] if own.langs else [] for t in texts], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])))
            yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, lang_pred string, score double" + ", spans array<struct<start: long, end: long, lang: string>>" * with_spans
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(label, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(crc_mod("doc_id", 4) != 2))
    return identify(docs, model).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
