"""Toxicity of texts: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canonry.llm.common import crc_mod, giving_back, hash_words, small_batches

BETWEEN = r"[^\p{L}\p{N}]+"
BITS = 22
ALPHA, BETA, L1, L2, PASSES = 3.0, 1.0, 4.0, 0.1, 4
#: At most about so many labelled rows of each class are learned from, chosen by a hash of their ids.
TRAIN_TOXIC, TRAIN_CLEAN = 5000, 9000
THRESHOLD = 0.7
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9)


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text's index) of every feature occurrence, one kind of feature at a time.

    Features are words, pairs and triples of neighbours, and pairs with one or two words left out, hashed.
    """
    import xxhash

    h, at = hash_words(texts, BETWEEN, pc.utf8_lower, xxhash.xxh3_64_intdigest, np.uint64)
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    bucket = lambda x: ((x ^ (x >> np.uint64(31))) * _C >> np.uint64(64 - BITS)).astype(np.int64)
    yield bucket(h * _A), doc
    for kind, gap in ((1, 1), (2, 2), (3, 3)):
        x = h[:-gap] * _A + (h[gap:] ^ np.uint64(kind)) * _B
        ok = doc[:-gap] == doc[gap:]
        yield bucket(x[ok]), doc[gap:][ok]
    x = (h[:-2] * _A + h[1:-1]) * _A + h[2:] * _B
    ok = doc[:-2] == doc[2:]
    yield bucket(x[ok]), doc[2:][ok]


def _some(texts: pa.Array, most: int = 250, size: int = 1 << 20) -> Iterator[tuple[int, pa.Array]]:
    """Neighbouring texts, of about `size` bytes together, with the first one's place."""
    upto, k = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy()), 0
    while k < len(texts):
        e = min(k + most, max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + size))))
        yield k, texts.slice(k, e - k)
        k = e


@dataclass
class Weights:
    """The weights that are not zero, the bias, and the margin of a text without a word."""

    index: np.ndarray
    value: np.ndarray
    bias: float
    prior: float = -3.0


def ftrl(rows: list[tuple[np.ndarray, int]], passes: int = PASSES) -> Weights:
    """FTRL-proximal with a learning rate for each coordinate; features are present or absent.

    Rows (distinct buckets, label) are taken in the given order, `passes` times. Without rows of both classes the
    weights are zero and the bias is the smoothed share of label 1.
    """
    ones = sum(y for _, y in rows)
    start = float(np.log((ones + 0.5) / (len(rows) - ones + 0.5))) if rows else -3.0
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias, bias_n = start, 1.0
    if ones and ones < len(rows):
        for _ in range(passes):
            for k, y in rows:
                zk, nk = z[k], n[k]
                root = np.sqrt(nk)
                w = np.where(np.abs(zk) <= L1, 0.0, -(zk - np.sign(zk) * L1) / ((BETA + root) / ALPHA + L2))
                p = 1 / (1 + np.exp(-max(-35.0, min(35.0, w.sum() + bias))))
                g = p - y
                z[k] = zk + g - (np.sqrt(nk + g * g) - root) / ALPHA * w
                n[k] = nk + g * g
                bias_n += g * g
                bias -= 0.1 * g / np.sqrt(bias_n)
    (k,) = np.nonzero(np.abs(z) > L1)
    return Weights(k, (-(z[k] - np.sign(z[k]) * L1) / ((BETA + np.sqrt(n[k])) / ALPHA + L2)).astype(np.float32), float(bias))


def calibrated(rows: list[tuple[np.ndarray, int]]) -> Weights:
    """FTRL on all rows, its margins stretched and moved as suits the last fifth best for a model of the rest.

    L1 draws scores towards the bias, the more the fewer rows there are. With under ten rows of a class in that fifth
    nothing is changed.
    """
    w, k = ftrl(rows), len(rows) * 4 // 5
    y = np.array([x for _, x in rows[k:]])
    if min(y.sum(), (1 - y).sum()) < 10:
        return w
    part, dense = ftrl(rows[:k]), np.zeros(1 << BITS)
    dense[part.index] = part.value
    z = np.array([dense[f].sum() for f, _ in rows[k:]]) + part.bias
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton's method; the stretch is held near 1 by a small penalty
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -35, 35)))
        h = p * (1 - p) + 1e-6
        step = np.linalg.solve([[(h * z * z).sum() + 0.1, (h * z).sum()], [(h * z).sum(), h.sum()]], [((p - y) * z).sum() + 0.1 * (a - 1), (p - y).sum()])
        a, b = a - step[0], b - step[1]
    if not 0.2 < a < 5 or abs(b) > 6:
        return w
    return Weights(w.index, (a * w.value).astype(np.float32), float(a * w.bias + b))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic: int = TRAIN_TOXIC, clean: int = TRAIN_CLEAN) -> Weights:
    """Learn from the documents that labels marks 0 or 1 (other labels and null ids are ignored).

    The sample is bounded by `toxic` and `clean`, so one task learns from it, in order of a hash of the id; a document labelled twice
    counts twice. Where the classes are sampled at different rates, the bias is set right by the log of their ratio. Only
    weights that are not zero come back to the driver.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = labels.select(F.col(id_col).cast("long").alias("i"), F.col(label_col).cast("int").alias("y")).where("i is not null and y in (0, 1)")
    n = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    part = F.shiftrightunsigned(F.xxhash64("i"), 11) / float(1 << 53)
    rate = {y: min(1.0, most / max(1, n.get(y, 0))) for y, most in ((1, toxic), (0, clean))}
    shift = float(np.log(rate[0] / rate[1]))
    sample = own.where(part < F.when(F.col("y") == 1, rate[1]).otherwise(rate[0]))
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).join(F.broadcast(sample), "i").select("i", "y", "t")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            ids, ys = b.column(0).to_pylist(), b.column(1).to_pylist()
            for k, texts in _some(b.column(2)):
                feature, doc = (np.concatenate(x) for x in zip(*features(texts)))
                pairs = np.unique(doc << np.int64(BITS) | feature)
                at = np.searchsorted(pairs >> np.int64(BITS), np.arange(len(texts) + 1))
                low = (pairs & ((1 << BITS) - 1)).astype(np.int32)
                held += [(i, y, low[a:e]) for i, y, a, e in zip(ids[k:], ys[k:], at, at[1:])]
        held.sort(key=lambda x: (x[0] * 0x9E3779B97F4A7C15 % (1 << 64), x[0], x[1]))
        w = calibrated([(f, y) for _, y, f in held])
        yield pa.RecordBatch.from_pydict({"k": pa.array(np.append(w.index, -1), pa.int64()), "w": pa.array(np.append(w.value.astype(np.float64), w.bias))})

    got = rows.repartition(1).mapInArrow(giving_back(learn), "k long, w double").toArrow()
    k, w = got.column("k").to_numpy(), got.column("w").to_numpy()
    prior = float(np.log((n.get(1, 0) + 0.5) / (n.get(0, 0) + 0.5))) if n else -3.0
    return Weights(k[k >= 0], w[k >= 0].astype(np.float32), float(w[k < 0][0]) + shift if (k < 0).any() else -3.0, prior)


class Scorer:
    """Probabilities of texts; a feature counts once however often it occurs."""

    def __init__(self, w: Weights):
        self.dense, self.w = np.zeros(1 << BITS, np.float32), w
        self.dense[w.index] = w.value

    def __call__(self, texts: pa.Array) -> np.ndarray:
        total = np.full(len(texts), self.w.prior)
        for k, some in _some(texts):
            kept = []
            for feature, doc in features(some):
                total[k + np.unique(doc)] = self.w.bias
                (at,) = np.nonzero(self.dense[feature])
                kept.append(doc[at] << np.int64(BITS) | feature[at])
            pairs = np.unique(np.concatenate(kept))
            total[k : k + len(some)] += np.bincount(pairs >> np.int64(BITS), self.dense[pairs & ((1 << BITS) - 1)], len(some))
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def score(docs: DataFrame, weights: Weights, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and predicted (1 from THRESHOLD on) of every row's whole text.

    A text without a word (null and empty ones too) has the share of label 1 among the labelled rows as its score. A feature counts once however often it occurs.
    Repeated and null ids keep their rows; no rows give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(weights)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for b in batches:
            p = scorer(b.column(1))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "score": pa.array(p), "predicted": pa.array((p >= THRESHOLD).astype(np.int32))})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(giving_back(apply), "doc_id long, score double, predicted int")


def train_and_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of docs by a model of the labelled rows whose id's crc32 modulo 3 is not 1."""
    return score(docs, fit(docs, labels.where(crc_mod("doc_id", 3) != 1)))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs, all columns, that are not predicted toxic by a model of all labelled rows.

    Each row goes or stays by its own text, whatever its id; nothing is shuffled but the labelled rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col))
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for b in batches:
            yield b.filter(pa.array(scorer(b.column(at)) < THRESHOLD))

    return docs.mapInArrow(giving_back(keep), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return train_and_score(docs, labels).select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
