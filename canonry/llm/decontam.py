"""Documents that hold benchmark items, by latent semantic retrieval, common subsequences and answer checks."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canonry.llm.common import giving_back, hash_words, small_batches, text_hash, without_rows
from canonry.plans.scratch import cut

BETWEEN = r"[^\p{L}\p{N}_]+"
BUCKET_BITS, RANK, PASSAGE = 15, 64, 64
BUCKETS, BLOCKS = 1 << BUCKET_BITS, 32
#: A window whose cosine with an item is at least COSINE is a candidate; of the item's words a share of SHARE must
#: follow one another in the text, and ANSWER of its answer's words, or RARE of its rarer half if it names no answer;
#: from VERBATIM on no answer check is needed.
COSINE, SHARE, ANSWER, RARE, VERBATIM = 0.35, 0.65, 0.5, 0.3, 0.9
#: Leading directions, which tell languages and common words apart rather than passages, are left out of the cosine.
LEADING = 4
SEEN_BITS = 1024  # of the presence map of a window's words
LEAST_WORDS = 5  # items of fewer words are matched whole, word after word
SMALLEST_WINDOW = 16
#: Items compared at a time: so many are sent to the executors, however many there are.
ITEM_BLOCK = 20_000
FAN_IN = 64


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of all texts' words, one text after the other, and where each text begins (n + 1 places).

    Words are runs of letters, numbers and low lines, in lower case; null texts have none.
    """
    import xxhash

    return hash_words(texts, BETWEEN, pc.utf8_lower, xxhash.xxh32_intdigest, np.uint32)


def words_of(text: str | None) -> np.ndarray:
    return word_hashes(pa.array([text], pa.string()))[0]


def hashed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, th, words): the 32-bit hashes of each text's words, in order, as bytes. Written once for all passes."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, at = word_hashes(b.column(2))
            words = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((4 * at).astype(np.int32)), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_pydict({"doc": b.column(0), "th": b.column(1), "words": words})

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), text_hash(text_col).alias("th"), F.col(text_col).alias("text")).where(F.col(text_col).isNotNull())
    return cut(rows.mapInArrow(giving_back(apply), "doc long, th long, words binary"), "words")


def _slices(column: pa.Array, size: int = 150_000) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Arrays of some documents' words together, of about `size` words, with the first one's place."""
    held, n, first = [], 0, 0
    for i, raw in enumerate(column):
        w = np.frombuffer(raw.as_buffer(), np.uint32)
        held.append(w)
        n += len(w)
        if n >= size:
            yield first, held
            held, n, first = [], 0, i + 1
    if held:
        yield first, held


def _cell_sums(table: np.ndarray, rows: np.ndarray, places: np.ndarray, cells: int, size: int) -> np.ndarray:
    """Sums of table[rows] over cells of `size` places; places without a row count as zero."""
    padded = np.full(cells * size, len(table), np.intp)
    padded[places] = rows
    wide = np.concatenate([table, np.zeros((1, table.shape[1]), np.float32)])
    out = np.empty((cells, table.shape[1]), np.float32)
    grid = padded.reshape(cells, size)
    step = max(1, 16384 // size)
    row = np.empty((min(step, cells), table.shape[1]), np.float32)
    for k in range(0, cells, step):
        part, acc = np.ascontiguousarray(grid[k : k + step].T), out[k : k + step]
        wide.take(part[0], 0, acc, "clip")
        for j in range(1, size):
            acc += wide.take(part[j], 0, row[: len(acc)], "clip")
    return out


def _next_of(sums: np.ndarray, n: np.ndarray, stride: int) -> np.ndarray:
    """sums[i] + sums[i + 1] for every stride-th i of each text, which has n of the rows; the last row of a text with stride 2 may be alone."""
    count = np.maximum(n - 1, np.minimum(n, 1)) if stride == 1 else -(-n // 2)
    inside = stride * (np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count))
    left = np.repeat(np.cumsum(n) - n, count) + inside
    out = sums[left]
    two = inside + 1 < np.repeat(n, count)
    if two.all():
        out += sums[left + 1]
    else:
        out[two] += sums[left[two] + 1]
    return out


def _test_matrix() -> np.ndarray:
    return np.random.default_rng(7).standard_normal((BUCKETS, RANK)).astype(np.float32)


@dataclass
class Space:
    """Latent space: `fold` takes a bucket to its weighted coordinates, so that a passage is the sum over its words."""

    fold: np.ndarray
    idf: np.ndarray


def fit_space(words: DataFrame) -> Space:
    """Randomised SVD of the TF-IDF matrix of all passages (PASSAGE words each, hashed to BUCKETS columns), in one pass.

    With counts N, weights D and A = N D: the pass sums N'N R for a Gaussian R, and the document frequencies. Then
    Y = A'A Q = D (N'N R) for the test matrix Q = R / D, and the Nystroem form Y (Q'Y)^-1 Y' gives the leading
    eigenvectors and eigenvalues of A'A. A task's sums have a fixed size; they are added in rounds of FAN_IN.
    """
    spark = words.sparkSession
    parts = words.rdd.getNumPartitions()
    tasks = max(1, min(parts, max(2 * spark.sparkContext.defaultParallelism, parts // FAN_IN)))
    per = BUCKETS // BLOCKS

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, s, df, n = _test_matrix(), np.zeros((RANK, BUCKETS)), np.zeros(BUCKETS), 0
        for b in batches:
            for _, docs in _slices(b.column(0)):
                sizes = np.array([len(d) for d in docs])
                if not sizes.sum():
                    continue
                bucket = (np.concatenate(docs) >> np.uint32(32 - BUCKET_BITS)).astype(np.uint16)
                count = -(-sizes // PASSAGE)
                n += int(count.sum())
                inside = np.arange(len(bucket)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                passage = np.repeat(np.cumsum(count) - count, sizes) + inside // PASSAGE
                y = _cell_sums(r, bucket, passage * PASSAGE + inside % PASSAGE, int(count.sum()), PASSAGE)
                place, full = bucket.astype(np.intp), np.bincount(passage)
                for j, column in enumerate(np.ascontiguousarray(y.T, np.float64)):
                    s[j] += np.bincount(place, np.repeat(column, full), BUCKETS)
                order = np.argsort(bucket, kind="stable")
                by = bucket[order]
                pair = by.astype(np.int64) << 32 | passage[order]
                df += np.bincount(by[np.concatenate([[True], pair[1:] != pair[:-1]])], minlength=BUCKETS)
        if n:
            part = TaskContext.get().partitionId()
            for k in range(BLOCKS):
                yield pa.RecordBatch.from_pydict({"block": [k], "part": [part], "n": [n], "s": [np.ascontiguousarray(s[:, k * per : (k + 1) * per].T, np.float32).tobytes()], "df": [df[k * per : (k + 1) * per].tobytes()]})

    def add(t: pa.Table) -> pa.Table:
        s = sum(np.frombuffer(x.as_buffer(), np.float32).astype(np.float64) for x in t.column("s"))
        df = sum(np.frombuffer(x.as_buffer(), np.float64) for x in t.column("df"))
        return pa.table({"block": t.column("block")[:1], "part": pa.array([t.column("part")[0].as_py() // FAN_IN]), "n": pa.array([sum(t.column("n").to_pylist())]), "s": [s.astype(np.float32).tobytes()], "df": [df.tobytes()]})

    schema = "block long, part long, n long, s binary, df binary"
    got = words.select("words").coalesce(tasks).mapInArrow(giving_back(sums), schema)
    while tasks > 1:
        got = got.groupBy("block", F.floor(F.col("part") / FAN_IN).alias("g")).applyInArrow(add, schema)
        tasks = -(-tasks // FAN_IN)
    s, df, n = np.zeros((BUCKETS, RANK)), np.zeros(BUCKETS), 0
    for row in got.toArrow().to_pylist():
        at = slice(row["block"] * per, (row["block"] + 1) * per)
        s[at], df[at], n = np.frombuffer(row["s"], np.float32).reshape(per, RANK), np.frombuffer(row["df"], np.float64), row["n"]
    idf = np.log((n + 1) / (df + 1)) + 1e-3
    r = _test_matrix().astype(np.float64)
    core = r.T @ s
    core = (core + core.T) / 2
    value, vector = np.linalg.eigh(core)
    keep = value > max(1e-9, 1e-7 * value[-1])
    if not n or not keep.any():
        return Space(r.astype(np.float32), idf.astype(np.float32))
    left, single, _ = np.linalg.svd((idf[:, None] * s) @ (vector[:, keep] / np.sqrt(value[keep])), full_matrices=False)
    fold = idf[:, None] * left / np.maximum(single, 1e-6 * single[0])
    if fold.shape[1] > 2 * LEADING:
        fold[:, :LEADING] = 0
    return Space(fold.astype(np.float32), idf.astype(np.float32))


@dataclass
class Item:
    item_id: int
    words: np.ndarray
    masks: dict[int, int]
    answer: frozenset[int]
    need: float  # so many of the answer's words must be there
    bytes: np.ndarray  # where the presence map tells of each word
    bits: np.ndarray


def make_items(rows: list[tuple[int, str]], space: Space) -> list[Item]:
    """Items with their answers: the words after "answer:", otherwise the half of the words that is rarer."""
    out = []
    for i, text in rows:
        w = words_of(text)
        if not len(w):
            continue
        masks: dict[int, int] = {}
        for k, x in enumerate(w.tolist()):
            masks[x] = masks.get(x, 0) | 1 << k
        told = re.split(r"\banswer\s*:", text.lower())
        if len(told) > 1 and len(words_of(told[-1])):
            answer, part = words_of(told[-1]), ANSWER
        else:
            distinct = np.unique(w)
            answer = distinct[np.argsort(-space.idf[distinct >> np.uint32(32 - BUCKET_BITS)], kind="stable")[: max(1, len(distinct) // 2)]]
            part = RARE
        place = (w % np.uint32(SEEN_BITS)).astype(np.int64)
        own = frozenset(answer.tolist())
        out.append(Item(i, w, masks, own, part * len(own), place >> 3, (128 >> (place & 7)).astype(np.uint8)))
    return out


def common_subsequence(item: Item, words: list[int]) -> int:
    """Length of the longest common subsequence, a step a word with the item's words as bits."""
    full = (1 << len(item.words)) - 1
    v, masks = full, item.masks
    for w in words:
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(item.words) - v.bit_count()


def window_of(n: int) -> int:
    """The window for items of n words: the least power of two that holds them, SMALLEST_WINDOW at least."""
    return max(SMALLEST_WINDOW, 1 << (n - 1).bit_length())


class Finder:
    """Compares all windows of texts with a block of items.

    A window that is near an item by cosine, or holds one of its key words, is looked up in the presence map of its words
    and those around it, which can only say too many of the item's words are there; what passes is compared word by word.
    Key words are so many of the rarest that no text with SHARE of the item's words is without one, whatever stands around.
    """

    def __init__(self, space: Space, items: list[Item]):
        self.fold, self.items = space.fold, items
        self.by: dict[int, tuple[list[int], np.ndarray]] = {}
        for k, it in enumerate(items):
            self.by.setdefault(window_of(len(it.words)), ([], None))[0].append(k)
        for w, (own, _) in self.by.items():
            x = np.stack([self.fold[items[k].words >> np.uint32(32 - BUCKET_BITS)].sum(axis=0) for k in own])
            self.by[w] = (own, self._unit(x))
        self.keys = {w: self._keys(space, own) for w, (own, _) in self.by.items()}
        self.cell = min(self.by, default=SMALLEST_WINDOW) // 2

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-12)[:, None]

    def _keys(self, space: Space, own: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(whether a bucket has a key word, the key words, where each one's items begin, the items' places in own)."""
        word, place = [], []
        for q, k in enumerate(own):
            w = self.items[k].words
            share = SHARE if len(w) >= LEAST_WORDS else 1.0
            rare = np.argsort(-space.idf[w >> np.uint32(32 - BUCKET_BITS)], kind="stable")[: len(w) - math.ceil(share * len(w) - 1e-9) + 1]
            keys = np.unique(w[rare])
            word.append(keys)
            place.append(np.full(len(keys), q, np.int64))
        words, places = np.concatenate(word), np.concatenate(place)
        order = np.argsort(words, kind="stable")
        distinct, begin = np.unique(words[order], return_index=True)
        held = np.zeros(BUCKETS, bool)
        held[distinct >> np.uint32(32 - BUCKET_BITS)] = True
        return held, distinct, np.append(begin, len(words)), places[order]

    def _keyed(self, w: int, flat: np.ndarray, bucket: np.ndarray, inside: np.ndarray, window0: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Item's place << 32 | window, ascending, of the two windows around each key word; a word's place in its text, and its text's first window and number of windows, are given."""
        held, distinct, begin, places = self.keys[w]
        (at,) = np.nonzero(held[bucket])
        k = np.minimum(np.searchsorted(distinct, flat[at]), len(distinct) - 1)
        same = distinct[k] == flat[at]
        at, k = at[same], k[same]
        window = inside[at] // (w // 2)
        both = [(window0[at] + np.clip(window - j, 0, count[at] - 1)) << np.int64(32) | k for j in (0, 1)]
        pair = np.unique(np.concatenate(both))
        window, k = pair >> np.int64(32), pair & 0xFFFFFFFF
        n = begin[k + 1] - begin[k]
        item = places[np.repeat(begin[k] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
        return np.unique(item << np.int64(32) | np.repeat(window, n))

    def find(self, docs: list[np.ndarray]) -> list[tuple[int, int, int, int, float, float]]:
        """(document's index, item_id, first word, last word + 1, share of the item, cosine), the best window of each pair."""
        sizes = np.array([len(d) for d in docs])
        if not sizes.sum() or not self.items:
            return []
        flat, c = np.concatenate(docs), self.cell
        first = np.cumsum(sizes) - sizes
        cells = -(-sizes // c)
        cell0 = np.cumsum(cells) - cells
        inside = np.arange(int(cells.sum())) - np.repeat(cell0, cells)
        starts = np.repeat(first, cells) + inside * c
        own_place = np.arange(len(flat)) - np.repeat(first, sizes)
        place = np.repeat(cell0 * c, sizes) + own_place
        bucket = flat >> np.uint32(32 - BUCKET_BITS)
        sums = _cell_sums(self.fold, bucket, place, len(starts), c)
        half, span, halves = sums, 1, cells  # sums of `span` cells
        present = np.zeros((len(sums) + 1, SEEN_BITS), bool)
        present[np.repeat(np.arange(len(sums)), np.minimum(c, np.repeat(first + sizes, cells) - starts)), flat % np.uint32(SEEN_BITS)] = True
        around, reach = np.packbits(present, axis=1), 1  # of `reach` cells from each cell on
        best: dict[tuple[int, int], tuple] = {}
        for w, (own, unit) in sorted(self.by.items()):
            step = w // 2 // c
            while reach < 4 * step:
                around[: max(0, len(around) - reach)] |= around[reach:].copy()
                reach *= 2
            count = np.where(cells > 0, np.maximum(1, -(-cells // step) - 1), 0)
            doc = np.repeat(np.arange(len(docs)), count)
            a = cell0[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * step
            while span < step:
                half, span, halves = _next_of(half, halves, 2), 2 * span, -(-halves // 2)
            x = self._unit(_next_of(half, halves, 1))
            seen = around[np.maximum(a - step, 0)]
            keyed = self._keyed(w, flat, bucket, own_place, np.repeat(np.cumsum(count) - count, sizes), np.repeat(count, sizes))
            for k in range(0, len(x), 16384):
                cosine = unit @ x[k : k + 16384].T
                near = cosine >= COSINE
                part = keyed[(keyed & 0xFFFFFFFF) // 16384 == k // 16384]
                near[part >> np.int64(32), (part & 0xFFFFFFFF) - k] = True
                for q, row in enumerate(cosine):
                    (p,) = np.nonzero(near[q])
                    if not len(p):
                        continue
                    item = self.items[own[q]]
                    shared = (seen[(p + k)[:, None], item.bytes[None, :]] & item.bits[None, :]) != 0
                    for i in p[shared.sum(axis=1) >= SHARE * len(item.words)].tolist():
                        self._check(best, docs, int(doc[k + i]), (int(a[k + i]) - int(cell0[doc[k + i]])) * c, w, item, float(row[i]))
        return [(d, i, *v) for (d, i), v in best.items()]

    def _check(self, best: dict, docs: list[np.ndarray], d: int, at: int, w: int, item: Item, cosine: float) -> None:
        a = max(0, at - w // 2)
        words = docs[d][a : at + w + w // 2].tolist()
        n = len(item.words)
        if n < LEAST_WORDS:
            whole = item.words.tolist()
            for k in range(len(words) - n + 1):
                if words[k : k + n] == whole:
                    best.setdefault((d, item.item_id), (a + k, a + k + n, 1.0, cosine))
                    return
            return
        have = set(words)
        if sum(m.bit_count() for x, m in item.masks.items() if x in have) < SHARE * n:
            return
        common = common_subsequence(item, words)
        share = common / n
        if share < SHARE:
            return
        if share < VERBATIM and len(item.answer & have) < item.need:
            return
        key = (d, item.item_id)
        if key not in best or share > best[key][2]:
            places = [k for k, x in enumerate(words) if x in item.masks]
            best[key] = (a + places[0], a + places[-1] + 1, share, cosine)


def _search(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """(doc_id, th, item_id, first_word, last_word, share, cosine) of every row, those without an id too."""
    spark = docs.sparkSession
    small_batches(spark)
    words = hashed(docs, id_col, text_col)
    space = fit_space(words)
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).alias("t")).where("i is not null and t is not null")
    blocks = max(1, -(-items.count() // ITEM_BLOCK))
    out = None
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k) if blocks > 1 else items
        sent = spark.sparkContext.broadcast((space, make_items([(r.i, r.t) for r in part.collect()], space)))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            finder = Finder(*sent.value)
            for b in batches:
                for first, some in _slices(b.column(2)):
                    rows = finder.find(some)
                    cols = list(zip(*rows)) or [[]] * 6
                    at = pa.array(np.array(cols[0], np.int64) + first)
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": b.column(0).take(at), "th": b.column(1).take(at), "item_id": pa.array(cols[1], pa.int64()), "first_word": pa.array(cols[2], pa.int64()),
                        "last_word": pa.array(cols[3], pa.int64()), "share": pa.array(cols[4], pa.float64()), "cosine": pa.array(cols[5], pa.float64()),
                    })

        found = words.mapInArrow(giving_back(search), "doc_id long, th long, item_id long, first_word long, last_word long, share double, cosine double")
        out = found if out is None else out.unionByName(found)
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Pairs of a document and an item that it holds: doc_id, item_id, first_word, last_word, share, cosine.

    Every window of every whole text meets every item. A pair is there once, with its best window (of equal ones the
    first); share is the part of the item's words that the text has in order, items of fewer than LEAST_WORDS words
    stand in the text word after word. Null or wordless texts and items, and null ids, give no pair. A
    repeated doc_id gives a pair for each row that holds the item. Other columns are ignored; without documents or
    items there are no rows. Items come to the driver in blocks of ITEM_BLOCK, a block is sent to the executors and
    takes one pass over the words; the latent space has a fixed size.
    """
    return _search(docs, benchmark, id_col, text_col, item_col, item_text_col).where("doc_id is not null").drop("th")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs, all columns, whose text holds no benchmark item; each row by its own text, with or without an id."""
    found = _search(docs, benchmark, id_col, text_col, "item_id", "text")
    return without_rows(docs, cut(found.select(F.col("doc_id").alias("id"), "th").distinct(), "leaks"), id_col, text_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return find_leaks(docs, items)
