"""Passages that repeat across or within documents, by content-defined chunks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canonry.llm.common import small_batches, text_hash
from canonry.plans.scratch import cut, discard

#: A chunk ends after a word whose gear hash is the least of some WINDOW neighbouring words, so it has WINDOW words at most.
WINDOW = 4
#: A unit has two chunks at least and as many as it takes to UNIT_WORDS. A passage has at least so many words.
UNIT_WORDS, PASSAGE_WORDS = 5, 20


def _gear() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(27)) >> np.uint64(3)).astype(np.uint32)


GEAR = _gear()


def chunk_ends(data: np.ndarray) -> np.ndarray:
    """Where chunks of these bytes end (the last end is the length); each chunk has a word, unless there is none at all.

    The gear hash of position i is the sum of GEAR[byte] << distance over the last 32 bytes, formed by doubling. Of every
    WINDOW neighbouring words the last of those with the least hash ends a chunk, so an end depends on the WINDOW - 1
    words on either side and the 32 bytes before them, and no more than WINDOW words are without an end.
    """
    n = len(data)
    if not n:
        return np.empty(0, np.int64)
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        if n > k:
            h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    space = (data == 32) | ((data >= 9) & (data <= 13))
    (after,) = np.nonzero(space[1:] & ~space[:-1])
    after += 1
    key = h[after]
    count = len(after) - WINDOW + 1
    if count < 1:
        return np.array([n])
    least, at = key[:count].copy(), np.arange(count)
    for k in range(1, WINDOW):
        lower = key[k : k + count] <= least
        at[lower] = np.nonzero(lower)[0] + k
        least = np.minimum(least, key[k : k + count])
    taken = np.zeros(len(after), bool)
    taken[at] = True
    ends = after[taken] + 1
    if not space[ends[-1] :].all():
        return np.append(ends, n)
    ends[-1] = n
    return ends


def chunks(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digest, end in code points, words) of every chunk of a text. White space around a chunk is not part of its digest."""
    import xxhash

    raw = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    ends = chunk_ends(data)
    if not len(ends):
        return np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    first = ~space & np.concatenate([[True], space[:-1]])
    words = np.cumsum(first)[ends - 1]
    chars = np.cumsum((data & 0xC0) != 0x80)[ends - 1]
    digest = xxhash.xxh3_64_intdigest
    e = ends.tolist()
    d = np.array([digest(raw[a:b].strip()) for a, b in zip([0, *e], e)], np.uint64)
    return d, chars.astype(np.int32), np.diff(words, prepend=0).astype(np.int32)


def unit_ends(words: np.ndarray) -> np.ndarray:
    """For each chunk the end (last chunk + 1) of the unit that starts with it; 0 if the text ends before the unit does."""
    upto = np.cumsum(words)
    end = np.maximum(np.searchsorted(upto, upto - words + UNIT_WORDS) + 1, np.arange(len(words)) + 2)
    end[end > len(words)] = 0
    if len(words) == 1 and words[0] >= UNIT_WORDS:
        end[0] = 1
    return end


def units(d: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(digest, first chunk) of every unit: a chunk and the next ones, two at least, until there are UNIT_WORDS.

    The first chunks are 0, 1, 2 and so on, up to where too few words are left. A text of one chunk is one unit.
    """
    end = unit_ends(words)
    (at,) = np.nonzero(end)
    x = d[at].astype(np.uint64)
    left = end[at] - at - 1
    for k in range(1, int(left.max(initial=0)) + 1):
        (more,) = np.nonzero(left >= k)
        y = x[more] * np.uint64(0x9E3779B97F4A7C15) + d[at[more] + k]
        y = (y ^ (y >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x[more] = y ^ (y >> np.uint64(32))
    return x, at


def runs(repeated: dict[int, int], words: np.ndarray, least: int = PASSAGE_WORDS) -> Iterator[tuple[int, int, int, int]]:
    """(first chunk, last chunk + 1, words, source) of runs of repeated units."""
    at, ends = sorted(repeated), unit_ends(words)
    k = 0
    while k < len(at):
        a = b = at[k]
        while k + 1 < len(at) and at[k + 1] == b + 1:
            k += 1
            b = at[k]
        end = int(ends[b])
        if (n := int(words[a:end].sum())) >= least:
            yield a, end, n, Counter(repeated[i] for i in range(a, b + 1)).most_common(1)[0][0]
        k += 1


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = PASSAGE_WORDS) -> DataFrame:
    """Passages that stand elsewhere first: doc_id, start, end (code points), n_words, first_doc_id.

    The occurrence with the smallest (doc_id, text's hash, position) is the one to keep and is not returned; all later
    ones are, also in the same document. A passage is a run of repeated units of at least `least` words; it is found to
    within the chunks at its two ends. Null and empty texts have no passage. A null doc_id takes no part. Rows that
    repeat a doc_id with equal text are one document, with different texts they are several. Other
    columns are ignored; no rows give no rows. Units are dealt out once, for the count and the join; the
    rows of a unit that very many documents share go to one task, which streams them. A document's own units are all that
    is ever gathered.
    """
    return _repeats(docs, id_col, text_col, least).drop("th")


def _repeats(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = []
            for text in b.column(1).to_pylist():
                d, _, w = chunks(text)
                u.append(units(d, w)[0].view(np.int64))
            yield pa.RecordBatch.from_pydict({"doc": b.column(0), "th": b.column(2), "unit": pa.array(u, pa.list_(pa.int64()))})

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, words = [], []
            for text in b.column(1).to_pylist():
                _, c, w = chunks(text)
                sizes.append(np.diff(c, prepend=0).astype(np.int32).tobytes())
                words.append(w.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_pydict({"doc": b.column(0), "th": b.column(2), "sizes": pa.array(sizes, pa.binary()), "words": pa.array(words, pa.binary())})

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                words, ends = np.frombuffer(r["words"], np.uint8).astype(np.int32), np.cumsum(np.frombuffer(r["sizes"], np.int32))
                for a, e, n, src in runs({h["pos"]: h["first"] for h in r["hits"]}, words, least):
                    out.append((r["doc"], r["th"], int(ends[a - 1]) if a else 0, int(ends[e - 1]), n, src))
            cols = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in zip(("doc_id", "th", "start", "end", "n_words", "first_doc_id"), cols)})

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"), text_hash(text_col).alias("th")).where("doc is not null and text is not null and text <> ''")
    table = cut(rows.mapInArrow(chunked, "doc long, th long, unit array<long>"), "units")
    each = table.select("doc", "th", F.posexplode("unit").alias("pos", "unit")).where("doc is not null and pos is not null and unit is not null").repartition("unit")
    firsts = each.groupBy("unit").agg(F.count("*").alias("n"), F.min(F.struct("doc", "th", "pos")).alias("at")).where("n > 1").select("unit", "at")
    hits = cut(each.join(firsts, "unit").where("doc <> at.doc or th <> at.th or pos <> at.pos").groupBy("doc", "th").agg(F.collect_set(F.struct("pos", F.col("at.doc").alias("first"))).alias("hits")), "hits")
    discard(table)  # the chunks of documents with hits are formed anew rather than kept beside the units
    own = rows.mapInArrow(sized, "doc long, th long, sizes binary, words binary").join(hits.select("doc", "th"), ["doc", "th"], "left_semi").dropDuplicates(["doc", "th"])
    found = hits.join(own, ["doc", "th"]).select("doc", "th", "hits", "sizes", "words")
    return found.mapInArrow(passages, "doc_id long, th long, start long, end long, n_words long, first_doc_id long")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = PASSAGE_WORDS) -> DataFrame:
    """docs with later occurrences of repeated passages cut out of the text; all rows and columns stay.

    Each row by its own text, so ids may repeat; rows without an id keep their text.
    """
    spans = _repeats(docs, id_col, text_col, least).groupBy(F.col("doc_id").alias("__doc"), F.col("th").alias("__th")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__spans"))
    parts = F.transform(F.col("__spans"), lambda s, i: F.substring(F.col(text_col), (F.when(i == 0, F.lit(0)).otherwise(F.element_at("__spans", i).getField("end")) + 1).cast("int"), (s["start"] - F.when(i == 0, F.lit(0)).otherwise(F.element_at("__spans", i).getField("end"))).cast("int")))
    rest = F.substring(F.col(text_col), (F.element_at("__spans", -1).getField("end") + 1).cast("int"), F.length(text_col))
    joined = docs.withColumn("__own", text_hash(text_col)).join(spans, (docs[id_col] == spans["__doc"]) & (F.col("__own") == spans["__th"]), "left")
    text = F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(F.concat(F.array_join(parts, ""), rest))
    return joined.withColumn(text_col, text).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
