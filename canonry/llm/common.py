"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canonry.plans.scratch import visible_to_workers

#: Upper bounds of an Arrow batch that goes to Python: long texts must not make it large.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: Bits of the maps that tell which rows may be meant: a fixed size whatever the input's. They only spare work: a full
#: map lets everything pass, and joins decide.
MAP_BITS = 1 << 26


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    visible_to_workers(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def giving_back(apply: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`apply`, after which the worker, which is kept for later tasks, gives the memory it has freed back to the host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from apply(batches)
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return run


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def ascii_lower(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hash_words(texts: pa.Array, between: str, lower: Callable, digest: Callable, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words, one text after the other, and where each text begins (n + 1 places).

    `between` is the pattern of what parts words, a space among it; `lower` takes each character by itself; null texts
    have none. Texts are cut at spaces, and each distinct piece of the batch is lowered, split and hashed once.
    """
    pieces = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), " ")
    at = pieces.offsets.to_numpy()
    coded = pieces.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
    of = coded.indices.to_numpy()
    parts = pc.split_pattern_regex(lower(coded.dictionary), between)
    own = parts.offsets.to_numpy()
    told = parts.values.slice(own[0], own[-1] - own[0]).dictionary_encode()
    words = told.dictionary.to_numpy(zero_copy_only=False).tolist()
    index = told.indices.to_numpy()
    keep = pc.not_equal(told.dictionary, "").to_numpy(zero_copy_only=False)[index]
    hashes = np.fromiter(map(digest, words), dtype, len(words))[index[keep]]
    begin = np.concatenate([[0], np.cumsum(keep)])[own - own[0]]
    size = np.diff(begin)[of]
    upto = np.concatenate([[0], np.cumsum(size)])
    return hashes[np.repeat(begin[of] - upto[:-1], size) + np.arange(upto[-1])], upto[at - at[0]]


def bit_map(positions: DataFrame) -> np.ndarray:
    """MAP_BITS bits with those of (p) set, OR-ed by Spark; at most MAP_BITS / 64 rows come back."""
    words = positions.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("b")).toArrow()
    out = np.zeros(MAP_BITS // 64, np.int64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return out.view(np.uint64)


def set_bits(bits: np.ndarray, p: np.ndarray) -> np.ndarray:
    return (bits[p >> 6] >> (p & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def text_hash(text_col: str) -> Column:
    """64 bits of a row's text, which with the id name the row; a null text has its own value."""
    return F.xxhash64(F.col(text_col).isNull(), F.col(text_col))


def split_rows(docs: DataFrame, named: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows of docs that `named` (id, th) surely does not name, and all others with their `__th`; nothing is shuffled.

    Rows are told by a map of bits over hashes of (id, th), of fixed size.
    """
    spark = docs.sparkSession
    small_batches(spark)
    place = lambda i, th: F.xxhash64(i, th).bitwiseAND(F.lit(MAP_BITS - 1))
    sent = spark.sparkContext.broadcast(bit_map(named.select(place(F.col("id").cast("long"), F.col("th")).alias("p"))))

    @F.arrow_udf("boolean")
    def maybe(p: pa.Array) -> pa.Array:
        return pa.array(set_bits(sent.value, p.to_numpy()))

    rows = docs.withColumn("__th", text_hash(text_col)).withColumn("__maybe", maybe(place(F.col(id_col).cast("long"), F.col("__th"))))
    return rows.where("not __maybe").drop("__th", "__maybe"), rows.where("__maybe").drop("__maybe")


def without_rows(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of docs, all columns, that `gone` (id, th) does not name; only texts that may be named are shuffled."""
    rest, some = split_rows(docs, gone, id_col, text_col)
    named = gone.select(F.col("id").cast("long").alias("__gone_id"), F.col("th").alias("__gone_th"))
    left = some.join(named, F.col(id_col).cast("long").eqNullSafe(named["__gone_id"]) & (some["__th"] == named["__gone_th"]), "left_anti")
    return rest.unionByName(left.drop("__th"))
