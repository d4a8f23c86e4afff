"""Packing of documents into sequences by bounded-space best fit."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canonry.llm.common import giving_back, small_batches
from canonry.llm.tokens import default_vocabulary, encoder
from canonry.plans.scratch import cut

LENGTH, OPEN_WINDOWS, MERGE_FAN_IN = 1024, 16, 64
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
LEFT = f"{PIECE}, ids binary, leftover boolean"
#: Sequence ids of a partition begin at its number times this; merge rounds take ranges above those of the partitions.
IDS_A_TASK, IDS_A_ROUND = 1 << 36, 1 << 60


class Packer:
    """At most `windows` open windows of `length` tokens.

    A piece goes to the open window that it fills best. When it fits none and all windows are open, the fullest
    window is filled up by cutting the piece and emitted; what is cut off is placed again. Pieces that fill a window
    alone are emitted at once. A window is (tokens held, list of pieces). A piece is (doc_id, start, its ids as a view
    of little-endian unsigned 32-bit numbers, doc_tokens).
    """

    def __init__(self, length: int = LENGTH, windows: int = OPEN_WINDOWS):
        self.length, self.windows = length, windows
        self.open: list[tuple[int, list]] = []

    def add(self, pieces: list[tuple]) -> Iterator[list]:
        """Place pieces that stand together; yields windows that are full."""
        n = sum(len(p[2]) for p in pieces) >> 2
        length, held = self.length, self.open
        while n:
            if n >= length:
                head, pieces = _split(pieces, length)
                n -= length
                yield head
                continue
            best, rest = -1, length
            for i, (k, _) in enumerate(held):
                if 0 <= length - k - n < rest:
                    best, rest = i, length - k - n
            if best >= 0:
                k, own = held[best]
                if rest == 0:
                    held.pop(best)
                    yield own + pieces
                else:
                    own += _kept(pieces)
                    held[best] = (k + n, own)
                return
            if len(held) < self.windows:
                held.append((n, _kept(pieces)))
                return
            k, own = held.pop(max(range(len(held)), key=lambda i: (held[i][0], -i)))
            head, pieces = _split(pieces, length - k)
            n -= length - k
            yield own + head


def _kept(pieces: list[tuple]) -> list[tuple]:
    """Pieces with ids of their own, so that an open window does not hold a whole batch."""
    return [(doc, start, bytes(ids), total) for doc, start, ids, total in pieces]


def _split(pieces: list[tuple], n: int) -> tuple[list, list]:
    """The first n tokens of pieces, and the rest."""
    head, rest = [], []
    for doc, start, ids, total in pieces:
        k = min(n, len(ids) >> 2)
        if k:
            head.append((doc, start, ids[: 4 * k], total))
        if 4 * k < len(ids):
            rest.append((doc, start + k, ids[4 * k :], total))
        n -= k
    return head, rest


_SCHEMA = pa.schema([(k, pa.int64()) for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary()), ("leftover", pa.bool_())])


class _Rows:
    """Rows of windows, as columns; windows are numbered from `seq` on."""

    def __init__(self, seq: int):
        self.seq = seq
        self.columns: list[list] = [[] for _ in range(7)]

    def put(self, window: list) -> None:
        at, (doc, start, length, crc, tokens, seq, offset) = 0, self.columns
        for d, s, ids, total in window:
            n = len(ids) >> 2
            doc.append(d)
            start.append(s)
            length.append(n)
            crc.append(zlib.crc32(ids))
            tokens.append(total)
            seq.append(self.seq)
            offset.append(at)
            at += n
        self.seq += 1

    def full(self) -> bool:
        return len(self.columns[0]) >= 4000

    def batch(self, ids: list | None = None) -> pa.RecordBatch:
        n = len(self.columns[0])
        arrays = [pa.array(c, pa.int64()) for c in self.columns]
        arrays += [pa.nulls(n, pa.binary()) if ids is None else pa.array(ids, pa.binary()), pa.array([ids is not None] * n, pa.bool_())]
        self.columns = [[] for _ in range(7)]
        return pa.RecordBatch.from_arrays(arrays, schema=_SCHEMA)

    def rest(self, windows: list[tuple[int, list]]) -> Iterator[pa.RecordBatch]:
        """What is still to be told, and the open windows as leftovers with their ids."""
        yield self.batch()
        for _, window in windows:
            self.put(window)
            yield self.batch([bytes(p[2]) for p in window])


def pack(docs: DataFrame, vocabulary: str | None = None, end_id: int = 0, length: int = LENGTH, windows: int = OPEN_WINDOWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sequences of at most `length` tokens, a row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every token of every document, with its end id, lies in one piece. A partition keeps `windows` open windows; those
    left at its end are merged with others' in rounds of MERGE_FAN_IN tasks' worth; the last round keeps one window.
    So all sequences but one are full. A null or empty text is its end id alone. A null doc_id stays null
    and a repeated one is packed once for each row. No rows give no rows. Other columns are ignored. Sequence ids are
    distinct, not consecutive.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = vocabulary or default_vocabulary()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, box, out = encoder(path), Packer(length, windows), _Rows(TaskContext.get().partitionId() * IDS_A_TASK)
        for b in batches:
            ids, place = enc.encode(b.column(1), end_id)
            view, place = memoryview(ids.astype("<u4")).cast("B"), place.tolist()
            for doc, a, e in zip(b.column(0).to_pylist(), place, place[1:]):
                for window in box.add([(doc, 0, view[4 * a : 4 * e], e - a)]):
                    out.put(window)
                if out.full():
                    yield out.batch()
        enc.forget()
        yield from out.rest(box.open)

    made = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(giving_back(first), LEFT), "packed")
    done, left = [made.where("not leftover")], made.where("leftover")
    n, rounds = -(-left.select("sequence_id").distinct().count() // windows), 0
    while n:
        n, rounds = -(-n // MERGE_FAN_IN), rounds + 1

        def merge(batches: Iterator[pa.RecordBatch], shift: int = rounds * IDS_A_ROUND, keep: int = windows if n > 1 else 1) -> Iterator[pa.RecordBatch]:
            box, out = Packer(length, keep), _Rows(shift + TaskContext.get().partitionId() * IDS_A_TASK)
            now, own = None, []
            for b in batches:
                for r in b.to_pylist():
                    if r["sequence_id"] != now:
                        for window in box.add(own):
                            out.put(window)
                        now, own = r["sequence_id"], []
                    own.append((r["doc_id"], r["start"], r["ids"], r["doc_tokens"]))
                if out.full():
                    yield out.batch()
            for window in box.add(own):
                out.put(window)
            yield from out.rest(box.open)

        merged = cut(left.repartition(n, "sequence_id").sortWithinPartitions("sequence_id", "offset").mapInArrow(giving_back(merge), LEFT), "packed")
        done.append(merged.where("not leftover"))
        left, n = merged.where("leftover"), n if n > 1 else 0
    out = left
    for d in done:
        out = out.unionByName(d)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
