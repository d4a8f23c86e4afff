"""Token ids in files of independent zstandard frames with a seek table at the end.

Layout of a file (all numbers little-endian):
  skippable frame 0x184D2A50: JSON {"version", "dtype"}
  data frames: each holds whole documents' ids, about FRAME_BYTES before compression
  skippable frame 0x184D2A51: zstandard-compressed index: int64 doc_id of each document, int64 first token of each
    document, int64 number of tokens, int64 number of documents without an id, which come first and show 0
  skippable frame 0x184D2A5E: the seek table of zstandard's public seekable format, with a checksum of each frame
A plain zstandard reader that skips skippable frames gets the ids of all documents in order.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from canonry.llm.common import small_batches
from canonry.llm.tokens import default_vocabulary, encoder
from canonry.plans.scratch import cut, new_path

HEAD, INDEX, SEEK, SEEKABLE = 0x184D2A50, 0x184D2A51, 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES = 256 << 10


def _skippable(magic: int, body: bytes) -> bytes:
    return struct.pack("<II", magic, len(body)) + body


def write_file(out, docs: Iterable[tuple[int | None, bytes]], dtype: str, level: int = 3) -> dict:
    """Write (doc_id, ids as bytes of dtype) in the given order to the file object `out`; returns counts.

    Documents without an id (None) come first.
    A document longer than a frame gets a frame of its own. Without documents the file holds no data frame.
    """
    import xxhash
    import zstandard

    width, press = np.dtype(dtype).itemsize, zstandard.ZstdCompressor(level=level)
    size, frames, ids, starts, held, n, nameless = 0, [], [], [], [], 0, 0

    def put(data: bytes) -> None:
        nonlocal size
        out.write(data)
        size += len(data)

    def flush() -> None:
        if held:
            raw = b"".join(held)
            put(frame := press.compress(raw))
            frames.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            held.clear()

    put(_skippable(HEAD, json.dumps({"version": 1, "dtype": dtype}).encode()))
    head, waiting = size, 0
    for doc_id, raw in docs:
        if waiting and waiting + len(raw) > FRAME_BYTES:
            flush()
            waiting = 0
        nameless += doc_id is None
        ids.append(doc_id or 0)
        starts.append(n)
        held.append(raw)
        waiting += len(raw)
        n += len(raw) // width
    flush()
    index = press.compress(np.array([ids, starts], dtype="<i8").tobytes() + struct.pack("<qq", n, nameless))
    put(_skippable(INDEX, index))
    table = b"".join(struct.pack("<III", *f) for f in frames) + struct.pack("<IBI", len(frames), 0x80, SEEKABLE)
    put(_skippable(SEEK, table))
    return {"docs": len(ids), "tokens": n, "bytes": size, "frames": len(frames), "head": head}


class TokenFile:
    """Reads one file; only the frames of requested documents are fetched and decompressed, and each is verified."""

    def __init__(self, file, size: int | None = None):
        import zstandard

        self.file, self.size = file, file.seek(0, io.SEEK_END) if size is None else size
        count, flags, magic = struct.unpack("<IBI", self._at(self.size - 9, 9))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        table = self._at(self.size - 9 - 12 * count, 12 * count)
        self.frames = np.frombuffer(table, dtype="<u4").reshape(count, 3).astype(np.int64)
        kind, n = struct.unpack("<II", self._at(0, 8))
        self.dtype = np.dtype(json.loads(self._at(8, n))["dtype"])
        self.place = 8 + n + np.concatenate([[0], np.cumsum(self.frames[:, 0])])
        self.raw_place = np.concatenate([[0], np.cumsum(self.frames[:, 1])])
        _, n = struct.unpack("<II", self._at(int(self.place[-1]), 8))
        index = zstandard.ZstdDecompressor().decompress(self._at(int(self.place[-1]) + 8, n))
        docs = (len(index) - 16) // 16
        (self.nameless,) = struct.unpack_from("<q", index, len(index) - 8)
        self.ids = np.frombuffer(index, "<i8", docs)
        self.starts = np.frombuffer(index, "<i8", docs + 1, offset=8 * docs)
        self.unpack = zstandard.ZstdDecompressor()

    def _at(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def frame(self, k: int) -> bytes:
        import xxhash

        raw = self.unpack.decompress(self._at(int(self.place[k]), int(self.frames[k, 0])), max_output_size=int(self.frames[k, 1]))
        if len(raw) != self.frames[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.frames[k, 2]:
            raise ValueError(f"frame {k} does not match its checksum")
        return raw

    def read(self, which: Iterable[int] | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, first token in this file, ids) of the documents at these positions, or of all, in order."""
        now, raw, width = -1, b"", self.dtype.itemsize
        for i in range(len(self.ids)) if which is None else which:
            a, b = int(self.starts[i]) * width, int(self.starts[i + 1]) * width
            doc_id = int(self.ids[i]) if i >= self.nameless else None
            if a == b:
                yield doc_id, a // width, np.empty(0, self.dtype)
                continue
            k = int(np.searchsorted(self.raw_place, a, side="right")) - 1
            if k != now:
                now, raw = k, self.frame(k)
            base = int(self.raw_place[k])
            yield doc_id, a // width, np.frombuffer(raw, self.dtype, (b - a) // width, a - base)

    def find(self, doc_id: int) -> list[int]:
        """Positions of a document (ids are in ascending order in the file)."""
        ids = self.ids[self.nameless :]
        return list(range(self.nameless + int(np.searchsorted(ids, doc_id, "left")), self.nameless + int(np.searchsorted(ids, doc_id, "right"))))


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = 2, files: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode docs and write them in ascending doc_id order; returns the manifest, a row a file, itself written.

    A null text is empty and still gets its end id. Rows with one doc_id stand in order of their text; rows with a null
    doc_id come first and have a null id in the files. No rows: no files. The manifest names the files that count: a
    file has a name of its own, and what a lost or repeated task leaves behind is not in the manifest. `folder` is a
    URI that all executors reach.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = vocabulary or default_vocabulary()
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = encoder(path), TaskContext.get().partitionId()

        def rows() -> Iterator[tuple[int | None, memoryview]]:
            for b in batches:
                ids, place = enc.encode(b.column(1), end_id)
                view, place = memoryview(ids).cast("B"), (place * enc.dtype.itemsize).tolist()
                yield from zip(b.column(0).to_pylist(), (view[a:e] for a, e in zip(place, place[1:])))

        first = next(it := rows(), None)
        if first is None:
            return
        fs, top = _open(folder)
        fs.create_dir(top, recursive=True)
        name = f"tokens-{shard:06d}-{uuid.uuid4().hex}.zst"

        def all_rows() -> Iterator[tuple[int | None, memoryview]]:
            yield first
            yield from it

        with fs.open_output_stream(f"{top}/{name}", compression=None) as out:
            told = write_file(out, all_rows(), enc.dtype.str)
        enc.forget()
        yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [f"{folder}/{name}"], "docs": [told["docs"]], "tokens": [told["tokens"]], "bytes": [told["bytes"]]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    made = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(write, "shard long, file string, docs long, tokens long, bytes long")
    manifest = cut(made, "token-manifest")
    # A row a file: the one window without a key has as many rows as there are files.
    return manifest.withColumn("base", F.coalesce(F.sum("tokens").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long"))


def read_token_files(manifest: DataFrame, each: Callable[[TokenFile], Iterator[dict]], schema: str) -> DataFrame:
    """Apply `each` to every opened file; its dicts become rows, with the file's `base` and `shard` added."""
    names = [f.split()[0] for f in schema.split(",")]
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                fs, path = _open(r["file"])
                with fs.open_input_file(path) as f:
                    held = []
                    for x in each(TokenFile(f, r["bytes"])):
                        held.append(x | {"base": r["base"], "shard": r["shard"]})
                        if len(held) >= 5000:
                            yield _rows(held, names)
                            held = []
                    if held:
                        yield _rows(held, names)

    return manifest.repartition(n, "shard").mapInArrow(read, schema)


def _rows(held: list[dict], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: [x[k] for x in held] for k in names})


def documents_of(file: TokenFile) -> Iterator[dict]:
    for i, start, ids in file.read():
        yield {"doc_id": i, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())}


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of all documents, read back: doc_id, start, n_tokens, ids_crc32."""
    manifest = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), new_path(spark, "tokens"))
    rows = read_token_files(manifest, documents_of, "doc_id long, start long, n_tokens long, ids_crc32 long, base long, shard long")
    return rows.select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
