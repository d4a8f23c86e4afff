"""Links between texts whose word-shingle sets have a high Jaccard similarity, by parity sketches."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import ceil, exp, factorial, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canonry.llm.common import MAP_BITS, bit_map, giving_back, hash_words, set_bits, small_batches, text_hash, without_rows
from canonry.operators.components import connected_components
from canonry.plans.scratch import cut, discard

SKETCH = [f"s{i}" for i in range(8)]  # 512 parity bits
#: Lists of up to so many sets are compared pair by pair, the sets of longer ones by families and rare elements.
FEW = 32
#: What more than one in so many of a family's members differ in from their reference is ordered by how many do.
OFTEN = 32
#: Elements of a family's members that are counted in one part, and that a task adds up at a time.
COUNTED = 1 << 21
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Distinct hashed k-word shingles of each text, ascending; A-Z lower-cased, words parted by ASCII white space."""
    import xxhash

    flat, at = hash_words(texts, r"[\x09-\x0D\x20]+", pc.ascii_lower, xxhash.xxh3_64_intdigest, np.uint64)
    for a, e in zip(at.tolist(), at[1:].tolist()):
        h = flat[a:e]
        if not len(h):
            yield h
            continue
        n = min(k, len(h))
        with np.errstate(over="ignore"):
            out = np.full(len(h) - n + 1, n, np.uint64)
            for i in range(n):
                out = _mix(out * _A + h[i : len(h) - n + 1 + i])
        yield np.unique(out)


@lru_cache(maxsize=4)
def bands(percent: int, most: int = 1 << 40, ratio: float = 0.75) -> list[tuple[int, int, int, int, int, int]]:
    """Size bands (first, last home size, last size, segments, weak, spare).

    Two linked sets, the smaller of size a, both lie in the band at home to a. They differ in at most d elements, d from
    the largest pair of the band; with d + 1 + spare segments, at least spare + 1 segments hold the same elements in
    both. Segments with at most `weak` elements say little: they are only used for sets that have more than spare of
    them, since otherwise one of the spare + 1 equal segments is not weak.
    """
    out, s = [], 1
    while s <= most and len(out) < 200:
        after = max(s + 1, ceil(s / ratio))
        last = 100 * (after - 1) // percent
        d = (after - 1 + last) * (100 - percent) // (100 + percent)
        best = (d + 1, 0, 0)
        for weak in (0, 1, 2, 3) if d else ():
            m, x = d + 1, 0
            for _ in range(30):
                mean = s / m
                q = sum(exp(-mean) * mean**i / factorial(i) for i in range(weak + 1))
                x = ceil(m * q + 4 * sqrt(m * q * (1 - q)))
                if d + 1 + x == m or m > 2 * (d + 1) + 8:
                    break
                m = d + 1 + x
            if d + 1 + x <= 1.4 * (d + 1) + 1:
                best = (d + 1 + x, weak, x)
        out.append((s, after - 1, last, *best))
        s = after
    return out


def band_keys(h: np.ndarray, percent: int) -> np.ndarray:
    """The keys of a set: for each band that its size lies in, one of each segment.

    A key mixes the band, the segment, its 64 parity bits (a bit flips for each element) and the XOR of its elements.
    """
    n, out = len(h), []
    table = bands(percent)
    t = bisect_right(table, (n, 1 << 62)) - 1
    while t >= 0 and table[t][2] >= n:
        _, _, _, m, weak, spare = table[t]
        x = _mix(h + np.uint64(t + 1) * _B)
        seg = ((x >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        order = np.argsort(seg, kind="stable")
        seg, x = seg[order].astype(np.int64), x[order]
        starts = np.searchsorted(seg, np.arange(m))
        sizes = np.diff(np.append(starts, n))
        parity, xor = np.zeros(m, np.uint64), np.zeros(m, np.uint64)
        full = sizes > 0
        parity[full] = np.bitwise_xor.reduceat(np.uint64(1) << (x & np.uint64(63)), starts[full])
        xor[full] = np.bitwise_xor.reduceat(_mix(x), starts[full])
        low = sizes <= weak
        use = slice(None) if low.sum() > spare else ~low
        out.append(_mix(_mix(_mix(parity * _A + xor) + np.arange(m, dtype=np.uint64) * _B) + np.uint64(t) * _C)[use])
        t -= 1
    return np.concatenate(out)


def sketch(h: np.ndarray) -> np.ndarray:
    """512 parity bits; two sets' sketches differ in at most as many bits as the sets in elements."""
    bits = np.bincount((h >> np.uint64(7) & np.uint64(511)).astype(np.int64), minlength=512) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


#: Keys that a task deals out at a time, and keys that a task compares at a time.
DEALT, COMPARED = 1 << 20, 1 << 21
#: A list of more sets is written in several rows.
LONGEST_LIST = 1024
#: A key is a bucket and FP bits; a set goes by the other bits of its entry. Equal entries are equal sets but for hashing.
SET_BITS = np.uint64(40)
_SIGNATURE = f"doc long, th long, sid long, n long, hi long, lo long, {', '.join(f'{c} long' for c in SKETCH)}"
_LISTS = "key long, lead long, whole boolean, met long, tag long, members array<long>"
_SIGNATURE_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in _SIGNATURE.split(", ")])
_DEALT_ARROW = pa.schema([("part", pa.int32()), ("bucket", pa.int64()), *_SIGNATURE_ARROW, ("entries", pa.binary())])
_MET_ARROW = pa.schema([*_SIGNATURE_ARROW, ("key", pa.int64()), ("lead", pa.int64()), ("whole", pa.bool_()), ("met", pa.int64()), ("tag", pa.int64()), ("members", pa.list_(pa.int64()))])


def _batch(schema: pa.Schema, n: int, /, **columns) -> pa.RecordBatch:
    """A batch with the given columns and nulls elsewhere."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _lists(entries: np.ndarray, bucket: int, whole: bool) -> tuple[dict, np.ndarray]:
    """Lists of the sets that share a key, of distinct ascending entries of a bucket; and one entry of each key."""
    fp = entries >> SET_BITS
    first = np.flatnonzero(np.concatenate([[True], fp[1:] != fp[:-1]]))
    size = np.diff(np.append(first, len(entries)))
    (at,) = np.nonzero(size > 1)
    begin, size = first[at], size[at]
    sid = entries & ((np.uint64(1) << SET_BITS) - np.uint64(1))
    n = int(size.sum())
    flat = sid[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(n)]
    start = np.cumsum(size) - size
    tag = np.add.reduceat(_mix(flat * _A + _B), start) if n else np.empty(0, np.uint64)
    met = np.ones(len(at), np.int64)
    if whole and n:  # equal lists once
        _, one, met = np.unique(tag, return_index=True, return_counts=True)
        begin, size, tag = begin[one], size[one], tag[one]
    key = (np.int64(bucket) << 24) | fp[begin].astype(np.int64)
    lead = sid[begin]
    short = np.full(len(size), whole) & (size <= LONGEST_LIST)
    rows = -(-size // LONGEST_LIST)  # long lists in several rows
    nth = np.arange(int(rows.sum())) - np.repeat(np.cumsum(rows) - rows, rows)
    begin, length = np.repeat(begin, rows) + nth * LONGEST_LIST, np.minimum(LONGEST_LIST, np.repeat(size, rows) - nth * LONGEST_LIST)
    flat = sid[np.repeat(begin - np.cumsum(length) + length, length) + np.arange(int(length.sum()))]
    again = lambda x: np.repeat(x, rows)
    told = {"key": again(key), "lead": again(lead).astype(np.int64), "whole": again(short), "met": again(met), "tag": again(tag).view(np.int64), "begin": np.append(0, np.cumsum(length)), "flat": flat.astype(np.int64)}
    return told, entries[first]


def _met(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """One pass over rows (doc, text, th): their signatures, and lists of the sets that share a key.

    Keys go to the task of their bucket as sorted numbers of 8 bytes, (key, set); a set that a task meets again sends
    none. A task goes through its buckets one after the other, in steps of COMPARED keys: of earlier steps it holds one
    set of each key. So a bucket of many copies is streamed, and what is held is bounded. Lists that fit a step are
    `whole`; of those with the same sets one is given, `met` tells for how many keys at least.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = parts * max(1, min(16, 4096 // parts))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        waiting = 0

        def dealt() -> pa.RecordBatch:
            keys = np.concatenate(list(held.values()))
            sid = np.repeat(np.fromiter(held, np.uint64, len(held)), [len(x) for x in held.values()])
            bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.uint32)
            entry = (keys & np.uint64(0xFFFFFF)) << SET_BITS | sid
            order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
            bucket, raw = bucket[order], entry[order].tobytes()
            first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            of = bucket[first].astype(np.int64)
            begin = pa.array(np.append(first, len(bucket)).astype(np.int32) * 8)
            entries = pa.Array.from_buffers(pa.binary(), len(of), [None, begin.buffers()[1], pa.py_buffer(raw)])
            held.clear()
            return _batch(_DEALT_ARROW, len(of), part=(of % parts).astype(np.int32), bucket=of, entries=entries)

        for b in batches:
            out: dict[str, list] = {c: [] for c in ("sid", "n", "hi", "lo")}
            sketches = []
            with np.errstate(over="ignore"):
                for doc, h in zip(b.column(0).to_pylist(), shingles(b.column(1), k)):
                    hi, lo = _mix(h).sum(dtype=np.uint64), np.bitwise_xor.reduce(_mix(h * _B)) if len(h) else np.uint64(0)
                    sid = int(_mix(_mix(hi + np.uint64(len(h))) ^ lo)) & (1 << 40) - 1
                    for c, v in zip(out, (sid, len(h), int(hi.astype(np.int64)), int(np.uint64(lo).astype(np.int64)))):
                        out[c].append(v)
                    sketches.append(sketch(h))
                    if len(h) and doc is not None and sid not in held:
                        held[sid] = band_keys(h, percent)
                        waiting += len(held[sid])
            sk = np.array(sketches, np.int64).reshape(len(sketches), 8)
            yield _batch(_DEALT_ARROW, len(sk), part=np.array(out["sid"], np.int64) % parts, bucket=[-1] * len(sk), doc=b.column(0), th=b.column(2), **out, **{c: sk[:, i] for i, c in enumerate(SKETCH)})
            if waiting >= DEALT:
                yield dealt()
                waiting = 0
        if held:
            yield dealt()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, waiting, carried, known = -1, [], 0, None, np.empty(0, np.uint64)

        def compare(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, waiting, carried, known
            if held:
                x = np.unique(np.concatenate(held if carried is None else [carried, *held]))
                told, ones = _lists(x, now, last and carried is None)
                carried = None if last else ones
                begin, flat, tag = told.pop("begin"), told.pop("flat"), told["tag"].view(np.uint64)
                fresh = ~(told["whole"] & np.isin(tag, known))
                if len(known) > COMPARED:
                    known = known[:0]
                known = np.concatenate([known, tag[fresh & told["whole"]]])
                keep = pa.array(fresh)
                yield from (
                    _batch(_MET_ARROW, int(fresh.sum()), members=pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(flat)).filter(keep), **{c: v[fresh] for c, v in told.items()})
                    .slice(i, 20_000) for i in range(0, int(fresh.sum()), 20_000)
                )
                held, waiting = [], 0
            elif last:
                carried = None

        for b in batches:
            bucket = b.column("bucket").to_numpy()
            own = np.flatnonzero(bucket < 0)
            if len(own):
                some = b.take(pa.array(own))
                yield _batch(_MET_ARROW, len(own), **{c: some.column(c) for c in _SIGNATURE_ARROW.names})
            for i in np.flatnonzero(bucket >= 0).tolist():
                if bucket[i] != now:
                    yield from compare(True)
                    now = int(bucket[i])
                held.append(np.frombuffer(b.column("entries")[i].as_buffer(), np.uint64))
                waiting += len(held[-1])
                if waiting >= COMPARED:
                    yield from compare(False)
        yield from compare(True)

    dealt = rows.select("doc", "text", "th").mapInArrow(giving_back(deal), f"part int, bucket long, {_SIGNATURE}, entries binary")
    return dealt.repartitionById(parts, "part").sortWithinPartitions("bucket").mapInArrow(giving_back(meet), f"{_SIGNATURE}, {_LISTS}")


def _over_sets(docs: DataFrame, ids: DataFrame, k: int, make: Callable, schema: str) -> DataFrame:
    """make(iterator of (docs, their sets)) over the documents in ids (doc), and few others, without moving texts."""
    place = F.expr(f"xxhash64(doc) & {MAP_BITS - 1}").alias("p")
    sent = docs.sparkSession.sparkContext.broadcast(bit_map(ids.select(place)))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def some() -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
            for b in batches:
                b = b.filter(pa.array(set_bits(sent.value, b.column(2).to_numpy())))
                yield b.column(0), [h.view(np.int64) for h in shingles(b.column(1), k)]

        yield from make(some())

    return docs.where("doc is not null").select("doc", "text", place).mapInArrow(giving_back(apply), schema)


def _sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(doc, set) of the documents in ids (doc), and of few others."""

    def make(some: Iterator[tuple[pa.Array, list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        for doc, sets in some:
            yield pa.RecordBatch.from_pydict({"doc": doc, "set": pa.array(sets, pa.list_(pa.int64()))})

    return _over_sets(docs, ids, k, make, "doc long, set array<long>")


def _may_link(a: str, b: str, percent: int, times: int = 1) -> Column:
    """Sizes and sketches allow that the pair links, or is so far apart as `times` that."""
    n = F.col(f"{a}.n") + F.col(f"{b}.n")
    apart = sum((F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in SKETCH[1:]), F.bit_count(F.col(f"{a}.s0").bitwiseXOR(F.col(f"{b}.s0"))))
    return (F.least(f"{a}.n", f"{b}.n") * 100 >= F.greatest(f"{a}.n", f"{b}.n") * max(0, 100 - times * (100 - percent))) & (apart * (100 + percent) <= n * (100 - percent) * times)


def _pairs(groups: DataFrame, by: str, slim: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one group and different components that may link; for groups of up to FEW sets."""
    own = groups.select(by, "doc", "comp").join(slim, "doc")
    x, y = own.alias("x"), own.alias("y")
    met = x.join(y, (F.col(f"x.{by}") == F.col(f"y.{by}")) & (F.col("x.doc") < F.col("y.doc")) & (F.col("x.comp") != F.col("y.comp")) & _may_link("x", "y", percent))
    return met.select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b"))


def wide(h: np.ndarray) -> bytes:
    """Parity bits of a set, 2 to 4 for each element and a power of two; half as many are its halves' XOR."""
    m = 1 << max(6, (2 * len(h) - 1).bit_length())
    bits = np.bincount((h >> np.uint64(20) & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def bits_apart(x: bytes, y: bytes) -> int:
    """Bits in which two sets' wide() differ, at most as many as the sets in elements."""
    a, b = (np.frombuffer(v, np.uint64) for v in (x, y))
    while len(a) != len(b):
        a, b = (v[: len(v) // 2] ^ v[len(v) // 2 :] if len(v) > len(w) else v for v, w in ((a, b), (b, a)))
    return int(np.bitwise_count(a ^ b).sum())


def _still(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) that may link by bits in proportion to their sets' sizes, which take a thirtieth of the sets' room."""

    def make(some: Iterator[tuple[pa.Array, list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        for doc, sets in some:
            yield pa.RecordBatch.from_pydict({"doc": doc, "n": pa.array([len(h) for h in sets], pa.int64()), "bits": pa.array([wide(h.view(np.uint64)) for h in sets], pa.binary())})

    @F.arrow_udf("long")
    def apart(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([bits_apart(v, w) for v, w in zip(x.to_pylist(), y.to_pylist())], pa.int64())

    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    bits = cut(_over_sets(docs, ids, k, make, "doc long, n long, bits binary"), "bits")
    x, y = (bits.select(F.col("doc").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits{c}")) for c in "ab")
    both = pairs.select("a", "b").join(x, "a").join(y, "b").withColumn("apart", apart("bitsa", "bitsb"))
    alike = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (F.col("apart") * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent))
    out = cut(both.where(alike).select("a", "b").distinct(), "still")
    discard(bits)
    return out


def _verify(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets, taken anew from the whole texts, link. Whole sets move only for pairs that may link by their bits."""
    pairs = _still(pairs, docs, k, percent)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    sets = cut(_sets(docs, ids, k), "sets")
    both = pairs.join(sets.select(F.col("doc").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("doc").alias("b"), F.col("set").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    out = cut(both.where(shared * (100 + percent) >= percent * (F.size("x") + F.size("y"))).select("a", "b").distinct(), "links")
    discard(sets, pairs)
    return out


def _often(own: DataFrame) -> DataFrame:
    """What often sets members of families (grp, c, parts, more, less) apart from their reference.

    `c` is a family's number of members. By family: `moved`, the elements that the reference should hold and lacks or the
    other way round, and `often`, all elements in which more than one in OFTEN of the members differ from the reference
    after that, fewest first. Tasks add up before anything is sent: a row holds a family's elements of one of its parts.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[np.ndarray]] = {}
        waiting = 0

        def told() -> Iterator[pa.RecordBatch]:
            out: dict[str, list] = {c: [] for c in ("grp", "c", "part", "e", "times")}
            for (grp, c, parts), lists in held.items():
                (more, m), (less, n) = (np.unique(np.concatenate(lists[i::2]), return_counts=True) for i in (0, 1))
                e, times = np.concatenate([more, less]), np.concatenate([m, -n])
                part = e % parts
                for p in np.unique(part).tolist():
                    for name, v in zip(out, (grp, c, p, e[part == p], times[part == p])):
                        out[name].append(v)
                if len(out["grp"]) >= 1000:
                    yield pa.RecordBatch.from_pydict(out, told_schema)
                    out = {c: [] for c in out}
            if out["grp"]:
                yield pa.RecordBatch.from_pydict(out, told_schema)
            held.clear()

        for b in batches:
            own = (b.column(i).to_pylist() for i in range(3))
            sides = [(x.values.to_numpy(zero_copy_only=False), x.offsets.to_numpy()) for x in (b.column(3), b.column(4))]
            for i, family in enumerate(zip(*own)):
                for flat, at in sides:
                    held.setdefault(family, []).append(flat[at[i] : at[i + 1]])
                    waiting += int(at[i + 1] - at[i])
                if waiting >= COUNTED:
                    yield from told()
                    waiting = 0
        yield from told()

    def merge(key: tuple, t: pa.Table) -> pa.Table:
        e, times = (np.concatenate([x.values.to_numpy(zero_copy_only=False)[x.offsets[0].as_py() : x.offsets[-1].as_py()] for x in t.column(c).chunks]) for c in ("e", "times"))
        e, of = np.unique(e, return_inverse=True)
        total = np.zeros(len(e), np.int64)
        np.add.at(total, of, times)
        c, own, times = t.column("c")[0].as_py(), total > 0, np.abs(total)
        keep = times > max(1, c / OFTEN)
        e, own, times = e[keep], own[keep], times[keep]
        moved = (2 * np.where(own, times, c - times) > c) == own
        some = pa.StructArray.from_arrays([pa.array(np.where(moved, c - times, times)), pa.array(e)], ["times", "e"])
        offsets = pa.array([0, len(e)], pa.int32())
        return pa.table({"grp": pa.array([key[0].as_py()], pa.int64()), "told": pa.ListArray.from_arrays(offsets, some), "moved": pa.array([e[moved]], pa.list_(pa.int64()))})

    told_schema = pa.schema([*((c, pa.int64()) for c in ("grp", "c", "part")), ("e", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])
    added = own.mapInArrow(giving_back(add), "grp long, c long, part long, e array<long>, times array<long>")
    merged = added.groupBy("grp", "part").applyInArrow(merge, "grp long, told array<struct<times: long, e: long>>, moved array<long>")
    return merged.groupBy("grp").agg(F.array_sort(F.flatten(F.collect_list("told"))).getField("e").alias("often"), F.flatten(F.collect_list("moved")).alias("moved"))


def _within(groups: DataFrame, slim: DataFrame, docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Certain links and candidates (a, b) of families (grp, doc, comp), without comparing all members.

    A family's reference is what more than half of its members hold (any set gives right results); it is found from their
    differences to the document that the family is named after. A member is its difference D from the reference, elements
    that fewest members differ in first. With q = 100 + percent and W = q |D| - (100 - percent) n, two
    members link exactly when their differences share at least (W + W') / 2q elements. Members whose W is not above
    the negated smallest W link with the member that has the smallest, and need no comparison with each other; the others
    are far. Of a pair with a far member that with the larger W is far. Both hold a shared element among the first
    |D| + 1 - needed: for the larger the other's W is at least the lowest of all differences, for the smaller at least
    its own and the lowest of the far members.
    """
    q = 100 + percent
    sets = _sets(docs, groups.select("doc").distinct(), k)
    names = groups.select(F.col("grp").alias("doc")).distinct()
    refs = cut(_sets(docs, names, k).join(names, "doc").groupBy(F.col("doc").alias("grp")).agg(F.max("set").alias("ref")), "references")
    own = groups.join(sets, "doc").join(refs, "grp").select("grp", "doc", "comp", F.size("set").alias("n"), F.array_except("set", "ref").alias("more"), F.array_except("ref", "set").alias("less"))
    own = cut(own, "first-differences")
    size = groups.join(slim, "doc").groupBy("grp").agg(F.count("*").alias("c"), (1 + F.floor(F.sum(slim.n) / COUNTED)).alias("parts"))
    often = _often(own.join(size, "grp").select("grp", "c", "parts", "more", "less"))
    none = F.expr("CAST(array() AS array<long>)")
    own = own.withColumn("d", F.concat("more", "less")).join(often, "grp", "left").withColumns({c: F.coalesce(c, none) for c in ("often", "moved")})
    own = own.withColumn("d", F.concat(F.array_except("d", "moved"), F.array_except("moved", "d")))
    own = own.withColumn("d", F.concat(F.array_sort(F.array_except("d", "often")), F.array_intersect("often", "d")))
    own = own.select("grp", "doc", "comp", "d", (q * F.size("d") - (100 - percent) * F.col("n")).alias("w"))
    own = cut(own, "differences")
    some = F.size("d") > 0
    hubs = own.groupBy("grp").agg(F.min("w").alias("least"), F.min_by("doc", "w").alias("hub"), F.min(F.when(some, F.col("w"))).alias("low"))
    own = own.join(hubs, "grp").withColumn("far", F.col("w") + F.col("least") > 0)
    certain = own.where("not far and doc <> hub").select(F.least("doc", "hub").alias("a"), F.greatest("doc", "hub").alias("b")).distinct()
    own = own.join(own.where("far").groupBy("grp").agg(F.min("w").alias("next")), "grp").where(some)
    first = lambda shared: F.explode(F.slice("d", F.lit(1), F.greatest(F.lit(0), F.size("d") + 1 - F.greatest(F.lit(1), F.ceil(shared / (2 * q)))).cast("int"))).alias("e")
    x = own.where("far").select("grp", "doc", "comp", "w", first(F.col("w") + F.col("low"))).alias("x")
    y = own.select("grp", "doc", "comp", "w", first(F.col("w") + F.greatest("w", "next"))).alias("y")
    less = F.struct("y.w", "y.doc") < F.struct("x.w", "x.doc")
    met = x.join(y, (F.col("x.grp") == F.col("y.grp")) & (F.col("x.e") == F.col("y.e")) & (F.col("x.comp") != F.col("y.comp")) & less)
    pairs = cut(met.select(F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b")).distinct(), "near")
    s, t = slim.alias("s"), slim.alias("t")
    return certain, pairs.join(s, pairs.a == F.col("s.doc")).join(t, pairs.b == F.col("t.doc")).where(_may_link("s", "t", percent)).select("a", "b")


def _across(groups: DataFrame, slim: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) of (doc, comp, fam) from different families that may link.

    Linked sets share one of the first n - percent of n + 1 elements of each, in any order that is the same for all;
    here the elements that fewest of the sets hold come first, by counts of a fixed size, so what many texts share
    (a line, a passage) comes last. Elements of one family only are left out.
    """
    slots = 1 << 18
    ids = groups.select("doc").distinct()

    def count(some: Iterator[tuple[pa.Array, list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.int64)
        for _, sets in some:
            total += np.bincount(np.concatenate([np.empty(0, np.int64), *sets]) & (slots - 1), minlength=slots)
        (hot,) = np.nonzero(total > 4 * max(1, total.mean()))  # the rest are rare
        yield pa.RecordBatch.from_pydict({"slot": pa.array(hot, pa.int64()), "n": pa.array(total[hot])})

    hot = _over_sets(docs, ids, k, count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    weight = np.zeros(slots, np.int64)
    weight[hot.column("slot").to_numpy()] = hot.column("n").to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(weight)

    def prefix(some: Iterator[tuple[pa.Array, list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        for doc, sets in some:
            first = [h[np.lexsort((h, sent.value[h & (slots - 1)]))][: len(h) - -(-len(h) * percent // 100) + 1] for h in sets]
            yield pa.RecordBatch.from_pydict({"doc": doc, "first": pa.array(first, pa.list_(pa.int64()))})

    held = _over_sets(docs, ids, k, prefix, "doc long, first array<long>").select("doc", F.explode("first").alias("e")).join(groups.select("doc", "comp", "fam"), "doc")
    held = cut(held, "rare")
    several = held.groupBy("e").agg(F.min("fam").alias("lo"), F.max("fam").alias("hi")).where("lo <> hi").select("e")
    own = held.join(several, "e").join(slim, "doc")
    x, y = own.alias("x"), own.alias("y")
    met = x.join(y, (F.col("x.e") == F.col("y.e")) & (F.col("x.fam") != F.col("y.fam")) & (F.col("x.doc") < F.col("y.doc")) & (F.col("x.comp") != F.col("y.comp")) & _may_link("x", "y", percent))
    out = cut(met.select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b")).distinct(), "across")
    discard(held)
    return out


def _components(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(doc, th, n, comp) of every row; see components()."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"), text_hash(text_col).alias("th"))
    met = cut(_met(rows, k, percent), "signatures")
    sigs = met.where("n is not null").select("doc", "th", "n", "hi", "lo", "sid", *SKETCH)
    one = [F.first(c).alias(c) for c in ("sid", *SKETCH)]
    reps = cut(sigs.where("doc is not null and n > 0").groupBy("hi", "lo", "n").agg(F.min("doc").alias("rep"), *one), "sets-once")
    slim = reps.select(F.col("rep").alias("doc"), "sid", "n", *SKETCH)
    lists = met.where("members is not null").select("key", "lead", "whole", "met", "tag", "members")
    once = lists.where("whole").groupBy("tag", "lead", F.size("members").alias("size")).agg(F.min("key").alias("key"), F.sum("met").alias("met"), F.first("members").alias("members"))
    cols = ["key", "met", "members"]
    some = lists.where("not whole").select(*cols).unionByName(once.select(*cols))
    named = some.select("key", "met", F.size("members").alias("size"), F.explode("members").alias("sid")).join(slim.select("sid", "doc"), "sid")
    members = cut(named.select("key", "met", "size", "doc"), "members")

    # A list's lead is the set that shares most keys with others; a set is first compared with the lead it shares most keys with.
    degree = members.groupBy("doc").agg(F.sum(F.expr("met * size")).alias("degree"))
    leads = members.join(degree, "doc").groupBy("key").agg(F.max(F.struct("degree", (-F.col("doc")).alias("minus"))).alias("top")).select("key", (-F.col("top.minus")).alias("hub"))
    led = cut(members.select("key", "met", "doc").join(leads, "key").where("doc <> hub").groupBy("hub", "doc").agg(F.sum("met").alias("met"), F.min("key").alias("key")), "led")
    x, y = slim.alias("x"), slim.alias("y")
    near = led.join(x, led.hub == F.col("x.doc")).join(y, led.doc == F.col("y.doc")).where(_may_link("x", "y", percent, 2)).select(led.hub, led.doc, led.met, _may_link("x", "y", percent).alias("may"))
    by = [F.col("met"), -F.col("hub")]
    best = cut(near.groupBy("doc").agg(F.max_by("hub", F.struct("may", *by)).alias("hub"), F.max("may").alias("may"), F.max_by("hub", F.struct(*by)).alias("kin")), "best")
    first = cut(best.where("may").select(F.least("doc", "hub").alias("a"), F.greatest("doc", "hub").alias("b")).distinct(), "pairs")
    star = _verify(first, rows, k, percent)
    comp = connected_components(star, "a", "b").select(F.col("node").alias("doc"), F.col("component").alias("comp"))
    kin = best.select(F.col("kin").alias("doc")).distinct()  # each is a family of its own, others belong to the one they are near
    fam = best.select("doc", F.col("kin").alias("fam")).join(kin, "doc", "left_anti")

    # Only lists that still hold several components are compared further: short ones pair by pair; the sets of long ones
    # in their families, and across families by their rarest elements.
    placed = members.select("key", "doc").join(comp, "doc", "left").join(fam, "doc", "left")
    placed = cut(placed.select("key", "doc", F.coalesce("comp", "doc").alias("comp"), F.coalesce("fam", "doc").alias("fam")), "placed")
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.countDistinct("fam").alias("fams"), F.count("*").alias("c")).where("lo <> hi").select("key", "c", "fams")
    open_ = placed.join(mixed, "key")
    few = _pairs(open_.where(f"c <= {FEW}"), "key", slim, percent)
    long = cut(open_.where(f"c > {FEW}").groupBy("doc").agg(F.min("comp").alias("comp"), F.min("fam").alias("fam"), F.max(F.expr("fams > 1")).alias("across")), "undecided")
    families = long.groupBy("fam").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("fam")
    certain, many = _within(long.join(families, "fam").select(F.col("fam").alias("grp"), "doc", "comp"), slim, rows, k, percent)
    pairs = few.unionByName(many).unionByName(_across(long.where("across"), slim, rows, k, percent))
    more = cut(pairs.distinct().join(first, ["a", "b"], "left_anti"), "pairs")
    rest = _verify(more, rows, k, percent).unionByName(certain)
    final = connected_components(star.unionByName(rest), "a", "b").select(F.col("node").alias("rep"), F.col("component").alias("comp"))
    discard(members, led, best, first, placed, long, more)
    found = reps.join(final, "rep", "left").select("hi", "lo", "n", F.coalesce("comp", "rep").alias("comp"))
    out = sigs.select("doc", "th", "n", "hi", "lo").join(found, ["hi", "lo", "n"], "left")
    return out.select("doc", "th", "n", F.when(F.col("n") == 0, F.col("doc")).when(F.col("doc").isNotNull(), F.coalesce("comp", "doc")).alias("comp"))


def components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every row's whole text.

    Two rows link when 100 * intersection >= percent * union of their sets of k-word shingles; a text of fewer words is
    one shingle. Texts with equal sets link; null and empty texts have no shingle and link with nothing, their
    component is their own id. A null doc_id has a null component and links nothing. Of rows that repeat a doc_id each
    has the component of its text. Other columns are ignored; no rows give no rows.

    Exact but for equal hashes: equal sets are folded first; every two linked sets share a key (see bands). Each set is
    compared with one that shares many keys with it and with others. Components of these links are formed, and only
    lists of a key that still hold several components are compared further, pairs of one component left out: short
    lists pair by pair; the sets of long ones in families of similar sets, by an index of what sets a family's members
    apart (see _within), and across families by their rarest elements (see _across). Candidates pass the sketches'
    bound, then the sets themselves decide.
    """
    return _components(docs, k, percent, id_col, text_col).select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs, all columns, that stand for their component: those with its smallest id.

    Rows, not ids, are dropped: of rows that repeat an id with different texts each goes or stays by its own text, and
    rows repeated in full go or stay together. Rows with a null id stay. Only texts that may go are shuffled.
    """
    gone = cut(_components(docs, k, percent, id_col, text_col).where("doc <> comp").select(F.col("doc").alias("id"), "th"), "near-copies")
    return without_rows(docs, gone, id_col, text_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, percent=90)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n, CAST(list_sort(sh) AS VARCHAR) AS whole, sh FROM s),
r AS (SELECT whole, min(doc_id) AS rep, any_value(n) AS n, any_value(sh) AS sh FROM n WHERE n > 0 GROUP BY whole),
e AS (SELECT rep, n, unnest(sh) AS x FROM r),
i AS (SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.rep < b.rep AND a.n * 10 >= b.n * 9 AND b.n * 10 >= a.n * 9 GROUP BY ALL),
l AS (SELECT a, b FROM i WHERE 100 * k >= 90 * (na + nb - k)),
both_ways AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT rep AS a, rep AS b FROM r UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
c AS (SELECT a, min(b) AS comp FROM reach GROUP BY a)
SELECT n.doc_id, n.n AS n_shingles, coalesce(c.comp, n.doc_id) AS component_id
FROM n LEFT JOIN r ON n.whole = r.whole AND n.n > 0 LEFT JOIN c ON r.rep = c.a
"""
