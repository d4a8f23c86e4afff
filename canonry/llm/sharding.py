"""Placement of rows on shards by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = tuple(f"shard-{i:03d}" for i in range(64))
SLOTS = 8209  # prime, over 100 slots a shard


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def _prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS, weights: dict[str, int] | None = None) -> list[int]:
    """The slot table: shards take turns, each claims the next free slot in its own order of preference.

    A shard's order is (offset + j * skip) mod slots, which visits every slot once as slots is prime. A shard with
    weight w takes w turns a round. Every shard gets its share to within one turn; when a shard goes, few slots of the
    others move. The table's size is a parameter, so it can be sent to every task whatever the data's size.
    """
    if not _prime(slots) or len(shards) > slots or not shards or len(set(shards)) != len(shards):
        raise ValueError("slots must be a prime of at least the number of shards; shards are distinct and not none")
    own = [(_number(f"{s}/offset") % slots, _number(f"{s}/skip") % (slots - 1) + 1) for s in shards]
    turns = [max(1, int((weights or {}).get(s, 1))) for s in shards]
    table, at, left = [-1] * slots, [0] * len(shards), slots
    while left:
        for i, (offset, skip) in enumerate(own):
            for _ in range(turns[i]):
                while left and table[slot := (offset + at[i] * skip) % slots] >= 0:
                    at[i] += 1
                if not left:
                    break
                table[slot], left, at[i] = i, left - 1, at[i] + 1
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """60 bits of the MD5 of the key's text, modulo slots; a null key is the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long") % slots


def assign_shards(df: DataFrame, key: str, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS, weights: dict[str, int] | None = None, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """df with the slot and the shard of each row's key.

    All rows stay; a null key is placed as the empty text; equal keys share a shard. Columns named like slot_col or
    shard_col are replaced. The table has `slots` rows (a parameter) and is broadcast, so placing is one hash lookup a
    row and nothing is shuffled. For a key that holds much of the data, give a finer key (the row's id, or the key with
    a salt): placement itself never gathers rows.
    """
    spark = df.sparkSession
    table = lookup_table(shards, slots, weights)
    names = ",".join(shards[i] for i in table)
    if any("," in s for s in shards):
        raise ValueError("a shard's name has no comma")
    lookup = spark.range(1).select(F.posexplode(F.split(F.lit(names), ",")).alias("__slot", "__shard")).select(F.col("__slot").cast("long").alias("__slot"), "__shard")
    rows = df.drop(*({slot_col, shard_col} - {key})).withColumn("__at", slot_of(F.col(key), slots))
    placed = rows.join(F.broadcast(lookup), F.col("__at") == F.col("__slot"))
    rest = [F.col(f"`{c}`") for c in df.columns if c not in (slot_col, shard_col)]
    return placed.select(*rest, F.col("__at").alias(slot_col), F.col("__shard").alias(shard_col))


def write_shards(df: DataFrame, path: str, key: str, salt: int = 8, **options) -> None:
    """Write df into a folder a shard; a shard's rows go to `salt` tasks at most, by a hash of the row, so that one key's rows spread too."""
    placed = assign_shards(df, key, **options)
    row = F.xxhash64(*[f"`{c}`" for c, kind in placed.dtypes if "map<" not in kind])
    placed.repartition("shard", F.pmod(row, F.lit(salt))).write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    # always true, and known only from the whole placed row: so whole rows are placed, not ids alone
    whole = F.length(F.concat_ws("", *[F.col(c).cast("string") for c in placed.columns])) >= 0
    return placed.where(whole).select("doc_id", "slot", "shard")


def sql() -> str:
    """The same placement; the slot table is given as a list."""
    names = ",".join(SHARDS[i] for i in lookup_table())
    return f"""
WITH t AS (SELECT string_split('{names}', ',') AS names),
d AS (SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT % {SLOTS} AS slot FROM documents)
SELECT doc_id, slot, names[slot + 1] AS shard FROM d, t
"""
