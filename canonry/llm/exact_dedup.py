"""Exact deduplication against a persistent digest index, bucketed and sorted by digest."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canonry.llm.common import ascii_lower, split_rows, text_hash
from canonry.plans.scratch import cut, discard


class DigestIndex:
    """A table (digest binary, keep_id long) in the warehouse, bucketed and sorted by digest.

    A digest is the SHA-256 of the normalised text in UTF-8. The table is made, empty, with the object if it is not
    there yet. New digests meet it in a sort-merge anti-join that reads the index in its buckets and shuffles only the
    new digests; those not found are appended. `buckets` is fixed when the table is made: choose it for the size that
    the index shall reach.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int = 64):
        self.spark, self.name, self.buckets = spark, name, buckets
        if not spark.catalog.tableExists(name):
            self.append(spark.range(0).select(F.lit(None).cast("binary").alias("digest"), F.col("id").alias("keep_id")))

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def new(self, groups: DataFrame) -> DataFrame:
        """Rows of groups (one row a digest) whose digest is not in the index yet."""
        return groups.join(self.read().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, groups: DataFrame) -> None:
        out = groups.select("digest", F.col("keep_id").cast("long").alias("keep_id"))
        out.repartition(self.buckets, "digest").write.mode("append").bucketBy(self.buckets, "digest").sortBy("digest").format("parquet").saveAsTable(self.name)

    def add(self, groups: DataFrame) -> None:
        """Append what is new of groups (digest, keep_id); it is cut first, as a table cannot be read while it is written."""
        fresh = cut(self.new(groups.select("digest", "keep_id")), "digests")
        self.append(fresh)
        discard(fresh)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


#: Groups with over one in HOT of all rows are joined by broadcast: there are fewer than HOT of them.
HOT = 1000


def _digest(text_col: str) -> Column:
    return F.unhex(F.sha2(F.encode(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), "UTF-8"), 256))


def _decide(docs: DataFrame, index: DigestIndex, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, th, digest, keep_id, group_size, kept) of every row; the texts are read once."""
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), text_hash(text_col).alias("th"), _digest(text_col).alias("digest")), "row-digests")
    groups = cut(rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "digest-groups")
    index.add(groups)
    keep = groups.select("digest", "group_size").join(index.read().select("digest", "keep_id").hint("merge"), "digest")
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    large = F.col("group_size") * HOT > total
    hot = cut(keep.where(large), "hot-digests")
    met = rows.join(F.broadcast(hot), "digest", "left")
    few = met.where("group_size is null").select("doc_id", "th", "digest").join(keep.where(~large).hint("merge"), "digest")
    cols = ["doc_id", "th", "digest", "keep_id", "group_size"]
    out = few.select(*cols).unionByName(met.where("group_size is not null").select(*cols))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()))


def exact_dedup(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Which row of each group of equal texts stays.

    Returns a row for each input row, dropped ones too: doc_id, keep_id, group_size (rows of this batch), kept,
    text_sha256. In a batch, of equal texts the largest doc_id stays. If an earlier batch put the text into the index,
    the earlier row stays and keep_id names it. Null and empty texts are equal. Rows with one doc_id and one text are
    one group and all of them show kept; a null doc_id is smaller than any other, and a group with only null ids has a
    null keep_id and kept = true. Other columns of docs are ignored. An empty batch leaves the index as it is.
    """
    return _decide(docs, index, id_col, text_col).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs that stay, all columns; of rows repeated in full (one id, one text but for A-Z) one stays.

    Only texts that may go are shuffled. What is decided is written, so the index is not read by the result.
    """
    rows = cut(_decide(docs, index, id_col, text_col).select(F.col("doc_id").alias("id"), "th", "digest", "kept"), "digests-decided")
    gone = rows.where("not kept").select("id", "th")
    stay = rows.where("kept")
    several = stay.groupBy("id", "digest").agg(F.count("*").alias("n"), F.collect_set("th").alias("ths")).where("n > 1")
    repeated = several.select("id", F.explode("ths").alias("th"))
    rest, some = split_rows(docs, gone.unionByName(repeated), id_col, text_col)
    g = gone.select(F.col("id").alias("__gone_id"), F.col("th").alias("__gone_th"))
    left = some.join(g, some[id_col].eqNullSafe(g["__gone_id"]) & (some["__th"] == g["__gone_th"]), "left_anti").drop("__th")
    return rest.unionByName(left.withColumn("__digest", _digest(text_col)).dropDuplicates([id_col, "__digest"]).drop("__digest"))


def fresh_index(spark: SparkSession) -> DigestIndex:
    """A new, empty index with a bucket for each shuffle partition."""
    return DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = fresh_index(spark)
    out = cut(exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), index), "exact-dedup")
    index.drop()
    return out


SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d
"""
