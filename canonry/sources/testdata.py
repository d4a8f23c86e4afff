"""The test tables as the engine's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from canonry.functions.text import GROUP
from canonry.operators.judge import rule_answer


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def part_values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(F.lit("p_name").alias("attr"), F.col("p_type").alias("con"), F.col("p_name").alias("value")).agg(F.count("*").alias("freq"))


def order_values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.lit("o_orderpriority").alias("attr"), F.col("o_orderstatus").alias("con"), F.col("o_orderpriority").alias("value")).agg(F.count("*").alias("freq"))


def values(spark: SparkSession, d: str) -> DataFrame:
    return part_values(spark, d).unionByName(order_values(spark, d))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.lit("vec").alias("attr"), F.col("label").cast("string").alias("con"), F.col("vec_id").cast("string").alias("value"), "embedding")


def last_word(c):
    return F.element_at(F.split(c, " "), -1)


def gold(spark: SparkSession, d: str) -> DataFrame:
    """Values with one last word are a cluster."""
    v = part_values(spark, d).withColumn("cluster_name", last_word(F.col("value")))
    n = F.count("*").over(W.partitionBy(*GROUP, "cluster_name"))
    return v.select(*GROUP, "cluster_name", "value", F.when(n > 1, "cluster").otherwise("single").alias("kind"))


def members(spark: SparkSession, d: str) -> DataFrame:
    """Values with one first letter are a cluster."""
    return part_values(spark, d).select(*GROUP, F.ascii("value").alias("cluster_id"), "value")


def verdicts(sims: DataFrame) -> DataFrame:
    """Answers of the rule judge for the pairs whose first value has an even length."""
    return sims.where("length(v1) % 2 = 0").select(*GROUP, F.lower("v2").alias("k1"), F.lower("v1").alias("k2"), rule_answer(F.col("v1"), F.col("v2")).alias("answer"))
