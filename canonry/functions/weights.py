"""tf, idf and tf-idf weights of pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from canonry.functions.text import GROUP, r4


def tf(pieces: DataFrame) -> DataFrame:
    """(…, tf): the piece's share of its value's pieces, to four places."""
    whole = F.sum("cnt").over(W.partitionBy(*GROUP, "value"))
    return pieces.withColumn("tf", r4(F.col("cnt") / whole)).select(*GROUP, "value", "piece", "tf")


def weighted_df(pieces: DataFrame, values: DataFrame) -> DataFrame:
    """(attr, con, piece, df, n): frequencies of the values that have the piece, and of all values."""
    total = values.groupBy(*GROUP).agg(F.sum("freq").alias("n"))
    df = pieces.select(*GROUP, "value", "piece").distinct().join(values.select(*GROUP, "value", "freq"), [*GROUP, "value"], "left").groupBy(*GROUP, "piece").agg(F.sum(F.coalesce("freq", F.lit(1))).alias("df"))
    return df.join(total, GROUP).select(*GROUP, "piece", "df", "n")


def idf(pieces: DataFrame, values: DataFrame) -> DataFrame:
    return weighted_df(pieces, values).select(*GROUP, "piece", r4(F.log10(F.col("n") / F.col("df"))).alias("idf"))


def tfidf(pieces: DataFrame, values: DataFrame) -> DataFrame:
    """(attr, con, value, piece, w): tf * idf, each to four places."""
    return tf(pieces).join(idf(pieces, values), [*GROUP, "piece"]).select(*GROUP, "value", "piece", r4(F.col("tf") * F.col("idf")).alias("w"))


def idf_vector(pieces: DataFrame, values: DataFrame) -> DataFrame:
    return pieces.select(*GROUP, "value", "piece").join(idf(pieces, values), [*GROUP, "piece"]).select(*GROUP, "value", "piece", F.col("idf").alias("w"))
