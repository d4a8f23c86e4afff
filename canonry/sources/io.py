"""Readers and writers of the file formats, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GOLD = "clusters map<string,array<string>>, single_vs array<string>, noadded_vs array<string>, error_vs array<string>"
BANNER = r"-{8}the (?:attribute|concept) currently processed is:\s*\n"


def _document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A single JSON document as one value; a malformed one fails."""
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("d"))


def _groups(doc: DataFrame) -> DataFrame:
    attrs = doc.select(F.explode("d").alias("attr", "cons"))
    return attrs.select("attr", F.explode("cons").alias("con", "x"))


def read_values(spark: SparkSession, path: str) -> DataFrame:
    """{attr: {con: {value: [[originals], freq]}}} as (attr, con, value, originals, freq); freq is the last element."""
    rows = _groups(_document(spark, path, "map<string,map<string,map<string,array<string>>>>")).select("attr", "con", F.explode("x").alias("value", "info"))
    return rows.select("attr", "con", "value", F.from_json(F.element_at("info", 1), "array<string>").alias("originals"), F.element_at("info", -1).cast("long").alias("freq"))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """(attr, con, cluster_name, value, kind); single_vs and the older noadded_vs are the same."""
    g = _groups(_document(spark, path, f"map<string,map<string,struct<{GOLD.replace(' map', ':map').replace(' array', ':array')}>>>"))
    return flatten_gold(g.select("attr", "con", "x.*"))


def flatten_gold(nested: DataFrame) -> DataFrame:
    keys = ["attr", "con"]
    singles = F.coalesce("single_vs", "noadded_vs") if "noadded_vs" in nested.columns else F.col("single_vs")
    clusters = nested.select(*keys, F.explode("clusters").alias("cluster_name", "vs")).select(*keys, "cluster_name", F.explode("vs").alias("value"), F.lit("cluster").alias("kind"))
    single = nested.select(*keys, F.explode(singles).alias("value")).select(*keys, F.concat(F.lit("single:"), "value").alias("cluster_name"), "value", F.lit("single").alias("kind"))
    error = nested.select(*keys, F.explode("error_vs").alias("value")).select(*keys, F.lit("error").alias("cluster_name"), "value", F.lit("error").alias("kind"))
    return clusters.unionByName(single).unionByName(error)


def gold_values(gold: DataFrame) -> DataFrame:
    """Distinct values that gold has in clusters or alone."""
    return gold.where("kind <> 'error'").select("attr", "con", "value").distinct()


def target_filter(rows: DataFrame, targets: list[str], by_concept: bool) -> DataFrame:
    """Rows of the wanted groups: targets name attr, or attr_con."""
    key = F.concat_ws("_", "attr", "con") if by_concept else F.col("attr")
    return rows.where(key.isin(targets))


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """CSV without a header: value, "[f, …]"."""
    rows = spark.read.csv(path, schema="value string, e string", quote='"', escape='"', multiLine=True)
    return rows.select("value", F.from_json("e", "array<double>").alias("embedding"))


def read_sim_file(spark: SparkSession, path: str) -> DataFrame:
    """The block format: banner, attr, banner, con, one line of JSON. A malformed line gives no pairs."""
    blocks = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", BANNER)).alias("i", "b")).where("i > 0")
    attr = blocks.where("i % 2 = 1").select(F.col("i"), F.trim("b").alias("attr"))
    rest = blocks.where("i % 2 = 0").select((F.col("i") - 1).alias("i"), F.split("b", "\n", 2).alias("p"))
    pairs = attr.join(rest, "i").select(F.regexp_replace("attr", r"\s+$", "").alias("attr"), F.trim(F.col("p")[0]).alias("con"), F.from_json(F.col("p")[1], "map<string,double>").alias("m"))
    each = pairs.select("attr", "con", F.explode(F.coalesce("m", F.expr("map()"))).alias("k", "sim"))
    v = F.split("k", "--##--")
    return each.select("attr", "con", F.least(v[0], v[1]).alias("v1"), F.greatest(v[0], v[1]).alias("v2"), "sim").dropDuplicates(["attr", "con", "v1", "v2"])


def sim_lines(sims: DataFrame) -> DataFrame:
    """Blocks of the same format, a row a group."""
    m = F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.concat_ws("--##--", "v1", "v2").alias("k"), F.col("sim").alias("v")))))
    banner = lambda x: F.lit(f"--------the {x} currently processed is:\n")
    g = sims.groupBy("attr", "con").agg(F.to_json(m).alias("j"))
    return g.select(F.concat(banner("attribute"), "attr", F.lit("\n"), banner("concept"), "con", F.lit("\n"), "j", F.lit("\n")).alias("value"))


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    return _document(spark, path, "map<string,string>").select(F.explode("d").alias("key", "template"))


VERDICTS = "attr string, con string, k1 string, k2 string, answer string"


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """{attr: {con: {"v0#****#v1": answer}}}; a missing file is an empty table."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], VERDICTS)
    v = F.split("k", r"#\*{4}#")
    rows = _groups(_document(spark, path, "map<string,map<string,map<string,string>>>")).select("attr", "con", F.explode("x").alias("k", "answer"))
    return rows.select("attr", "con", v[0].alias("k1"), v[1].alias("k2"), "answer")


def write_clusters(clusters: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """(attr, con, value, cluster) as JSON lines attr, con, clusters: one list a cluster; refuses to overwrite by default."""
    c = clusters.groupBy("attr", "con", "cluster").agg(F.sort_array(F.collect_set("value")).alias("vs")).groupBy("attr", "con").agg(F.sort_array(F.collect_list("vs")).alias("clusters"))
    c.write.mode(mode).json(path)


def append_audit(audit: DataFrame, path: str) -> None:
    """Adds to the log of calls; nothing is written if there was none."""
    if not audit.isEmpty():
        audit.write.mode("append").parquet(path)
