"""Whole rows are placed, and a hot key is written by many tasks."""

from canonry.llm import sharding
from tests.conftest import DATA


def test_query_places_whole_rows(spark):
    plan = sharding.query(spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    join = next(i for i, x in enumerate(lines) if "BroadcastHashJoin" in x)
    assert any("text:string" in x for x in lines if "ReadSchema" in x) and not any("concat_ws" in x for x in lines[join + 1 :])


def test_hot_key_is_split(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = spark.range(800).selectExpr("'one' AS key", "id")
    sharding.write_shards(rows, str(tmp_path / "out"), "key")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = list((tmp_path / "out").rglob("*.parquet"))
    assert len(files) > 1 and spark.read.parquet(str(tmp_path / "out")).select("id").distinct().count() == 800
