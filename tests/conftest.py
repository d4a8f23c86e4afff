import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [str(ROOT), os.environ.get("PYTHONPATH", "")]))
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/sf0.01/{t}.parquet'")
    return c


def rows_of(pdf):
    """Rows as sorted tuples, by column name, numbers as floats."""
    cols = sorted(pdf.columns)
    norm = lambda v: None if v is None or v != v else (float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v)
    return cols, sorted((tuple(norm(v.item() if hasattr(v, "item") else v) for v in r) for r in pdf[cols].itertuples(index=False)), key=repr)
