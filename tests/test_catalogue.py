"""Every query of the catalogue against its SQL in DuckDB."""

import pytest

from canonry import catalogue
from tests.conftest import DATA, rows_of

SQL = catalogue.oracle_sql()
QUERIES = catalogue.queries()


def test_every_query_has_sql_or_is_known_not_to():
    assert set(QUERIES) - set(SQL) == set(catalogue.ROWS_ONLY)
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got = rows_of(QUERIES[name](spark, f"{DATA}/sf0.01").toPandas())
    want = rows_of(duck.execute(SQL[name]).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


@pytest.mark.parametrize("name", catalogue.ROWS_ONLY)
def test_rows_only(spark, name):
    assert QUERIES[name](spark, f"{DATA}/sf0.001").count() > 0
