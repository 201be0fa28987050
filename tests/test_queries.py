import pytest

from fringeworks.plans.queries import QUERIES, SQL

from .conftest import compare


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    compare(spark, duck, QUERIES[name], SQL[name])


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert rows and rows[0]["n_total"] == 1000
