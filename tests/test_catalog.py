import __spark_entry__
import pytest

from trackmotif import catalog


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_against_sql(name, spark, data, duck, same):
    got = catalog.queries()[name](spark, data).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
    else:
        same(got, duck.execute(sql).df())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
