"""Every registered query of the library against its SQL."""

import pytest
from compare import DATA, connect, same

from tidemark.plans import registry

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DATA)
    if name in ORACLE:
        same(df, ORACLE[name], con)
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() == 5550
    assert df.where("status = 'ok'").count() > 0
