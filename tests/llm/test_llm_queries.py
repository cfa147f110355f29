"""The training-data queries against their SQL, and the registered names."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from compare import DATA, connect, same  # noqa: E402

from tidemark.llm import registry  # noqa: E402

ORACLE = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    same(registry.queries()[name](spark, DATA), ORACLE[name], connect())


def test_names():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names}
    assert "pipeline" in names
