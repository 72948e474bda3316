"""Queries with SQL, against it."""

import pytest

from leafmill.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import rows
from tests.test_queries import _number


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(name, spark, duck, sf_dir):
    made, wanted = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(made.columns) == sorted(wanted.columns)
    a, b = rows(made), rows(wanted)
    assert len(a) == len(b)
    assert [x for x, y in zip(a, b, strict=True) if tuple(map(_number, x)) != tuple(map(_number, y))][:3] == []
