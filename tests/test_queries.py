"""Every query against its SQL."""

import pytest

from leafmill.queries import ORACLE_SQL, QUERIES
from tests.conftest import rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck, sf_dir):
    made = QUERIES[name](spark, sf_dir).toPandas()
    assert len(made)
    if name in ORACLE_SQL:
        wanted = duck.execute(ORACLE_SQL[name]).df()
        assert sorted(made.columns) == sorted(wanted.columns)
        a, b = rows(made), rows(wanted)
        assert len(a) == len(b)
        assert [x for x, y in zip(a, b, strict=True) if tuple(map(_number, x)) != tuple(map(_number, y))][:3] == []


def _number(x):
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x


def test_batches_hold_all(spark, sf_dir):
    made = QUERIES["budget_batches"](spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    assert sorted(made["doc_id"]) == sorted(docs["doc_id"])
    sums = made.groupby(["lang", "batch"])["n_chars"].agg(["sum", "size"])
    assert ((sums["sum"] <= 2_000_000) | (sums["size"] == 1)).all()


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
