"""Every registered query of the core library gives the rows of its SQL."""

import pytest

from tests.conftest import DATA
from tests.oracle import spark_rows, sql_rows
from vectorloom.plans import catalogue

catalogue.load_all()


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    names, rows = spark_rows(catalogue.QUERIES[name](spark, DATA))
    expected_names, expected = sql_rows(DATA, catalogue.ORACLES[name])
    assert names == expected_names
    assert rows == expected
    assert rows


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_registering_twice_fails():
    with pytest.raises(ValueError):
        catalogue.register("knn_topk", lambda s, d: None)
