"""Every named query against its DuckDB statement, on the small tables."""

from __future__ import annotations

import pytest

from pagelathe import catalog
from tests.oracle import SMALL, duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_its_oracle(spark, name):
    got, want = spark_rows(catalog.QUERIES[name](spark, SMALL)), duck_rows(catalog.ORACLES[name])
    assert got == want, f"only Spark: {list((got - want).items())[:3]}; only DuckDB: {list((want - got).items())[:3]}"


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs_without_oracle(spark, name):
    rows = catalog.QUERIES[name](spark, SMALL)
    assert rows.count() > 0
    assert len(set(rows.columns)) == len(rows.columns)


def test_every_oracle_has_its_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
