"""Every catalogued query against its SQL on the test tables."""

import pytest
from compare import compare, duck
from conftest import SF

from kinmatch.catalog import registry

QUERIES = registry.queries()
ORACLES = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, con, name):
    assert compare(spark, con, name, QUERIES[name], ORACLES[name], SF) == ""


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert {r["rank"] for r in rows} == set(range(1, 11))


def test_catalog_stands_alone(monkeypatch):
    """Without the training-data subpackage its queries are left out, and nothing else."""
    import sys

    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert entry.queries().keys() == QUERIES.keys() and entry.oracle_sql().keys() == ORACLES.keys()
