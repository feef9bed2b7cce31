import importlib.util

import pytest

import __spark_entry__ as entry
from conftest import SF
from ledgerlens import queries as core
from oracle import same

CORE, SQL = core.queries(), core.oracle_sql()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    same(CORE[name](spark, SF), SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(CORE) - set(SQL)))
def test_runs(spark, name):
    assert CORE[name](spark, SF).count() > 0


def test_every_query_is_registered():
    assert set(CORE) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    if importlib.util.find_spec("ledgerlens.llm") is None:
        assert set(entry.queries()) == set(CORE)
