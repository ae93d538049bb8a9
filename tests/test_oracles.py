"""Every registered query against its SQL in DuckDB, on the smallest given tables."""

import pytest

import __spark_entry__ as contract
import check_oracles

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check_oracles.connect(SF_DIR)


def test_every_query_has_sql():
    assert contract.ledger_queries().keys() <= contract.oracle_sql().keys()


NAMES = [n for n in contract.ledger_queries() if not n.endswith(contract.SPREAD_SUFFIX)]


def test_second_names_are_the_same_queries():
    queries = contract.ledger_queries()
    for name in queries.keys() - set(NAMES):
        assert queries[name] is queries[name.removesuffix(contract.SPREAD_SUFFIX)]


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, con, name):
    assert check_oracles.compare(spark, con, name, SF_DIR) is None


def test_entry(spark):
    assert contract.entry(spark).columns == ["decile", "customers", "total_value", "pct_of_total_value"]
