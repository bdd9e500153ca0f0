"""Driver contract: entry runs, every query has an oracle, and each matches DuckDB."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare

SMALL = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "name", "region", "total_orders", "total_amount", "last_order_date"]
    assert df.count() > 0


def test_every_query_has_an_oracle():
    own = entry._own_queries()
    assert set(own) == set(entry._own_oracle_sql()) and set(own) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry._own_queries()))
def test_query_matches_oracle(spark, name):
    r = compare(spark, SMALL, name, entry.queries()[name], entry.oracle_sql()[name])
    assert r["columns_match"] and r["rows"][0] == r["rows"][1] and r["hash_match"], r
