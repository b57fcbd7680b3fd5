"""Every query that SQL can state, against DuckDB on the same Parquet files."""

import pytest

import __spark_entry__ as entry
from tools.check import compare

CHECKED = sorted(set(entry.oracle_sql()) & set(entry.queries()))


@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql(spark, duck, sf, name):
    result = compare(entry.queries()[name](spark, sf), duck, entry.oracle_sql()[name])
    assert result.startswith("ok"), result


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 11


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
