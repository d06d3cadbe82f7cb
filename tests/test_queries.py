"""Every registered query of the catalogue against DuckDB, or that it gives rows."""

import pytest

from larder import plans

from .oracle import SF, same


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query(spark, name):
    df = plans.QUERIES[name](spark, SF)
    if name in plans.ORACLES:
        same(df, plans.ORACLES[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
