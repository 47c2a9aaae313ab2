"""Every registered query against its oracle SQL, and the others for rows and a stable schema."""

import pytest

from casewell.plans import registry

from .conftest import SF
from .oracle import connection, difference


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, sf, con, name):
    assert difference(spark, sf, registry.QUERIES[name], registry.ORACLES[name], con) is None


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_rows(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    assert len(df.columns) == len(set(df.columns))
    df.count()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["vehicle", "plaza", "first_ts", "last_ts", "visits"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
