"""Every registered query against its SQL twin on the smallest tables."""

import pytest

from compare import difference, duck
from leadloom.plans import REGISTRY

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(n for n, q in REGISTRY.items() if q.sql))
def test_same_as_sql(spark, con, name):
    assert difference(REGISTRY[name](spark, FOLDER), con, REGISTRY[name].sql) is None


@pytest.mark.parametrize("name", sorted(n for n, q in REGISTRY.items() if not q.sql))
def test_runs(spark, name):
    df = REGISTRY[name](spark, FOLDER)
    assert df.columns and len(df.take(1)) == 1


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
