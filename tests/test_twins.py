"""Every registered query beside its DuckDB twin on the smallest data."""

import pytest

from proplytics.plans import load_all
from proplytics.plans.registry import ORACLES, QUERIES
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"
load_all()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        verdict = compare(df, con, ORACLES[name])
        assert verdict is None, verdict
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
