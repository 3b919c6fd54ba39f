"""Every registered query against its SQL at the smallest scale."""

import pytest
from check_queries import compare, connect

from erashift.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
FITS = {"model_logreg", "model_ridge", "model_lasso", "model_rf", "model_gbt", "model_svm"}  # tested on a small frame


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_values(spark, duck, key):
    assert compare(QUERIES[key](spark, SF), duck, ORACLES[key]) is None


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLES) - FITS))
def test_rows_only(spark, key):
    assert QUERIES[key](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert len(df.columns) == 32 and set(entry.oracle_sql()) <= set(entry.queries())
