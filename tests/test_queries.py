"""Every registered query against its SQL twin on the smallest driver tables."""

import os

import pytest

from __spark_entry__ import oracle_sql, queries
from check import connect, difference

SF = "/root/testdata/sf0.001"
SQL = oracle_sql()
# No twin: model outputs.
ROWS_ONLY = sorted(set(queries()) - set(SQL))

# Queries that train several models at full rounds; others here train by the same code. `python check.py` compares them, too.
SLOW = {"M4_probability", "O5_importance", "S12_model_sink", "C5_end_to_end", "T3_report_requests", "A18_observed_counts"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_twin_has_a_query():
    assert set(SQL) <= set(queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    if name in SLOW and not os.environ.get("RACEFORM_SLOW"):
        pytest.skip("set RACEFORM_SLOW")
    assert difference(queries()[name](spark, SF).toPandas(), duck.sql(SQL[name]).df()) is None


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_query_without_twin_has_rows(spark, name):
    assert queries()[name](spark, SF).count() > 0
