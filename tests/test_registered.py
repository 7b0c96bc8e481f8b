"""Every registered query with SQL gives the SQL's rows on the smallest test tables."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry
import check

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, name):
    verdict = check.compare(spark, SF, name, entry.oracle_sql()[name])
    assert verdict.startswith("ok"), verdict


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "event_id" and df.count() == 1000


def test_python_functions_travel_with_the_job():
    from pyspark import cloudpickle

    import colwright  # noqa: F401

    assert "colwright" in cloudpickle.list_registry_pickle_by_value()
