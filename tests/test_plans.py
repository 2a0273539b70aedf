"""Physical plans: how often a table reads its source and shuffles."""

import pytest

from tallyrun.plans import catalogue


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("pack, scans, exchanges, sorts", [("small", 1, 1, 0), ("large", 1, 1, 0), ("large_with_sketches", 3, 6, 0), ("ordinal", 2, 3, 9)])
def test_readings_of_the_source(spark, pack, scans, exchanges, sorts):
    """One reading for the table, one for all features that count values first, and a column of times if the query time is asked for."""
    found = plan(catalogue.queries()[f"pack_{pack}"](spark, "/root/testdata/sf0.001"))
    assert found.count("FileScan") <= scans and found.count("Exchange") <= exchanges and found.count("SortAggregate") <= sorts, found


def test_exact_quantile_counts_first(spark):
    found = plan(catalogue.queries()["agg_quantile"](spark, "/root/testdata/sf0.001"))
    assert "percentile" not in found
