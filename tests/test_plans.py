"""What plans leave out."""

from conftest import TESTDATA
from quillmap.queries import QUERIES


def test_recovery_is_not_run_where_all_is_found(spark):
    """Totals are found as numbers and dates as dates, so no group of candidates goes through Python."""
    plan = QUERIES["resolve_fields"](spark, TESTDATA)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan
