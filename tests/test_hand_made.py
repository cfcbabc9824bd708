"""Every hand-made case gives the rows that are stated beside it."""

import duckdb
import hand_made
import pytest

from conftest import TESTDATA


@pytest.mark.parametrize("name", sorted(hand_made.QUERIES))
def test_case(spark, name):
    want = duckdb.sql(hand_made.SQL[name]).df()
    got = hand_made.QUERIES[name](spark, TESTDATA).toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda v: "" if v is None or v != v else repr(round(float(v), 6)) if isinstance(v, float) else str(v)
    rows = lambda df: sorted(tuple(map(plain, r)) for r in df[columns].astype(object).itertuples(index=False))
    assert rows(got) == rows(want)
