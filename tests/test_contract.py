"""The driver's contract, and queries against their SQL."""

import os
import shutil
import subprocess
import sys

import pytest

from conftest import ROOT, TESTDATA


def test_every_sql_has_its_query():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 50 and callable(entry.entry)


def test_entry_without_the_optional_part(tmp_path):
    shutil.copytree(f"{ROOT}/quillmap", tmp_path / "quillmap", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(sorted(n for n in e.queries() if n.startswith('op') or n == 'pipeline'), len(e.oracle_sql()) > 30)"
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True, timeout=120)
    assert got.stdout.strip().splitlines()[-1:] == ["[] True"], got.stderr


@pytest.mark.parametrize("name", ["src_html_text", "src_payload_entries", "fn_words", "idx_page_routes", "tbl_filled_pages", "eval_report_diff", "ctx_relative_date", "cand_phrases"])
def test_query_equals_its_sql(spark, name):
    import duckdb

    from quillmap import queries

    con = duckdb.connect()
    for f in os.listdir(TESTDATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{TESTDATA}/{f}')")
    want = con.execute(queries.SQL[name]).df()
    got = queries.QUERIES[name](spark, TESTDATA).toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda df: sorted(tuple("" if v is None or v != v else str(v) for v in r) for r in df[columns].astype(object).itertuples(index=False))
    assert key(got) == key(want)
