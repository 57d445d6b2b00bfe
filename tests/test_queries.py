"""Every registered query against its SQL in DuckDB, at the smallest scale; and the entry module without its options."""

import datetime
import math
import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"
sys.path.insert(0, ROOT)
from quirefold.plans import registry  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES, QUERIES = registry.oracle_sql(), registry.queries()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return connection


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(map(repr, (tuple(plain(v) for v in r) for r in df.select(*(f"`{c}`" for c in columns)).collect())))
    if name in ORACLES:
        found = duck.sql(ORACLES[name])
        assert sorted(found.columns) == columns
        at = [found.columns.index(c) for c in columns]
        assert got == sorted(map(repr, (tuple(plain(r[i]) for i in at) for r in found.fetchall())))
    else:
        assert name in {"wer_all", "error_rates_by_role", "unmatched_all"} and got


def test_entry_works_without_the_optional_parts(tmp_path):
    import shutil

    for part in ("quirefold", "__spark_entry__.py"):
        (shutil.copytree if os.path.isdir(f"{ROOT}/{part}") else shutil.copy)(f"{ROOT}/{part}", tmp_path / part)
    shutil.rmtree(tmp_path / "quirefold" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 50 and set(o) <= set(q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
