"""Every query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from tidemark.plans import house_queries  # noqa: F401  adds its queries
from tidemark.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows or name in ("gauge_current", "snap_open", "project_open")
    if name in ORACLE_SQL:
        found = db.execute(ORACLE_SQL[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == sorted(df.columns)
        want = sorted((tuple(r[names.index(c)] for c in df.columns) for r in found.fetchall()), key=str)
        assert sorted(map(tuple, rows), key=str) == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_the_rest_stands_without_llm():
    import subprocess
    import sys

    code = "import sys; sys.modules['tidemark.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'counter_hourly' in e.queries() and not any(q.startswith('op') for q in e.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])
