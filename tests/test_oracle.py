"""Every registered query with SQL against DuckDB on the smallest tables; every other one runs and has rows."""

import duckdb
import pytest

from vibespark import roster, roster_kernels  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(roster.ORACLE))
def test_same_rows(spark, duck, name):
    d = roster.QUERIES[name](spark, SF)
    r = duck.execute(roster.ORACLE[name])
    cols = sorted(x[0] for x in r.description)
    assert cols == sorted(d.columns)
    at = [[x[0] for x in r.description].index(c) for c in cols]
    want = sorted((tuple(row[k] for k in at) for row in r.fetchall()), key=repr)
    got = sorted((tuple(x) for x in d.select(*cols).collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", [n for n in roster.QUERIES if n not in roster.ORACLE and n not in ("shock_vibe_metrics", "rolling_metrics")])
def test_runs(spark, name):
    assert roster.QUERIES[name](spark, SF).limit(1).count() == 1
