"""Every registered query with SQL against DuckDB on the small tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from marea.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, tmp_path, name):
    path = os.path.join(tmp_path, name)
    QUERIES[name](spark, SF).write.parquet(path)
    duck.execute(f"CREATE OR REPLACE TABLE wanted AS {ORACLE_SQL[name]}")
    names = sorted(r[0] for r in duck.execute("DESCRIBE wanted").fetchall())
    assert names == sorted(r[0] for r in duck.execute(f"DESCRIBE SELECT * FROM '{path}/*.parquet'").fetchall())
    listed = ", ".join(f'"{n}"' for n in names)
    for a, b in (("wanted", f"'{path}/*.parquet'"), (f"'{path}/*.parquet'", "wanted")):
        assert duck.execute(f"SELECT {listed} FROM {a} EXCEPT ALL SELECT {listed} FROM {b} LIMIT 3").fetchall() == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
