"""Every registered query of the library against its SQL on the smallest tables."""

import ast
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from argloom.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(frame):
    frame = frame.reindex(sorted(frame.columns), axis=1)
    cell = lambda v: None if pd.isna(v) else round(float(v), 6) if isinstance(v, float) else str(v)
    return list(frame.columns), sorted((tuple(map(cell, r)) for r in frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF)
    if name not in ORACLE_SQL:
        assert got.columns and got.count() > 0
        return
    assert rows(got.toPandas()) == rows(con.sql(ORACLE_SQL[name]).df())


def test_entry_module():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


def test_no_module_imports_two_things_under_one_name():
    for path in Path(__file__).resolve().parent.parent.joinpath("argloom").rglob("*.py"):
        names = [a.asname or a.name for x in ast.parse(path.read_text()).body if isinstance(x, ast.Import | ast.ImportFrom) for a in x.names]
        assert len(names) == len(set(names)), path
