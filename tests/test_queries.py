"""Every query of the core against its SQL, and the entry without the optional subpackage."""

import math
import os
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from loomstat.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.6g}"
    return None if v is None else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    told = duck.execute(SQL[name])
    columns = [c[0] for c in told.description]
    assert sorted(columns) == sorted(df.columns)
    rows = Counter(tuple(plain(v) for v in r) for r in told.fetchall())
    assert Counter(tuple(plain(r[c]) for c in columns) for r in df.collect()) == rows


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_nothing_imports_the_optional_subpackage():
    root = Path(__file__).resolve().parents[1] / "loomstat"
    for file in root.rglob("*.py"):
        if "llm" not in file.relative_to(root).parts:
            assert "loomstat.llm" not in file.read_text(), file


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
