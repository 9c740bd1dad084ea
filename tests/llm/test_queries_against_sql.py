import math
from collections import Counter

import pytest

from loomstat.llm.queries import QUERIES
from loomstat.llm.sql import SQL

FOLDER = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.6g}"
    return None if v is None else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    told = con.execute(SQL[name])
    columns = [c[0] for c in told.description]
    assert sorted(columns) == sorted(df.columns)
    rows = Counter(tuple(plain(v) for v in r) for r in told.fetchall())
    assert Counter(tuple(plain(r[c]) for c in columns) for r in df.collect()) == rows


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
