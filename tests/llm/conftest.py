import pytest


@pytest.fixture(scope="session")
def con():
    import os

    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{folder}/{name}'")
    return con
