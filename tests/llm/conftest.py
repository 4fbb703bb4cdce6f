import compare
import pytest


@pytest.fixture(scope="session")
def con(sf):
    con = compare.connect(sf)
    for name in "documents embeddings pages labels conversations".split():
        con.execute(f"create view {name} as select * from read_parquet('{sf}/{name}.parquet')")
    return con
