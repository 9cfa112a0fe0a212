"""Every registered query of the engine against its SQL, and the entry points."""

import duckdb
import pytest

import __spark_entry__
from statutum.plans import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    return repr(round(float(v), 6)) if isinstance(v, float) or type(v).__name__ == "Decimal" else repr(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, sf_dir, con, name):
    frame = QUERIES[name](spark, sf_dir)
    found = con.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(frame.columns)
    order = [names.index(c) for c in frame.columns]
    want = sorted(tuple(plain(r[i]) for i in order) for r in found.fetchall())
    assert sorted(tuple(plain(v) for v in r) for r in frame.collect()) == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns[0] == "draft_id"
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
