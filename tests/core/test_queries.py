"""Every registered query against its SQL, run by another engine on the same tables."""

import math
import os

import duckdb
import pytest
from waymark.plans import queries as Q

SF = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 4) if math.isfinite(value) else str(value)
    return value


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_like_its_sql(spark, duck, name):
    got = Q.queries()[name](spark, SF)
    want = duck.execute(Q.oracle_sql()[name])
    columns = sorted(got.columns)
    names = [d[0] for d in want.description]
    assert columns == sorted(names)
    mine = sorted(([plain(r[c]) for c in columns] for r in got.collect()), key=repr)
    theirs = sorted(([plain(r[names.index(c)]) for c in columns] for r in want.fetchall()), key=repr)
    assert len(mine) == len(theirs) and len(mine) > 0
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_has_rows(spark, name):
    assert Q.queries()[name](spark, SF).count() > 0
