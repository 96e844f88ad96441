"""Every query of the engine against its SQL on the smallest tables."""

import decimal
import math

import duckdb
import pytest

from lodestone import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    return [normal(x) for x in v] if isinstance(v, list) else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(name, spark, sf_dir, duck):
    mine = catalog.queries()[name](spark, sf_dir).toArrow()
    names = sorted(mine.column_names)
    if name not in catalog.oracle_sql():
        assert mine.num_rows
        return
    cursor = duck.execute(catalog.oracle_sql()[name])
    theirs = [dict(zip([c[0] for c in cursor.description], r, strict=True)) for r in cursor.fetchall()]
    if theirs:
        assert sorted(theirs[0]) == names
    rows = lambda rs: sorted(repr([normal(r[c]) for c in names]) for r in rs)
    assert rows(mine.to_pylist()) == rows(theirs)


def test_every_sql_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
