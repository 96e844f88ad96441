"""Functions and parsers on small tables with the values expected of them."""

import duckdb
import pytest

from lodestone.functions import queries as functions
from lodestone.operators import answers
from lodestone.sources import queries as sources
from test_queries import normal

LITERALS = {**functions.LITERALS, **answers.LITERALS, **sources.LITERALS}


@pytest.mark.parametrize("name", sorted(LITERALS))
def test_literal(name, spark):
    make, sql = LITERALS[name]
    mine = make(spark).toArrow()
    cursor = duckdb.execute(sql)
    names = [c[0] for c in cursor.description]
    rows = lambda rs: sorted(repr([normal(v) for v in r]) for r in rs)
    assert rows([r[c] for c in names] for r in mine.to_pylist()) == rows(cursor.fetchall())
