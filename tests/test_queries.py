"""Every query of the core runs; those with SQL give the same rows."""

from __future__ import annotations

import pytest

from adloom.plans import all_catalogues
from tests.oracle import connection, difference

QUERIES = {n: q for c in all_catalogues() for n, q in c.queries.items()}
SQL = {n: q for c in all_catalogues() for n, q in c.sql.items()}


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    assert len(df.columns) == len({c.lower() for c in df.columns})
    if name in SQL:
        mine, other = difference(df, duck, SQL[name])
        assert not mine and not other, (list(mine)[:3], list(other)[:3])
    else:
        # Twice the same number of rows, and some.
        n = df.count()
        assert n > 0 and QUERIES[name](spark, sf_dir).count() == n
