"""Every registered query with a SQL oracle matches DuckDB on the smallest tables."""

import math

import pytest

import __spark_entry__ as E
from tests.conftest import SF

SQL = E.oracle_sql()



def _norm(v):
    if hasattr(v, "isoformat"):
        return str(v)[:26]
    if isinstance(v, float) and math.isnan(v):
        return None
    return v


def _rows(rows, cols, order):
    idx = [cols.index(c) for c in order]
    return sorted((tuple(_norm(r[i]) for i in idx) for r in rows), key=repr)


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_matches_duckdb(spark, duck, key):
    sdf = E.queries()[key](spark, SF)
    srows = [tuple(r) for r in sdf.collect()]
    res = duck.execute(SQL[key])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    order = sorted(dcols)
    a, b = _rows(srows, sdf.columns, order), _rows(drows, dcols, order)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            if isinstance(u, float) and isinstance(v, (int, float)):
                assert math.isclose(u, v, rel_tol=1e-6, abs_tol=1e-9)
            else:
                assert u == v or str(u) == str(v)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 8 and "p50" in df.columns
