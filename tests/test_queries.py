"""Each query against its SQL on DuckDB."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from gridloom.plans.registry import ORACLES, QUERIES

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-5)
    return a == b


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, str(DATA))
    rows = got.collect()
    assert rows
    if name in ORACLES:
        result = duck.execute(ORACLES[name])
        columns = [d[0] for d in result.description]
        want = result.fetchall()
        assert sorted(got.columns) == sorted(columns)
        order = sorted(columns)
        pick = lambda rows, cols: sorted((tuple(r[cols.index(c)] for c in order) for r in rows), key=lambda t: tuple((x is None, round(x, 3) if isinstance(x, float) else x) if not isinstance(x, str) else (False, x) for x in t))
        a, b = pick([tuple(r) for r in rows], got.columns), pick(want, columns)
        assert len(a) == len(b)
        wrong = [(x, y) for x, y in zip(a, b, strict=True) if not all(map(same, x, y))]
        assert not wrong, wrong[:3]
