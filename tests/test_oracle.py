"""Every query of the library's own against its SQL on DuckDB, over whole tables."""

import math

import duckdb
import pytest

from wavelake.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    own = duckdb.connect()
    for t in ("embeddings", "events", "supplier", "documents", "labels"):
        own.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return own


def plain(rows):
    return sorted(tuple("null" if x is None or x != x else f"{x:.6g}" if isinstance(x, float) and abs(x) > 1e-9 else 0 if isinstance(x, float) else x for x in r) for r in rows)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    assert got
    for r in got:
        assert not any(isinstance(x, float) and math.isinf(x) for x in r)
    if name in ORACLE_SQL:
        names = [x[0] for x in db.execute(ORACLE_SQL[name]).description]
        want = db.fetchall()
        assert sorted(names) == sorted(df.columns)
        mine = [tuple(r[c] for c in names) for r in got]
        assert len(mine) == len(want)
        for a, b in zip(sorted(mine, key=order), sorted(want, key=order), strict=True):
            assert len(a) == len(b)
            for x, y in zip(a, b, strict=True):
                assert x == y or isinstance(x, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-6), (names, a, b)


def order(row):
    return tuple((x is None, round(x, 4) if isinstance(x, float) else x if x is not None else 0) for x in row)
