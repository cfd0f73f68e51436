"""Every query with SQL gives the rows that DuckDB gives; the others give rows."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from tallyloom.registry import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if isinstance(v, (int, float)) or type(v).__name__ in ("Decimal", "int64", "int32", "float64"):
        return f"{float(v):.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows, columns = [tuple(r) for r in df.collect()], df.columns
    if name not in ORACLE_SQL:
        assert len(columns) == len(set(columns))
        return
    got = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(columns) == sorted(names)
    by = [names.index(c) for c in columns]
    want = [tuple(r[i] for i in by) for r in got.fetchall()]
    assert sorted(tuple(map(plain, r)) for r in rows) == sorted(tuple(map(plain, r)) for r in want)
