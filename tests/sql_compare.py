"""Compare registered queries with their SQL in DuckDB on the smallest tables."""

import os
from collections import Counter
from decimal import Decimal
from pathlib import Path

import pytest

DATA = os.environ.get("TIDEMARK_TESTDATA", "/root/testdata/sf0.001")


def database():
    duckdb = pytest.importorskip("duckdb")
    if not Path(DATA).is_dir():
        pytest.skip(f"no test tables in {DATA}")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p if p.is_file() else p / '*.parquet'}'")
    return con


def plain(v):
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return bytes(v) if isinstance(v, (bytes, bytearray)) else v


def same(spark, con, query, sql):
    df = query(spark, DATA)
    cols = sorted(df.columns)
    got = Counter(tuple(map(plain, r)) for r in df.select(*(f"`{c}`" for c in cols)).collect())
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    want = Counter(tuple(plain(r[i]) for i in order) for r in cur.fetchall())
    assert got == want
