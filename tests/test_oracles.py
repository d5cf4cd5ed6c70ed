"""Every query with SQL gives that SQL's rows at the smallest scale."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from strata import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, duck, sf_dir, name):
    got = registry.queries()[name](spark, sf_dir)
    columns = sorted(got.columns)
    sql = registry.oracle_sql()[name]
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({sql}) x").fetchall()
    key = lambda row: [str(x) for x in row]
    assert sorted(([norm(x) for x in r] for r in got.select(*columns).collect()), key=key) == sorted(([norm(x) for x in r] for r in want), key=key)
