"""Every registered query that has an oracle gives what DuckDB gives."""

from __future__ import annotations

import datetime
import decimal
import os

import pytest

from lamina.plans.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_oracle(spark, db, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(canon(r[c]) for c in cols)) for r in df.collect())
    r = db.execute(ORACLES[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    assert got == sorted(repr(tuple(canon(row[names.index(c)]) for c in cols)) for row in r.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_betweenness_counts_customers(spark, db):
    count = lambda table, key: dict(db.execute(f"select {key}, count(*) from {table} group by all").fetchall())
    customers, suppliers = count("customer", "c_nationkey"), count("supplier", "s_nationkey")
    n = sum(db.execute(f"select count(*) from {t}").fetchone()[0] for t in ("region", "nation", "supplier", "customer"))
    # Paths run from a customer or a supplier over its nation to the one region of it.
    want = {f"n{k}": (customers.get(k, 0) + suppliers.get(k, 0)) / ((n - 1) * (n - 2)) for k in customers.keys() | suppliers.keys()}
    got = {r["id"]: r["score"] for r in QUERIES["grf2_betweenness"](spark, SF).collect()}
    assert got == pytest.approx(want)
