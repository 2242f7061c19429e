"""Every registered query of the engine against the SQL that says the same."""

import os

import duckdb
import pytest

from docfold.plans import run_queries
from docfold.plans.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return con


#: These change the ledger of the run that they look at; the others look at one run.
CHANGING = ("c11_restore", "k10_uncommitted")
RAN: dict = {}


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, db, name, monkeypatch):
    if name not in CHANGING:
        real = run_queries.ran
        monkeypatch.setattr(run_queries, "ran", lambda s, sf: RAN.get(sf) or RAN.setdefault(sf, real(s, sf)))
    df = queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert rows
    if name in oracle_sql():
        out = db.execute(oracle_sql()[name])
        names = [d[0] for d in out.description]
        assert sorted(names) == columns
        assert rows == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in out.fetchall()), key=repr)
