"""Every registered query of the library against its SQL, on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from tessera.plans import catalogue
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(SMALL):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SMALL}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.10g}") + 0.0
    return v


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((repr([plain(r[i]) for i in order]) for r in rows))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_matches_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SMALL)
    found = table(df.columns, [[float(v) if hasattr(v, "as_tuple") else v for v in r] for r in df.collect()])
    cursor = duck.execute(catalogue.ORACLE[name])
    names = [d[0] for d in cursor.description]
    wanted = table(names, [[float(v) if hasattr(v, "as_tuple") else v for v in r] for r in cursor.fetchall()])
    assert found[0] == wanted[0]
    norm = lambda rows: [r.replace(".0,", ",").replace(".0]", "]") for r in rows]
    assert sorted(norm(found[1])) == sorted(norm(wanted[1]))


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SMALL).count() > 0
