"""Every query with an oracle must equal its DuckDB SQL on the same parquet tables."""

import math

import duckdb
import pytest

from conftest import SF_ORACLE

import __spark_entry__ as entry
from cohortlens.fixtures import TABLES
from cohortlens.plans.catalog import ORACLES as CORE_ORACLES, QUERIES as CORE_QUERIES

ORACLES = CORE_ORACLES


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_ORACLE}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(spark, con, name):
    df = entry.queries()[name](spark, SF_ORACLE)
    cols = sorted(df.columns)
    srows = sorted((tuple(_norm(r[c]) for c in cols) for r in df.select(*cols).collect()), key=repr)
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    idx = [names.index(c) for c in cols]
    drows = sorted((tuple(_norm(r[i]) for i in idx) for r in cur.fetchall()), key=repr)
    assert len(srows) == len(drows)
    assert srows == drows


def test_every_query_has_a_check_kind():
    from cohortlens.plans.registry import ROWS_ONLY
    assert set(CORE_QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert set(ORACLES) | ROWS_ONLY == set(CORE_QUERIES)
    assert not set(ORACLES) & ROWS_ONLY
