"""Registered queries against their DuckDB oracle at sf0.001 (the driver uses sf0.01)."""

import math

import duckdb
import pytest

from cohortlens.plans import registry
from tests.conftest import SF001

registry.load_all()
TABLES = "orders customer lineitem events".split()
FAST = [n for n in registry.ORACLE]


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    rows = [tuple(_norm(r[c]) for c in cols) for r in pdf.to_dict("records")]
    return cols, sorted(rows, key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    sdf = registry.QUERIES[name](spark, SF001)
    got = sdf.toPandas()
    want = con.execute(registry.ORACLE[name]).df()
    for c in want.columns:           # DuckDB dates come back as timestamps
        if str(want[c].dtype).startswith("datetime") and c in got and got[c].dtype == object:
            want[c] = want[c].dt.date
    assert _rows(got) == _rows(want)
