"""Every registered query runs on the small tables and agrees with its SQL, when the data is there."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
CORE = [k for k in entry.queries() if not (k[0] == "p" and k[1].isdigit())]


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", CORE)
def test_query(spark, name):
    import duckdb

    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    rows = sorted(repr([norm(r[c]) for c in cols]) for r in df.collect())
    if name not in entry.oracle_sql():
        assert rows
        return
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    r = con.sql(entry.oracle_sql()[name])
    assert sorted(r.columns) == cols
    at = [r.columns.index(c) for c in cols]
    assert sorted(repr([norm(x[i]) for i in at]) for x in r.fetchall()) == rows
