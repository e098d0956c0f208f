"""Every corpus query with an oracle agrees with DuckDB on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from threadloom.llm.queries import queries
from threadloom.llm.sql import oracle_sql

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


def plain(v):
    return round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_agrees(name, spark):
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = queries()[name](spark, str(DATA))
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = con.execute(oracle_sql()[name])
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    assert got == sorted((tuple(plain(row[i]) for i in at) for row in cur.fetchall()), key=repr)
