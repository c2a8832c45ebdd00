"""Every core query that has SQL gives the rows of DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from topicweave.plans import queries as core

SQL = core.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if v is None or (not isinstance(v, (list, str)) and pd.isna(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    return round(v, 4) + 0.0 if isinstance(v, float) and math.isfinite(v) else v if isinstance(v, (int, bool)) else str(v)


def rows(df):
    c = sorted(df.columns)
    return sorted(([plain(v) for v in r] for r in df[c].itertuples(index=False)), key=lambda r: [str(x) for x in r])


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, data, duck, name):
    assert rows(core.queries()[name](spark, data).toPandas()) == rows(duck.sql(SQL[name]).df())
