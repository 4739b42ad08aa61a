"""Every core query runs on the smallest tables, and gives the rows of its SQL."""

import math
from pathlib import Path

import duckdb
import pytest

from inkglass import queries as core

SLOW = ("organized_documents", "rendered_markdown")


@pytest.fixture(scope="module")
def db(small):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(small).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(df):
    clean = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v
    df = df[sorted(df.columns)].astype(object)
    return list(df.columns), sorted((tuple(map(clean, r)) for r in df.where(df.notna(), None).values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query(spark, small, db, name):
    got = core.queries()[name](spark, small)
    sql = core.oracle_sql().get(name)
    if sql is None:
        assert got.count() >= 0
    else:
        assert rows(got.toPandas()) == rows(db.execute(sql).df())
