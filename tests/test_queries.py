"""Every core query against its SQL in another engine, on the smallest tables."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from graphloom.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, list | tuple):
        return tuple(map(norm, v))
    return v


@pytest.fixture(scope="module")
def sql(data):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f if f.is_file() else f / '*.parquet'}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, sql, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    result = sql.execute(SQL[name])
    theirs = [c[0] for c in result.description]
    assert sorted(theirs) == columns
    ours = Counter(tuple(norm(v) for v in row) for row in df.select(*columns).collect())
    other = Counter(tuple(norm(row[theirs.index(c)]) for c in columns) for row in result.fetchall())
    assert ours == other


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_shortest_path_agrees_with_hops(spark, data):
    row = QUERIES["shortest_path"](spark, data).first()
    assert row is None or len(row["nodes"]) == len(row["rels"]) + 1
