"""Every query with SQL gives DuckDB's rows on the small tables; every other one runs."""

import math

import duckdb
import pytest

from lexigrid import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(x):
    """Values that the two engines can be compared by: floats to nine digits, structs and tuples as lists."""
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if isinstance(x, dict):
        return [plain(v) for v in x.values()]
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    return bytes(x) if isinstance(x, bytearray) else x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((repr([plain(r[i]) for i in order]) for r in data))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf, duck, name):
    df = catalog.queries()[name](spark, sf)
    got = df.collect()
    if name in SQL:
        want = duck.execute(SQL[name])
        columns = [c[0] for c in want.description]
        assert sorted(df.columns) == sorted(columns)
        assert rows(df.columns, got) == rows(columns, want.fetchall())


def test_most_give_rows(spark, sf):
    """A query that gives no row proves little: only a few may."""
    empty = [k for k, f in catalog.queries().items() if f(spark, sf).isEmpty()]
    assert len(empty) <= 6, empty
