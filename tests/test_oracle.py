"""Every registered query with SQL gives the rows that the SQL gives on the smallest tables."""

import duckdb
import pytest

from millrace.plans import catalog
from millrace.sources.canonical import STAR

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in STAR:
        con.execute(f"create view {name} as select * from '{SMALL}/{name}.parquet'")
    return con


def plain(value):
    if value is None or value != value:
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or hasattr(value, "quantize"):
        return f"{float(value) + 0.0:.6g}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, sql, name):
    found = catalog.QUERIES[name](spark, SMALL)
    result = sql.execute(catalog.ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(found.columns) == sorted(columns)
    assert rows_of(found.columns, found.collect()) == rows_of(columns, result.fetchall())
