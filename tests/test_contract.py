"""Every registered query against its SQL, at the smallest scale."""

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the generated tables are not here")


def plain(v):
    import datetime

    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 9)
    return v.isoformat() if isinstance(v, datetime.datetime) else str(v)


def test_queries_equal_their_sql(spark):
    import duckdb

    from clickloom.plans.oracle import ORACLE_SQL
    from clickloom.plans.queries import QUERIES

    con = duckdb.connect()
    for name in sorted(os.listdir(SF)):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    for name, sql in ORACLE_SQL.items():
        got = QUERIES[name](spark, SF)
        columns = sorted(got.columns)
        found = con.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(names) == columns, name
        want = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in found.fetchall())
        assert sorted(repr([plain(r[c]) for c in columns]) for r in got.collect()) == want, name


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
