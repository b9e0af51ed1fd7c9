"""Every registered query with SQL gives the rows that DuckDB gives for it."""

from __future__ import annotations

import datetime
import decimal

import duckdb
import pytest

from tesserae import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def cell(v) -> str:
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return f"[{','.join(map(cell, v))}]" if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, data, con, name):
    df = QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(tuple(cell(r[c]) for c in cols) for r in df.collect())
    found = con.execute(SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(tuple(cell(r[i]) for i in at) for r in found.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_codes_of_any_length(spark, data, tmp_path):
    """Part keys from 980,000 on make codes of seven digits, which have no level; SQL and query keep them alike."""
    c = duckdb.connect()
    c.execute(f"CREATE VIEW nation AS SELECT * FROM read_parquet('{data}/nation.parquet')")
    c.execute(f"COPY (SELECT * FROM nation) TO '{tmp_path}/nation.parquet' (FORMAT parquet)")
    c.execute(f"COPY (SELECT * REPLACE (p_partkey + 979_900 AS p_partkey) FROM '{data}/part.parquet') TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    c.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    got = sorted(((r["code"], r["level"]) for r in QUERIES["code_level_names"](spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(c.execute(SQL["code_level_names"]).fetchall(), key=str)
    assert {len(code) for code, level in got if level is None} == {7}
