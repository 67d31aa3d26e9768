"""The registered queries against their DuckDB statements."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from syntarel.operators import search
from syntarel.plans import table_queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(table_queries.ORACLE_SQL) + sorted(table_queries.FIXTURES))
def test_equals_statement(spark, tables, name):
    if not os.path.isdir(DATA):
        pytest.skip("no tables here")
    f, statement = table_queries.FIXTURES.get(name) or (table_queries.QUERIES[name], table_queries.ORACLE_SQL[name])
    want = tables.sql(statement)
    got = f(spark, DATA)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = [tuple(r[c] for c in columns) for r in got.collect()]
    plain = want.project(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert sorted(map(repr, rows)) == sorted(map(repr, plain))


def test_nearest_in_blocks_equals_statement(spark, tmp_path, monkeypatch):
    """Copies with other keys (ties go by id), one vector very often, one with a number that is none: by cells and blocks as in one block."""
    if not os.path.isdir(DATA):
        pytest.skip("no tables here")
    monkeypatch.setattr(search, "VECTOR_BLOCK", 400)
    monkeypatch.setattr(search, "QUERY_BLOCK", 16)
    monkeypatch.setattr(search, "CELL", 30)
    con = duckdb.connect()
    con.sql(f"create table one as select vec_id, embedding from '{DATA}/embeddings.parquet'")
    often = "case when vec_id % 3 = 0 then (select embedding from one where vec_id = 7) else embedding end"
    none = "case when vec_id in (40, 41) then list_transform(embedding, lambda x: 'nan'::float) else embedding end"
    con.sql(f"create table embeddings as select vec_id, {none} as embedding from (select vec_id, {often} as embedding from one union all select vec_id + 500, embedding from one union all select vec_id + 1000, embedding from one)")
    con.sql(f"copy embeddings to '{tmp_path}/embeddings.parquet' (format parquet)")
    for name in ("knn_score", "knn_l2"):
        want = con.sql(table_queries.ORACLE_SQL[name])
        got = [tuple(r[c] for c in want.columns) for r in table_queries.QUERIES[name](spark, str(tmp_path)).collect()]
        assert len(got) == 750 and sorted(map(repr, got)) == sorted(map(repr, want.fetchall()))


def test_entry_and_names(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
