"""Every query has a unique name, and some with SQL are compared with it on the smallest tables."""

import glob
import math
import os

import pytest

import __spark_entry__ as e

TABLES = "/root/testdata/sf0.001"


def test_contract(spark):
    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and len(q) > 100
    assert e.entry(spark).columns


def rows(columns, values):
    plain = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else float(v) if isinstance(v, (int, float)) else str(v)
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", ["p3_found", "p3_composite", "idf_rank", "narrowing_final", "vignette_eval", "cause_split", "cue_gaps", "verbatim_quote_check", "lint_illegal_values", "term_index_rooted", "record_arrays"])
def test_agrees_with_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{TABLES}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    got = e.queries()[name](spark, TABLES)
    want = con.execute(e.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())
