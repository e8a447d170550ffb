"""Rows that an order leaves equal, and words beside accented letters, as the SQL has them."""

import datetime

import duckdb
import pytest

from crewlens import catalog


@pytest.fixture(scope="module")
def tied(spark, tmp_path_factory):
    """Two lines of one number each, 1000 days apart, the later or the earlier one first."""
    folder = str(tmp_path_factory.mktemp("tied"))
    con = duckdb.connect()
    con.execute("create table orders as select k as o_orderkey, 7 as o_custkey, date '1994-01-01' as o_orderdate from range(1, 3) t(k)")
    con.execute("create table part as select k as p_partkey, 'gizmo ' || (k // 2)::varchar as p_name, 'Brand#' || k::varchar as p_brand from range(4) t(k)")
    days = [(1, 0, "1999-08-03"), (1, 1, "1996-11-06"), (2, 2, "1996-11-06"), (2, 3, "1999-08-03")]
    con.execute("create table lineitem (l_orderkey bigint, l_partkey bigint, l_linenumber integer, l_shipdate date, l_returnflag varchar, l_linestatus varchar)")
    con.executemany("insert into lineitem values (?, ?, 1, ?, 'N', 'F')", [(o, p, datetime.date.fromisoformat(d)) for o, p, d in days])
    for name in ("orders", "part", "lineitem"):
        con.execute(f"copy {name} to '{folder}/{name}.parquet' (format parquet)")
    return folder, con


@pytest.mark.parametrize("name", ["first_non_null_merge", "verified_only_gate"])
def test_equal_numbers_take_the_first_row(spark, tied, name):
    folder, con = tied
    found = catalog.queries()[name](spark, folder)
    sql = con.execute(catalog.oracle_sql()[name])
    assert found.columns == [d[0] for d in sql.description]
    got = sorted(map(tuple, found.collect()))
    assert len(got) == 2 and got == sorted(sql.fetchall())


def test_markers_end_before_accented_letters(spark, tmp_path):
    texts = ["Pa de avecé oui", "éfrom x", "from_x this_ avec1 rest", "one\nTHIS two"]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(enumerate(texts)))
    con.execute(f"copy documents to '{tmp_path}/documents.parquet' (format parquet)")
    found = {r.doc_id: r.head for r in catalog.queries()["section_truncate"](spark, str(tmp_path)).collect()}
    assert found == dict(con.execute(catalog.oracle_sql()["section_truncate"]).fetchall())
    assert found[0] == "Pa de" and found[1] == "é" and found[2] == texts[2]
