"""Every registered query runs, and equals its SQL where it has one, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from postrail.plans.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(x):
        if isinstance(x, bool) or x is None or isinstance(x, str):
            return str(x)
        return f"{float(x):.9g}" if math.isfinite(float(x)) else str(x)

    return [columns[i] for i in order], sorted(tuple(value(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    df = QUERIES[name](spark, DATA)
    got = [tuple(r) for r in df.collect()]
    if name in ORACLE:
        want = tables.execute(ORACLE[name])
        names = [c[0] for c in want.description]
        assert canonical(df.columns, got) == canonical(names, want.fetchall())
    assert got or name in ("and5", "and4", "and3")


def test_sql_only_for_queries():
    assert set(ORACLE) <= set(QUERIES)


def test_every_term_has_a_list(spark):
    got = QUERIES["roundtrip_terms"](spark, DATA)
    assert got.select("list_id").distinct().count() == QUERIES["postings_all_terms"](spark, DATA).select("term").distinct().count() > 200
    assert got.groupBy("list_id").count().where("count = 1").count() > 0


@pytest.mark.parametrize("name", ["next_geq", "access_pos", "packed_fields", "search_window"])
def test_every_list_is_asked(spark, tables, name):
    lists = tables.execute("SELECT count(DISTINCT l_suppkey) FROM lineitem").fetchone()[0]
    assert QUERIES[name](spark, DATA).where("list_id >= 0").select("list_id").distinct().count() == lists


def test_codes_of_a_lone_symbol(spark, tmp_path):
    """Lists of one posting, and of gaps so wide that all residuals are 0, have one symbol; its code is complete as well."""
    rows = [(1, 7), *[(2, i * i * 1_000_003) for i in range(1, 50)], *[(3, i * i % 997) for i in range(90)]]
    spark.createDataFrame(rows, "l_suppkey long, l_orderkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    df = QUERIES["huffman_covers"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.execute(ORACLE["huffman_covers"])
    names = [c[0] for c in want.description]
    got = [tuple(r) for r in df.collect()]
    assert canonical(df.columns, got) == canonical(names, want.fetchall())
    assert {i: sum(r[0] == i for r in got) == 1 for i in (1, 2, 3)} == {1: True, 2: True, 3: False}
