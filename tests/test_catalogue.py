"""Each query against its DuckDB oracle on the driver's smallest tables."""

import glob
import os

import duckdb
import pytest

from weftline import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    return [plain(v) for v in value] if isinstance(value, (list, tuple)) else value


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    names = sorted(df.columns)
    rows = sorted(str([plain(r[c]) for c in names]) for r in df.collect())
    if name not in catalogue.oracle_sql():
        assert len(rows) > 0
        return
    found = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(found.columns) == names
    at = [found.columns.index(c) for c in names]
    assert rows == sorted(str([plain(r[i]) for i in at]) for r in found.fetchall())


def test_token_match_offers_every_customer(spark, duck):
    rows = {r.pid: r for r in catalogue.queries()["token_match"](spark, SF).collect()}
    suppliers, customers = (dict(duck.sql(f"SELECT {k}, {n} % 2 FROM {t}").fetchall()) for t, k, n in (("supplier", "s_suppkey", "s_nationkey"), ("customer", "c_custkey", "c_nationkey")))
    keys = {s: {s} | ({s // 3} if s % 3 == 0 else set()) for s in suppliers}
    assert {k: r.candidates for k, r in rows.items()} == {f"s{s}": sorted(f"c{c}" for c in keys[s] if customers.get(c) == parity) for s, parity in suppliers.items()}


def test_whole_queries_leave_no_row_aside(spark, duck):
    ids = {r.doc_id for r in catalogue.queries()["attach_semi"](spark, SF).collect()}
    assert ids == {x for (x,) in duck.sql("SELECT doc_id FROM documents WHERE lang IS DISTINCT FROM 'en' OR source IN (SELECT source FROM documents WHERE lang IS DISTINCT FROM 'en')").fetchall()}
    facts = {(r.pid, r.path, r.content) for r in catalogue.queries()["ownership_merge"](spark, SF).collect()}
    assert facts == set(duck.sql("SELECT DISTINCT user_id::VARCHAR, event_type, props FROM events").fetchall())
    pids = {r.item: r.pid for r in catalogue.queries()["priority_resolve"](spark, SF).collect()}
    nations = duck.sql("SELECT c_custkey, n_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey IN (2, 4)").fetchall()
    assert nations and all(pids[c] == f"reviewed{n}" for c, n in nations)


def test_contract_without_the_training_operators():
    import importlib.util

    import __spark_entry__ as entry

    assert set(catalogue.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert (importlib.util.find_spec("weftline.llm") is None) == (not any(n.startswith("op1_") for n in entry.queries()))


def test_rows_of_a_small_file_are_dealt_to_all_cores(spark):
    from weftline import plan_queries

    assert plan_queries._items(spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
