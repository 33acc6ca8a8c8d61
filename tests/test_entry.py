import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUICK = ("trailing_return_20", "as_of_before", "merge_evidence", "pair_ratios", "resolve_cutoff", "link_records", "score_contributions", "gated_decision")


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


def test_entry_runs(spark):
    assert entry.entry(spark).limit(5).count() == 5


@pytest.mark.parametrize("name", QUICK)
def test_quick_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "pages", "benchmark", "conversations", "nation", "region"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = sorted((tuple(map(str, r)) for r in cur.fetchall()))
    got = sorted(tuple(map(str, r)) for r in df.select(*names).collect())
    assert got == want
