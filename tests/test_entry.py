"""The queries against DuckDB on the smallest tables, where these are there."""

import glob
import os

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
NAMES = ["load_drop_empty_rows", "duplicate_keys", "cell_mismatches", "key_classification", "column_roster", "pair_context_group_top5", "check_matrix", "returned_cells", "accept_pair", "next_pending_key", "check_xlsdate", "first_diff", "roster_after_undo", "deep_page", "context_views", "pair_text", "draft_after_refresh", "load_delimited"]


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got = entry.queries()[name](spark, DATA).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda x: sorted(map(repr, x[columns].astype(object).where(x[columns].notna(), None).itertuples(index=False, name=None)))
    assert rows(got) == rows(want) and len(got)


def test_every_plan_query_has_sql():
    from exactdiff.plans import oracle, queries

    assert queries.queries().keys() == oracle.oracle_sql().keys()
