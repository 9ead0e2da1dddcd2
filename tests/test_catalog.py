import os

import duckdb
import pytest

import __spark_entry__ as entry
from motifspark import catalog

DATA = "/root/testdata/sf0.001"
SOME = ["graph_summary", "two_hop_label_degree", "lpcsr_offsets", "lpcsr_slot_lookup", "candidate_counts", "match_triangle", "match_house",
        "match_samelabel_leaf", "match_leaves_repeat", "match_from_hubs", "count_star_factorized", "reorder_hubs_last", "topk_common_neighbors", "io_load_graph", "io_roundtrip"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW \"{f.split('.')[0]}\" AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, con, name):
    got, want = catalog.QUERIES[name](spark, DATA).toPandas(), con.execute(catalog.ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a, b = (x[cols].sort_values(cols).astype(str).reset_index(drop=True) for x in (got, want))
    assert a.equals(b)


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 22_649
