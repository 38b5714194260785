"""The registered graph queries against DuckDB, and the entry point."""

import os

import duckdb
import pytest

import __spark_entry__
from lattica import queries as graph

from .conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events".split()
#: One of each family; the driver compares all of them.
SOME = ["g00_segment_totals", "s05_multi_get", "s14_key_page_reverse", "w03_remove_vertices", "w07_counter", "j04_edge_page", "j05_both", "a02_sum_neighbours", "g07_where_child", "g13_simple_path", "g17_coalesce", "g19_subgraph", "g24_dates", "p03_shortest_paths", "p06_components", "p06_page_rank", "w07_edge_counter", "w10_bulk_set_last_wins", "w12_repeated_keys", "g09_tail_in_child", "g13_path_by", "g25_more_lists", "l12_rejected_batches", "p06_label_propagation", "p06_event_sequence", "x01_sort_keys"]


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    own = graph.QUERIES[name](spark, DATA)
    columns = sorted(own.columns)
    rows = sorted(map(repr, (tuple(r) for r in own.select(columns).collect())))
    cursor = con.execute(f"SELECT {', '.join(columns)} FROM ({graph.SQL[name]})")
    assert rows == sorted(map(repr, cursor.fetchall()))


def test_every_query_has_sql_and_entry_runs(spark):
    assert set(graph.SQL) == set(graph.QUERIES)
    assert set(graph.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert os.path.isdir(DATA) and __spark_entry__.entry(spark).count() == 5


def test_hops_by_ids_leave_vertices_out(spark):
    from lattica.sources import star

    plan = star.graph(spark, DATA).V("nation:3").in_("customer_in").out("placed").count().df()._jdf.queryExecution().executedPlan().toString()
    read = [x.split(">")[0] for x in plan.split("ReadSchema: ")[1:]]
    assert read and not any(c in x for x in read for c in ("c_acctbal", "l_extendedprice", "o_totalprice"))
