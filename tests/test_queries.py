"""Registered queries against their SQL on the smallest tables.

tools/check_queries.py does the same for every query at any scale.
"""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as spark_entry  # noqa: E402
from check_queries import TABLES, ordered  # noqa: E402

CHOSEN = [
    "a5_macro_by_split",
    "a8_meter_summary",
    "c1_macro_threshold_sweep",
    "c7_reliability_table",
    "c11_auroc_auprc",
    "h4_table_digest",
    "f14_percentile_stretch",
    "j3_recover_split",
    "d5_near_duplicate_groups",
    "d9_group_split",
    "b1_quantile_bins",
    "t4_signed_rank_sums",
    "w6_early_stopping",
    "g6_hann_stitching",
    "r3_boundary_metrics_cross",
    "r7_components_8",
    "k4_startable_stages",
    "st2_window_summary",
    "flow_evaluation",
]


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def test_every_sql_has_a_query():
    assert set(spark_entry.oracle_sql()) <= set(spark_entry.queries())


def test_entry_has_rows(spark):
    assert spark_entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, con, sf_dir, name):
    df = spark_entry.queries()[name](spark, sf_dir)
    columns, mine = ordered(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(spark_entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert (columns, mine) == ordered(names, cursor.fetchall())
