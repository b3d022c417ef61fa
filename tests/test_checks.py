"""A part of the registered queries against their SQL on the smallest tables (all of them with GRIDSIGNAL_ALL_CHECKS=1)."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import rows_of

SF = "/root/testdata/sf0.001"
SOME = [
    "weak_state_summary", "series_positions", "upward_crossings", "asof_nearest", "clip_to_overlap", "dedup_first",
    "regrid_linear", "spatial_sum", "ranking_metrics_by_group", "classification_report", "hit_rate", "stratified_split",
    "time_series_folds", "metrics_csv_round_trip", "transports_daily", "prepared_labels",
]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("GRIDSIGNAL_ALL_CHECKS") else SOME

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got = df.collect()
    cur = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert rows_of(df.columns, got) == rows_of(columns, cur.fetchall())


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_has_rows(spark):
    assert entry.entry(spark).count() > 0
