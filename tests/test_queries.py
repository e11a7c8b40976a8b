"""Queries against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHOSEN = ["nearby_radius", "nearby_picks", "coverage_spots", "park_rank", "facility_kinds", "nearest_1", "point_in_ring", "snap_to_line", "service_runs", "next_departure", "transfers_fallback", "edge_cost_walk", "barrier_join", "norm_name", "html_links", "feed_verdict", "static_matrix"]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def rows(frame):
    frame = frame[sorted(frame.columns)]
    text = lambda x: "" if pd.isna(x) else format(float(x), ".6f") if isinstance(x, (int, float)) or hasattr(x, "dtype") else str(x)
    return sorted(tuple(text(x) for x in r) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHOSEN)
def test_same_rows(spark, duck, name):
    ours, theirs = __spark_entry__.queries()[name](spark, SF).toPandas(), duck.sql(__spark_entry__.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_names_of_oracles():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
