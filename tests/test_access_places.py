"""Which places near home a search begins at."""

import math

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__
from outways.operators import timetable
from outways.plans import projections as pr
from outways.plans import queries as q


def at(k: int) -> tuple[float, float]:
    even = k - k % 2
    return 35.8 + even * 7 * 7919 % 1000 / 10000, 139.85 + even * 11 * 104729 % 1000 / 10000 + k % 2 * 0.002


def metres(k: int) -> float:
    lat, lon = at(k)
    return math.hypot((lat - q.LAT) * 111195, (lon - q.LON) * 111195 * math.cos(math.radians(q.LAT)))


def test_all_places_near_a_spot_are_begun_at(spark):
    places = spark.createDataFrame([(n, 35.0 + n / 1e5, 139.0) for n in range(60)] + [(99, 35.02, 139.0)], "place_id int, lat double, lon double")
    assert {r["place_id"] for r in timetable.access_times(places, 35.0, 139.0).collect()} == set(range(60))
    assert {r["place_id"] for r in timetable.access_times(places, 35.0, 139.0, top=30).collect()} == set(range(30))


def test_reach_by_transit_begins_at_places_beyond_the_thirtieth(spark, tmp_path):
    """The only ride leaves from the fortieth place near home; it is taken by the reach, as by its SQL."""
    near = sorted((k for k in range(2000) if metres(k) < 1150), key=metres)[:40]
    far = min((k for k in range(2000) if metres(k) > 4000), key=metres)
    ride = next(o for o in range(100_000) if 1200 < 21600 + o * 37 % 57600 + 240 - q.WHEN < 1500)
    tables = {
        "supplier": {"s_suppkey": [*near, far], "s_nationkey": pa.array([1] * 41, pa.int32())},
        "lineitem": {"l_orderkey": [ride, ride], "l_suppkey": [near[-1], far], "l_linenumber": pa.array([1, 2], pa.int32())},
        "orders": {"o_orderkey": [ride], "o_custkey": [7], "o_orderstatus": ["O"], "o_orderpriority": ["3-MEDIUM"]},
    }
    for name, columns in tables.items():
        pq.write_table(pa.table(columns), tmp_path / f"{name}.parquet")
    own = duckdb.connect()
    for name in tables:
        own.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    want = own.execute(pr.with_ctes("stop_times trips places", "SELECT place_id, t, round FROM l3", q.ALL_RAPTOR)).fetchall()
    got = [tuple(r) for r in q._reached(spark, str(tmp_path), top=None).collect()]
    assert sorted(got) == sorted(want) and {p: r for p, _, r in got} == dict.fromkeys(near, 0) | {far: 1}
    sql = __spark_entry__.oracle_sql()
    assert q.ALL_RAPTOR in sql["isochrone_transit"] and q.RAPTOR in sql["isochrone_transit_cells"]
