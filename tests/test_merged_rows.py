"""Merging spots name by name over sorted rows."""

import random

from outways.operators import entity


def test_a_row_is_measured_against_places_near_it_alone(monkeypatch):
    # 4000 places of one name in a square, far enough apart to stay so, each met again once.
    spots = [(35 + i // 64 * 0.02, 139 + i % 64 * 0.02) for i in range(4000)]
    rows = [(n, n, "k", "n", "図書館", lat, lon, False, False, 0, 9) for n, (lat, lon) in enumerate(spots + [(lat + 0.001, lon) for lat, lon in spots])]
    measured, hypot = [0], entity.math.hypot

    def counted(*sides):
        measured[0] += 1
        return hypot(*sides)

    monkeypatch.setattr(entity.math, "hypot", counted)
    merged = list(entity.merged_in_order(rows))
    assert [m[12] for m in merged] == [[4000 + n] for n in range(4000)]
    assert measured[0] < 9 * len(rows)


def test_names_blank_or_without_coordinates_and_moving_places(spark):
    none = None
    rows = [
        # The head is curated: its place goes where each open record of it lies, cell by cell.
        (1, 1, "k", "a", "図書館", 35.0, 139.0, 9, True, False, 5, none), (2, 2, "k", "b", "図書館", 35.013, 139.0, 8, False, True, 3, 9), (3, 3, "k", "c", "図書館", 35.026, 139.0, 7, False, False, 8, 9), (4, 4, "k", "d", "図書館", 35.0, 139.0, 6, False, False, 8, 9),
        (5, 5, "k", "e", "図書館", none, 139.0, 5, False, False, 1, 2), (6, 6, "k", "f", none, none, none, 4, False, none, none, none), (7, 7, "", "g", "公園", 35.0, 139.0, 3, False, False, 1, 2), (8, 8, "", "g", "公園", 35.0, 139.0, 3, False, False, 1, 2),
        (9, 9, none, "h", "公園", 35.0, 139.0, 3, False, False, 1, 2), (10, 10, "z", "i", "公園", 35.0, 139.0, none, False, False, 1, 2), (11, 11, "z", "j", "図書館", 35.0, 139.0, 1, False, False, 0, 9),
    ]
    frame = spark.createDataFrame(rows, "id long, ord int, key string, name string, facility_type string, lat double, lon double, richness int, hand boolean, toilet boolean, age_min int, age_max int")
    got = {r["id"]: (r["name"], r["lat"], r["toilet"], r["age_min"], r["age_max"], r["also_types"], r["also_in"]) for r in entity.merged_spots(frame).collect()}
    assert got == {
        1: ("a", 35.026, True, 3, none, [], [2, 3]), 4: ("d", 35.0, False, 8, 9, [], []), 5: ("e", none, False, 1, 2, [], []), 6: ("f", none, none, none, none, [], []),
        7: ("g", 35.0, False, 1, 2, [], []), 8: ("g", 35.0, False, 1, 2, [], []), 11: ("j", 35.0, False, 0, 9, ["公園"], [10]),
    }


def test_many_small_names_take_no_group_of_their_own(spark):
    pick = random.Random(5)
    rows = [(n, n, f"k{n % 3000}", "n", "図書館", 35.0, 139.0, pick.randrange(9), False, False, 0, 9) for n in range(9000)]
    frame = spark.createDataFrame(rows, "id int, ord int, key string, name string, facility_type string, lat double, lon double, richness int, hand boolean, toilet boolean, age_min int, age_max int")
    merged = entity.merged_spots(frame)
    assert "FlatMapGroups" not in merged._jdf.queryExecution().toString()
    heads = {}
    for id_, _, key, *_, rich, _, _, _, _ in sorted(rows, key=lambda r: (-r[7], r[1])):
        heads.setdefault(key, []).append(id_)
    assert {r["key"]: [r["id"], *r["also_in"]] for r in merged.collect()} == heads
