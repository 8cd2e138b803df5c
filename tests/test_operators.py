"""Operators that SQL cannot express, on small networks with known answers."""

import datetime

import pandas as pd
import pytest

from chronoline.functions import kana
from chronoline.operators import feeds, graph, journeys
from chronoline.sources import tv3


def conn(rows):
    return pd.DataFrame(rows, columns=["dep_s", "dep_t", "arr_s", "arr_t", "trip_id", "seq", "mode", "cal"])


FOOT = pd.DataFrame([(2, 9, 5)], columns=["a", "b", "walk"])


def test_scan_needs_time_to_change_but_not_to_stay_on_board():
    net = conn([(1, 100, 2, 110, 1, 1, 0, 7), (2, 110, 3, 120, 1, 2, 0, 7), (2, 112, 4, 115, 2, 1, 0, 7), (2, 114, 4, 119, 3, 1, 0, 7)])
    scan = graph.Scan(net, FOOT)
    label = scan.query(1, None, 90)
    assert label[3][0] == 120  # stays on board
    assert label[4][0] == 119  # the train at 112 leaves too soon after 110
    assert label[9][0] == 115  # walks on
    assert scan.legs(label, 4) == [("ride", 1, 1, 100, 2, 110), ("ride", 3, 2, 114, 4, 119)]


def test_scan_bus_change_takes_longer():
    net = conn([(1, 100, 2, 110, 1, 1, 0, 7), (2, 115, 3, 120, 2, 1, 1, 7), (2, 116, 3, 130, 3, 1, 1, 7)])
    assert graph.Scan(net, FOOT).query(1, None, 90)[3][0] == 130


def test_scan_goes_on_the_next_day_and_filters():
    net = conn([(1, 100, 2, 110, 1, 1, 0, 1), (2, 50, 3, 60, 2, 1, 0, 7)])
    scan = graph.Scan(net, FOOT)
    assert scan.query(1, 3, 90)[3][0] == 1440 + 60
    assert 2 not in scan.query(1, 2, 90, day=1)
    assert 2 not in scan.query(1, 2, 90, allow=lambda trip, mode: trip != 1)


def test_rounds_equal_scan_without_walks(spark):
    rows = [(s % 7, 10 * s, (s * 3 + 1) % 7, 10 * s + 6, s, 1, 0, 7) for s in range(1, 60) if s % 7 != (s * 3 + 1) % 7]
    none = pd.DataFrame([], columns=["a", "b", "walk"])
    scan = {k: v[0] for k, v in graph.Scan(conn(rows), none).query(1, None, 0).items() if v[0] < 1000}
    df = spark.createDataFrame(conn(rows))
    foot = spark.createDataFrame([], "a int, b int, walk int")
    assert {r.station_id: r.arr for r in graph.reach_rounds(df, foot, 1, 0).collect()} == scan


def test_spanning_links_are_a_least_forest(spark):
    edges = [(1, 2, 5), (2, 3, 1), (1, 3, 2), (4, 5, 1)]
    got = graph.spanning_links(spark.createDataFrame(edges, "a int, b int, n int")).collect()
    assert sorted(map(tuple, got)) == [(1, 3, 2), (2, 3, 1), (4, 5, 1)]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 51)], "a int, b int")
    got = {r.node: r.component for r in graph.components(edges).collect()}
    assert {got[i] for i in range(31)} == {0} and got[51] == 50


def test_dijkstra_change_penalty():
    edges = pd.DataFrame([(1, 2, 5.0, "a"), (2, 3, 5.0, "b"), (1, 3, 14.0, "a")], columns=["a", "b", "minutes", "line"])
    assert graph.dijkstra_with_changes(edges, 1)[3] == 14.0
    assert graph.dijkstra_with_changes(edges, 1, through=frozenset([frozenset(("a", "b"))]))[3] == 10.0


def test_budgeted_cover_skips_what_overflows(spark):
    df = spark.createDataFrame([("a", 9, [1, 2, 3]), ("b", 8, [4, 5, 6]), ("c", 7, [3, 4])], "feed string, trips int, stops array<int>")
    assert [r.feed for r in feeds.budgeted_cover(df, 4).orderBy("place").collect()] == ["a", "c"]


def test_packed_round_trip():
    trips = [[(1, None, 5), (2, 7, 8), (3, 9, None)], [(4, None, 1), (1, 2, None)]]
    for compress in (True, False):
        offsets, station, arr, dep = tv3.unpack(tv3.pack(trips, compress))
        assert offsets.tolist() == [0, 3, 5] and station.tolist() == [1, 2, 3, 4, 1]
        assert arr.tolist() == [65535, 7, 9, 65535, 2] and dep.tolist() == [5, 8, 65535, 1, 65535]
    assert tv3.pack(trips) == tv3.pack(trips)
    with pytest.raises(ValueError):
        tv3.pack([[(70000, None, 1)]])


def test_holidays():
    got = dict(feeds.holiday_dates(2026))
    assert got[datetime.date(2026, 9, 22)] == "between" and got[datetime.date(2026, 5, 6)] == "substitute"
    assert datetime.date(2027, 3, 22) in dict(feeds.holiday_dates(2027))


def test_romaji():
    assert [kana.romaji(x) for x in ("しんじゅく", "ホッカイドウ", "なんば", "まっちゃ", None)] == ["shinjuku", "hokkaido", "namba", "matcha", None]


def test_streams(spark, tmp_path):
    from chronoline.streaming.sessions import departures_by_hour, event_stream

    batch = spark.sql("SELECT 1 AS event_id, TIMESTAMP '2024-01-01 10:05:00' AS ts, 'a' AS event_type UNION ALL SELECT 2, TIMESTAMP '2024-01-01 10:55:00', 'a' UNION ALL SELECT 3, TIMESTAMP '2024-01-02 10:55:00', 'b'")
    batch.write.parquet(str(tmp_path / "e"))
    q = departures_by_hour(event_stream(spark, str(tmp_path / "e"))).writeStream.format("memory").queryName("hours").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.event_type, r.n) for r in spark.sql("SELECT * FROM hours").collect()] == [("a", 2)]


def planner(fare=None):
    rows = [(1, 100, 2, 110, 1, 1, 0, 7), (2, 120, 3, 140, 2, 1, 0, 7), (1, 105, 3, 200, 3, 1, 0, 7), (1, 130, 3, 150, 4, 1, 1, 7), (1, 160, 3, 170, 5, 1, 0, 7), (3, 180, 1, 190, 6, 1, 0, 7), (1, 195, 4, 230, 6, 2, 0, 7)]
    trips = pd.DataFrame([(1, "a", None, "X"), (2, "b", None, "X"), (3, "c", None, "Y"), (4, "bus", None, ""), (5, "d", "paid", "Y"), (6, "e", None, "X")], columns=["trip_id", "line", "cls", "operator"])
    return journeys.Planner(conn(rows), pd.DataFrame([], columns=["a", "b", "walk"]), trips, fare)


def test_planner_options():
    p, o = planner(), journeys.Options
    assert p.query(1, 3, 90).arr == 140 and p.query(1, 3, 90).transfers == 1
    assert p.query(1, 3, 111).rides[0][1] == 4
    assert p.query(1, 3, 111, o(no_bus=True)).rides[0][1] == 5
    assert p.query(1, 3, 90, o(bus_only=True, no_bus=True)).rides[0][1] == 4
    assert p.query(1, 3, 90, o(operators=frozenset(["Y"]))).rides[0][1] == 5
    assert p.query(1, 3, 90, o(operators=frozenset(["Y"]), express=False)).rides[0][1] == 3
    assert p.query(1, 3, 90, o(operators=frozenset(["Nobody"]))) is None
    assert p.query(1, 3, 90, o(ban_trips=frozenset([2]), ban_lines=frozenset(["bus"]))).rides[0][1] == 5
    assert p.query(1, 1, 90) is None


def test_planner_profiles():
    p = planner()
    assert [j.dep for j in p.profile(1, 3, 90, 170)] == [100, 130, 160]
    assert p.next(1, 3, 100).dep == 130 and p.previous(1, 3, 160).dep == 130
    assert p.latest(1, 3, 155, 0).dep == 130 and p.latest(1, 3, 120, 0) is None


def test_planner_ranks_and_budgets():
    cost = {1: 50, 2: 50, 3: 80, 4: 300, 5: 500}
    p = planner(lambda j: (sum(cost.get(x[1], 10) for x in j.rides),) * 2)
    found = p.find(1, 3, 90)
    assert [j.score for j in found] == sorted(j.score for j in found) and found[0].arr == 140
    assert {x[1] for j in found for x in j.rides} >= {1, 2, 4, 5}
    within = p.find(1, 3, 111, journeys.Options(budget=350))
    assert within and not any(j.over for j in within)
    none = p.find(1, 3, 111, journeys.Options(budget=1))
    assert none and all(j.over for j in none) and [j.min_fare for j in none] == sorted(j.min_fare for j in none)


def test_planner_leaves_loops_out():
    j = planner().query(3, 4, 170)
    assert j.legs == [("ride", 6, 3, 180, 4, 230)]
    assert planner()._without_loop([("ride", 9, 7, 170, 3, 175), ("ride", 6, 3, 180, 4, 230)], 1) == [("ride", 6, 1, 195, 4, 230)]


def test_batch_scan_equals_one_scan_a_request():
    import random

    import numpy as np

    rng = random.Random(3)
    rows = []
    for trip in range(150):
        t, at = rng.randrange(0, 1400), rng.randrange(25)
        for seq in range(1, rng.randrange(3, 9)):
            to, dep, arr = rng.randrange(25), t + rng.randrange(3), t + rng.randrange(3, 25)
            if to != at:
                rows.append((at, dep, to, arr, trip, seq, int(trip % 4 == 0), rng.choice([1, 2, 4, 7])))
            t, at = arr, to
    net, foot = conn(rows), pd.DataFrame([(1, 9, 5), (3, 4, 7), (20, 21, 3)], columns=["a", "b", "walk"])
    one = graph.Scan(net, foot)
    many = graph.BatchScan(*({c: t[c].to_numpy(np.int64) for c in t.columns} for t in (net, foot)))
    stations = sorted(many.at)
    asked = [(rng.choice(stations), rng.choice(stations), rng.randrange(0, 1500), rng.choice([None, 0, 1, 2])) for _ in range(120)]
    source, target = (np.array([many.at[a[k]] for a in asked]) for k in (0, 1))
    many.query(source, target, np.array([a[2] for a in asked]), np.array([-1 if a[3] is None else a[3] for a in asked]))
    for k, (s, t, start, day) in enumerate(asked):
        label = one.query(s, t, start, day)
        assert many.label[target[k], k] == (label[t][0] if t in label else many.FAR)
        assert many.legs(k, int(source[k]), int(target[k])) == one.legs(label, t)


def test_rail_option_and_operators():
    net = conn([(1, 100, 2, 110, 1, 1, 0, 7), (1, 100, 2, 120, 2, 1, 0, 7), (1, 100, 2, 105, 3, 1, 1, 7)])
    trips = pd.DataFrame([(1, "ＪＲ線", None, "JR"), (2, "x", None, "東急"), (3, "bus", None, "")], columns=["trip_id", "line", "cls", "operator"])
    planner = journeys.Planner(net, FOOT, trips)
    arr = lambda **o: planner.query(1, 2, 90, journeys.Options(**o)).arr
    assert (arr(), arr(no_bus=True), arr(rail="jr"), arr(rail="private"), arr(bus_only=True, rail="private")) == (105, 110, 110, 120, 105)
    assert arr(operators=frozenset({"東急"})) == 120 and arr(rail="jr", operators=frozenset({"東急"})) == 110


def test_feeds_are_chosen_in_turn_with_reasons(spark):
    rows = [("a", "p", 9, "1", [1, 2]), ("b", "p", 8, "2", [3, 4, 5]), ("c", "q", 1, "3", [6]), ("d", "q", 0, "4", [7]), ("e", "p", 7, "1", [8]), ("f", "r", 5, "5", [1, 9])]
    got = feeds.select_feeds(spark.createDataFrame(rows, "feed string, region string, trips long, sig string, stops array<long>"), 5, 1).collect()
    assert [(r.feed, r.place, r.reason) for r in sorted(got, key=lambda r: r.turn)] == [("a", 1, None), ("c", 2, None), ("f", 3, None), ("b", None, "budget"), ("e", None, "same as a"), ("d", None, "empty")]


def test_tariff_from_a_file(tmp_path):
    import json

    from chronoline.operators.tickets import Tariff

    path = tmp_path / "fares.json"
    path.write_text(json.dumps({"companies": {"A": {"ic_fare": [[3, 100], [9, 200]], "km_scale": 1.1}}, "jr_special": {"x|y": 90}, "default_fare_per_km": 30, "express": {"groups": {"g": [[9, 1]]}, "seat": {"reserved_only": ["Z"]}}}))
    tariff = Tariff.load(str(path))
    assert tariff.bands == {"A": [[3, 100], [9, 200]]} and tariff.scale == {"A": 1.1} and tariff.special == {("x", "y"): 90} and tariff.per_km == 30 and tariff.reserved_only == ["Z"]
