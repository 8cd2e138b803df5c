"""Queries that take the whole job, on small event tables whose answers are counted by hand or by brute force."""

import datetime
import math
import random
from collections import Counter

import pytest

from chronoline.plans import registry

EVENTS = "event_id long, user_id long, ts timestamp, event_type string, value double, props string"


@pytest.fixture
def on(spark, tmp_path):
    """Runs a query over events (event_id, user_id, day, minute, station), and gives its rows."""

    def run(name, events, kind="view"):
        at = lambda day, minute: datetime.datetime(2026, 6, day) + datetime.timedelta(minutes=minute)
        rows = [(e, u, at(day, minute), kind, float(e), f'{{"k": {station}}}') for e, u, day, minute, station in events]
        spark.createDataFrame(rows, EVENTS).write.mode("overwrite").parquet(f"{tmp_path}/events.parquet")
        return registry.queries()[name](spark, str(tmp_path)).collect()

    return run


def test_as_of_last_has_no_bound(on):
    events = [(1, 7, 1, 10, 1), (2, 8, 1, 10, 1), (400, 7, 1, 20, 2), (2000, 7, 1, 30, 3), (90000, 8, 1, 40, 3)]
    assert sorted(map(tuple, on("j09_as_of_last", events))) == [(400, 1.0), (2000, 400.0), (90000, 2.0)]


def test_overlap_merge_takes_all_stations_and_days(on):
    stations = {(1, 1): [3, 50], (2, 20): [50, 99], (3, 31 - 1): [7, 8], (4, 2): [1], (5, 25): [8, 42], (6, 3): [60]}
    events = [(100 * u + i, u, day, 10 + i, s) for (u, day), group in stations.items() for i, s in enumerate(group)]
    groups = [set(g) for g in stations.values()]
    for _ in groups:  # brute force: join groups that overlap
        groups = [set().union(*[h for h in groups if g & h]) for g in groups]
    want = {s: min(g) for g in groups for s in g}
    assert want == {3: 3, 50: 3, 99: 3, 7: 7, 8: 7, 42: 7, 1: 1, 60: 60}
    assert {r.s: r.merged for r in on("u03_overlap_merge", events)} == want


def test_gap_probe_asks_every_one_way_pair(on):
    # Trip u runs 69 + u -> 70 + u, which no footpath joins; trip 99 runs back from 99 to 70 at the day's end.
    events = [(10 * u + i, u, 1, 10 * u + 3 * i, 69 + u + i) for u in range(1, 30) for i in (0, 1)]
    events += [(5000, 99, 1, 1000, 99), (5001, 99, 1, 1100, 70)]
    got = {(r.req >> 32, r.req & 0xFFFFFFFF) for r in on("g14_gap_probe", events)}
    assert got == {(70 + u, 69 + u) for u in range(1, 30)} | {(70, 99)}


def trips(seed=3):
    rng = random.Random(seed)
    events, e = [], 0
    for u in range(1, 25):
        for minute in sorted(rng.sample(range(100, 1400), rng.randrange(2, 7))):
            e += 1
            events.append((e, u, 1, minute, rng.randrange(12)))
    stops = {}
    for _, u, _, minute, s in events:
        stops.setdefault(u * 100 + 1, []).append((s, minute))
    conn = [(t, i + 1, *a, *b) for t, x in stops.items() for i, (a, b) in enumerate(zip(x, x[1:])) if a[0] != b[0]]
    return events, stops, conn


def test_transfers_of_any_wait(on):
    events, _, conn = trips()
    bus = lambda c: c[0] // 100 % 5 == 4
    want = Counter(a[4] for a in conn for b in conn if a[4] == b[2] and a[5] + (6 if bus(a) or bus(b) else 4) <= b[3] and a[0] != b[0])
    assert {r.station: r.transfers for r in on("j02_transfer_join", events)} == want


def test_footpaths_at_any_time(on):
    events, _, conn = trips()
    got = on("j04_footpath_expansion", events)
    assert {(r.trip_id, r.seq) for r in got} == {c[:2] for c in conn}  # each of these stations has a neighbour
    assert max(r.at for r in got) > 1000


def test_assigned_times_of_all_stops_and_without_departure(on):
    events, stops, conn = trips()
    got = {(r.trip_id, r.seq): (r.board, r.from_timetable) for r in on("q13_assigned_times", events)}
    want = {}
    for t, x in stops.items():
        for i, (s, minute) in enumerate(x):
            later = [c[3] for c in conn if c[2] == s and c[3] >= minute + 3]
            mid = [c[3] for c in conn if c[2] == s and 600 <= c[3] <= 960]
            headway = (max(mid) - min(mid)) / (len(mid) - 1) if len(mid) > 1 else 15
            want[t, i + 1] = (min(later), True) if later else (minute + 3 + math.floor(headway / 2 + 0.5), False)
    assert got == want and not all(found for _, found in want.values())


def test_round_trip_and_baseline_see_changes(spark, on):
    from chronoline.plans import q_sources

    form = "trip_id long, seq long, station_id int, arr int, dep int"
    rows = [(101, 1, 5, None, 10), (101, 2, 6, 20, None), (201, 1, 5, None, 30), (201, 2, 7, 40, None)]
    there = spark.createDataFrame(rows, form)
    moved = spark.createDataFrame([*rows[:3], (201, 2, 8, 40, None), (301, 1, 5, None, 1)], form)
    assert {r.trip_id: r.same for r in q_sources.round_trip(there, moved).collect()} == {101: True, 201: False, 301: False}
    assert sorted(map(tuple, q_sources.differences(there, moved).collect())) == [(201, 2), (301, 1)]
    events, stops, _ = trips()
    assert {r.trip_id: r.same for r in on("m28_round_trip", events)} == dict.fromkeys(stops, True)
    assert on("s32_golden_diff", events) == []
