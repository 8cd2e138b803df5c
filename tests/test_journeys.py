"""Journey queries: the network never passes the driver, and the results are those of a planner that holds it all."""

import datetime
import json
import random

import pandas as pd
import pytest

from chronoline.operators import graph, journeys
from chronoline.plans import q_search, registry
from chronoline.plans.adapter import Network

QUERIES = ["q01_journeys", "q02_next_journey", "q03_previous_journey", "q04_first_and_last", "q05_latest_departure"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A few thousand connections between few stations."""
    rng, rows = random.Random(5), []
    for user in range(300):
        for minute in sorted(rng.sample(range(200, 1430), 8)):
            at = datetime.datetime(2026, 6, 1 + user % 7) + datetime.timedelta(minutes=minute)
            rows.append((len(rows), user, at, rng.choice(["view", "purchase", "signup", "click"]), 1.0, f'{{"k": {rng.choice([3, 4, 8, 21, 55, 77, 90])}}}'))
    path = tmp_path_factory.mktemp("journeys")
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string, value double, props string").write.parquet(f"{path}/events.parquet")
    return str(path)


def at_once(spark, folder, asked):
    """The answers of one planner over the whole network."""
    n = Network(spark, folder)
    conn, foot, trips = q_search_network(n)
    planner = journeys.Planner(conn, foot, trips, q_search._fare)
    out = []
    for req, (what, source, target, at, options) in enumerate(asked):
        o = journeys.Options(**{k: frozenset(v) if isinstance(v, list) else v for k, v in json.loads(options or "{}").items()})
        found = {
            "find": lambda: planner.find(source, target, at, o),
            "next": lambda: [planner.next(source, target, at, o)],
            "previous": lambda: [planner.previous(source, target, at, o)],
            "first": lambda: [planner.first_and_last(source, target, o)[0]],
            "last": lambda: [planner.first_and_last(source, target, o)[1]],
            "latest": lambda: [planner.latest(source, target, at, None, o)],
        }[what]()
        out += [(req, i, j.dep, j.arr, j.transfers, j.fare, j.over, j.score, journeys.as_json(j)) for i, j in enumerate(found, 1) if j is not None]
    return out


def q_search_network(n):
    company = dict(map(tuple, n.company.collect()))
    trips = n.trip.toPandas()
    trips["cls"] = [{("purchase", 2): "paid", ("signup", 1): "shinkansen"}.get(x) for x in zip(trips["line"], trips["type_id"])]
    return n.conn.toPandas(), n.foot.toPandas(), trips.assign(operator=trips["line"].map(company))


@pytest.mark.parametrize("name", QUERIES)
def test_the_network_stays_off_the_driver(spark, folder, monkeypatch, name):
    with monkeypatch.context() as m:
        m.setattr(q_search, "_plan", lambda n, asked: asked)
        asked = registry.queries()[name](spark, folder)
    want = at_once(spark, folder, asked)
    n = Network(spark, folder)
    connections, pairs, gathered = n.conn.count(), n.foot.count(), []
    monkeypatch.setattr(graph.Runs, "ROWS", 100)
    monkeypatch.setattr(graph.Runs, "HELD", 3)
    kind = type(n.ev)
    for how in ("toPandas", "toArrow"):
        monkeypatch.setattr(kind, how, lambda self, f=getattr(kind, how): (gathered.append(len(out := f(self))), out)[1])
    df = registry.queries()[name](spark, folder)
    assert connections > 1000 > pairs and gathered and max(gathered) <= pairs
    monkeypatch.undo()
    assert want and sorted(map(tuple, df.collect())) == sorted(want)


def test_short_runs_change_nothing(monkeypatch):
    rng = random.Random(9)
    rows = [(rng.randrange(12), t := rng.randrange(1400), rng.randrange(12), t + rng.randrange(1, 30), k // 3, k, k % 5 == 0, rng.choice([1, 3, 7])) for k in range(400)]
    conn = pd.DataFrame(rows, columns=["dep_s", "dep_t", "arr_s", "arr_t", "trip_id", "seq", "mode", "cal"]).astype(int)
    foot = pd.DataFrame([(1, 9, 5), (3, 4, 7)], columns=["a", "b", "walk"])

    def labels():
        scan = graph.Scan(conn, foot)
        found = [scan.query(s, t, start, day) for s in range(12) for t, start, day in ((None, 0, None), (5, 700, None), (7, 1390, 1))]
        return found, [scan.legs(label, t) for label in found for t in range(12)], len(scan.conn.lasts)

    whole = labels()
    monkeypatch.setattr(graph.Runs, "ROWS", 7)
    monkeypatch.setattr(graph.Runs, "HELD", 2)
    short = labels()
    assert whole[2] == 1 and short[2] == 58 and short[:2] == whole[:2]


@pytest.mark.parametrize(("since", "until", "step", "late"), [(1260, 1440, 2, None), (1260, 1440, 1, None), (240, 479, 1, None), (1260, 1380, 1, (1400, 1435))])
def test_the_last_service_follows_every_departure(since, until, step, late):
    """More than eighty departures after the hour it begins at, up to the end of the day or to where services thin out."""
    times = [(m, m + 1) for m in range(since, until, step)]
    rows = [(1, dep, 2, arr, k, 1, 0, 7) for k, (dep, arr) in enumerate([*times, late] if late else times)]
    conn = pd.DataFrame(rows, columns=["dep_s", "dep_t", "arr_s", "arr_t", "trip_id", "seq", "mode", "cal"])
    first, last = journeys.Planner(conn, pd.DataFrame([], columns=["a", "b", "walk"])).first_and_last(1, 2)
    assert len(times) > 81 and (first.dep, last.dep, last.arr) == (since, *times[-1])


def test_q04_follows_every_departure(spark, tmp_path):
    """A service every two minutes from nine o'clock in the evening on, by rail from 8 to 55 and by bus from 3 to 77."""
    rows = []
    for way, mode in (((8, 55), 0), ((3, 77), 4)):
        for k, minute in enumerate(range(1260, 1440, 2)):
            for i, station in enumerate(way):
                at = datetime.datetime(2026, 6, 1) + datetime.timedelta(minutes=minute + i)
                rows.append((len(rows), 5 * k + mode, at, "view", 1.0, f'{{"k": {station}}}'))
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    found = registry.queries()["q04_first_and_last"](spark, str(tmp_path)).select("req", "dep", "arr").collect()
    assert sorted(map(tuple, found)) == [(0, 1260, 1261), (1, 1438, 1439), (2, 1438, 1439)]
