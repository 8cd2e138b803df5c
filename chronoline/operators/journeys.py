"""Journeys over the exact scan: options, alternatives, ranking, budgets and profiles.

A Planner answers one request at a time from a network that a worker holds; ``plan``
spreads requests over the cluster.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoline.operators.graph import Runs, Scan, packed, settled
from chronoline.operators.timetable import placed

DAY, FIRST_SERVICE = 1440, 240
#: Results of a search, later departures tried, rounds of other lines, cheap variants under a budget.
MOST, LATER, ROUNDS, CHEAP = 12, 4, 6, 3
#: What ``plan`` gives.
FOUND = pa.schema([*((c, pa.int64()) for c in ("req", "place", "dep", "arr", "transfers", "fare")), ("over", pa.bool_()), ("score", pa.float64()), ("json", pa.string())])


@dataclass(frozen=True)
class Options:
    """What a search may use.

    bus_only wins over no_bus, rail and operators; an empty operators set is no filter.  rail: 'jr' for JR lines
    only, whatever the operators; 'private' for all others, unless operators names them.  Both leave out buses.
    """

    day: int | None = None
    no_bus: bool = False
    bus_only: bool = False
    operators: frozenset = frozenset()
    rail: str | None = None
    express: bool = True
    bullet: bool = True
    ban_trips: frozenset = frozenset()
    ban_lines: frozenset = frozenset()
    budget: float | None = None


@dataclass
class Journey:
    legs: list[tuple]
    dep: int
    arr: int
    fare: int | None = None
    min_fare: int | None = None
    paid: bool = False
    over: bool = False
    score: float = field(default=0.0)

    @property
    def rides(self) -> list[tuple]:
        return [x for x in self.legs if x[0] == "ride"]

    @property
    def transfers(self) -> int:
        return len(self.rides) - 1

    def signature(self) -> tuple:
        return tuple(self.legs)


class Planner:
    """conn and foot as for Scan; trips: (trip_id, line, cls, operator), cls being 'paid', 'shinkansen' or null, none if conn has their kinds."""

    def __init__(self, conn: pd.DataFrame | Runs, foot: pd.DataFrame, trips: pd.DataFrame | None = None, fare: Callable[[Journey], tuple[int, int] | None] | None = None):
        if trips is not None:
            kinds = {t: json.dumps([line, cls if isinstance(cls, str) else None, op]) for t, line, cls, op in trips[["trip_id", "line", "cls", "operator"]].itertuples(index=False, name=None)}
            conn = conn.assign(kind=[kinds.get(t, Runs.UNKNOWN) for t in conn["trip_id"]])
        self.scan = Scan(conn, foot)
        #: (line, cls, operator) of the trips of journeys.
        self.trips: dict[int, tuple] = {}
        self.price = fare or (lambda j: None)

    def _allows(self, o: Options) -> Callable[[dict[str, np.ndarray]], np.ndarray]:
        def allow(line: str, cls: str | None, operator: str, bus: bool) -> bool:
            if line in o.ban_lines:
                return False
            if o.bus_only:
                return bus
            if bus and (o.no_bus or o.operators or o.rail):
                return False
            if o.rail == "jr":
                if operator != "JR":
                    return False
            elif o.operators:
                if operator not in o.operators:
                    return False
            elif o.rail == "private" and operator in ("", "JR"):
                return False
            return not (cls == "paid" and not o.express) and not (cls == "shinkansen" and not o.bullet)

        rail, buses = (np.array([allow(*k, bus) for k in self.scan.conn.kinds], bool) for bus in (False, True))

        def among(c: dict[str, np.ndarray]) -> np.ndarray:
            may = np.where(c["mode"] == 1, buses[c["kind"]], rail[c["kind"]])
            return may & ~np.isin(c["trip_id"], list(o.ban_trips)) if o.ban_trips else may

        return among

    def query(self, source: int, target: int, start: int, o: Options = Options()) -> Journey | None:
        """Earliest arrival; None where there is no ride or it is not reached."""
        label = self.scan.query(source, target, start, o.day, among=self._allows(o))
        legs = self.scan.legs(label, target, self.trips) if source != target else []
        legs = self._without_loop(legs, source)
        rides = [x for x in legs if x[0] == "ride"]
        if not rides:
            return None
        dep = rides[0][3] - (legs[0][3] if legs[0][0] == "walk" else 0)
        j = Journey(legs, dep, label[target][0])
        j.paid = any(self.trips.get(x[1], ("", None, ""))[1] for x in rides)
        if (priced := self.price(j)) is not None and priced[0] > 0:
            j.fare, j.min_fare = priced
        j.over = o.budget is not None and j.min_fare is not None and j.min_fare > o.budget
        return j if j.arr > j.dep else None

    def _without_loop(self, legs: list[tuple], source: int) -> list[tuple]:
        """Start where a ride passes the origin for the last time."""
        for k in range(len(legs) - 1, -1, -1):
            if legs[k][0] != "ride":
                continue
            _, trip, a, dep, b, arr = legs[k]
            if a != source and (again := self._calls(trip, source, dep % DAY + 1, dep % DAY + (arr - dep))):
                return [("ride", trip, source, dep + max(again)[1] - dep % DAY, b, arr), *legs[k + 1 :]]
        return legs

    def _calls(self, trip: int, station: int, since: int, until: int) -> list[tuple[int, int]]:
        """(seq, departure) of a trip at a station from ``since`` to before ``until``."""
        out = []
        for _, head, c in self.scan.conn.since(since):
            if head >= until:
                break
            at = (c["trip_id"] == trip) & (c["dep_s"] == station) & (c["dep_t"] >= since) & (c["dep_t"] < until)
            out += zip(c["seq"][at].tolist(), c["dep_t"][at].tolist())
        return out

    def find(self, source: int, target: int, start: int, o: Options = Options()) -> list[Journey]:
        """The best journey and its alternatives, ranked; see MOST."""
        found: dict[tuple, Journey] = {}

        def add(j: Journey | None) -> Journey | None:
            if j is not None:
                found.setdefault(j.signature(), j)
            return j

        best = add(self.query(source, target, start, o))
        if best is None:
            return []
        at = best
        for _ in range(LATER):
            if (at := add(self.query(source, target, at.dep + 1, o))) is None:
                break
        free = replace(o, express=False, bullet=False)
        add(self.query(source, target, start, free))
        add(self.query(source, target, start, replace(o, ban_trips=o.ban_trips | {best.rides[0][1]})))
        first, banned = {self.trips.get(best.rides[0][1], ("",))[0]}, set(o.ban_lines)
        for _ in range(ROUNDS):
            used = {self.trips.get(x[1], ("",))[0] for j in found.values() for x in j.rides} - first
            if used <= banned:
                break
            banned |= used
            if add(self.query(source, target, start, replace(o, ban_lines=frozenset(banned)))) is None:
                break
        if o.budget is not None:
            at = best
            for _ in range(CHEAP):
                if (at := add(self.query(source, target, at.dep + 1, free))) is None:
                    break
        return self.ranked(list(found.values()), o)

    @staticmethod
    def ranked(journeys: list[Journey], o: Options = Options()) -> list[Journey]:
        """Within the budget if any is, by score, transfers, arrival and late departure; else the cheapest first, unknown last."""
        known = [j.fare for j in journeys if j.fare is not None]
        base = min(known, default=0)
        for j in journeys:
            if j.fare is None:
                extra = 18.0 if j.paid else 0.0
            else:
                extra = min((j.fare - base) / 40, 120.0)
                extra = max(extra, 18.0) if j.paid else extra
            j.score = j.arr + 4 * j.transfers + extra
        if o.budget is not None:
            if any(not j.over and j.fare is not None for j in journeys):
                journeys = [j for j in journeys if not j.over]
            else:
                return sorted(journeys, key=lambda j: (math.inf if j.min_fare is None else j.min_fare, j.score, j.arr))[:MOST]
        return sorted(journeys, key=lambda j: (j.score, j.transfers, j.arr, -j.dep, repr(j.legs)))[:MOST]

    def next(self, source: int, target: int, dep: int, o: Options = Options()) -> Journey | None:
        """The next departure after ``dep``; journeys over budget are passed by, six at most."""
        for _ in range(7):
            j = self.query(source, target, dep + 1, o)
            if j is None or not j.over:
                return j
            dep = j.dep
        return None

    def profile(self, source: int, target: int, start: int, stop: int, o: Options = Options()) -> list[Journey]:
        """Every earliest-arrival journey that departs from ``start`` up to ``stop``, each once."""
        out, at = [], start
        while at <= stop:
            j = self.query(source, target, at, o)
            if j is None or j.dep > stop:
                break
            out.append(j)
            at = max(j.dep, at) + 1
        return out

    def previous(self, source: int, target: int, dep: int, o: Options = Options(), window: int = 180) -> Journey | None:
        """The last departure before ``dep``, within a window."""
        before = [j for j in self.profile(source, target, max(0, dep - window), dep - 1, o) if j.dep < dep and not j.over]
        return max(before, key=lambda j: (j.dep, -j.arr), default=None)

    def first_and_last(self, source: int, target: int, o: Options = Options()) -> tuple[Journey | None, Journey | None]:
        """From four o'clock on: the first service, and the last before services thin out or the day ends."""
        first, last = self.query(source, target, FIRST_SERVICE, o), None
        for anchor in (1260, 1080, 900, 720, 480, FIRST_SERVICE):
            if (last := self.query(source, target, anchor, o)) is not None and last.dep < DAY:
                break
        while last is not None:  # each departs later than the one before it
            j = self.query(source, target, last.dep + 1, o)
            if j is None or j.dep >= DAY or j.arr - j.dep > 1.8 * (last.arr - last.dep) + 30:
                break
            last = j
        return first, last

    def latest(self, source: int, target: int, arrive_by: int, not_before: int | None = None, o: Options = Options()) -> Journey | None:
        """The latest departure that arrives in time; by default eight hours back, not before four o'clock."""
        since = max(FIRST_SERVICE, arrive_by - 480) if not_before is None else not_before
        fits = [j for j in self.profile(source, target, since, arrive_by, o) if j.arr <= arrive_by]
        return max(fits, key=lambda j: (j.dep, -j.arr), default=None)


#: Kilometres from which a journey most likely asks for a night on the way.
OVERNIGHT_KM = 1200


def overnight(km: Column) -> Column:
    """Whether to hint at a night on the way."""
    return km >= OVERNIGHT_KM


def as_json(j: Journey) -> str:
    return json.dumps({"dep": j.dep, "arr": j.arr, "min": j.arr - j.dep, "transfers": j.transfers, "fare": j.fare, "legs": [list(x) for x in j.legs]}, default=int)


def plan(requests: DataFrame, conn: DataFrame, foot: DataFrame, trips: DataFrame, fare: Callable[[Journey], tuple[int, int] | None] | None = None) -> DataFrame:
    """(req, place, dep, arr, transfers, fare, over, score, json) for requests (req, what, source, target, at, options).

    what: 'find', 'next', 'previous', 'first', 'last' or 'latest'; options: JSON of Options' fields.  Requests are dealt
    over tasks.  Each task gets the day's timetable as packed runs and keeps them in a file; it never passes the driver,
    where only the footpaths are gathered.
    """
    spark = requests.sparkSession
    known = trips.groupBy("trip_id").agg(F.max(F.struct("line", "cls", "operator")).alias("k"))
    kind = F.when(F.col("k").isNull(), Runs.UNKNOWN).otherwise(F.to_json(F.array("k.line", "k.cls", "k.operator")))
    rows = conn.select("dep_s", "dep_t", "arr_s", "arr_t", "trip_id", "seq", "mode", "cal").join(known, "trip_id", "left").withColumn("kind", kind)
    runs = settled(packed(rows), "runs")
    asked = requests.select("req", "what", "source", "target", "at", "options")
    tasks = max(1, min(asked.count(), spark.sparkContext.defaultParallelism))
    task = ((F.col("place") - 1) % tasks).cast("int").alias("task")
    asked = placed(asked, ["req"], "place").select(task, F.lit(None).cast("binary").alias("run"), F.struct(*asked.columns).alias("r"))
    copies = runs.select(F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"), "run", F.lit(None).cast(asked.schema["r"].dataType).alias("r"))
    walks = spark.sparkContext.broadcast(foot.select("a", "b", "walk").toPandas())

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, mine = [], None

        def network() -> Iterator[bytes]:
            nonlocal mine
            for part in parts:
                for task, run, r in zip(part.column("task").to_pylist(), part.column("run"), part.column("r").to_pylist()):
                    mine = task if mine is None else mine
                    if r is not None:
                        wanted.append(r)
                    elif task == mine:  # one copy, should tasks be put together
                        yield run.as_py()

        planner = Planner(Runs(network()), walks.value, None, fare)
        for r in wanted:
            given = json.loads(r["options"]) if r["options"] else {}
            o = Options(**{k: frozenset(v) if isinstance(v, list) else v for k, v in given.items()})
            way = r["source"], r["target"]
            ask = {
                "find": lambda: planner.find(*way, r["at"], o),
                "next": lambda: [planner.next(*way, r["at"], o)],
                "previous": lambda: [planner.previous(*way, r["at"], o)],
                "first": lambda: [planner.first_and_last(*way, o)[0]],
                "last": lambda: [planner.first_and_last(*way, o)[1]],
                "latest": lambda: [planner.latest(*way, r["at"], None, o)],
            }[r["what"]]
            out = [(r["req"], i, j.dep, j.arr, j.transfers, j.fare, j.over, j.score, as_json(j)) for i, j in enumerate(ask(), 1) if j is not None]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), FOUND.types)], schema=FOUND)

    dealt = asked.unionByName(copies).repartitionById(tasks, "task")
    return dealt.mapInArrow(run, "req long, place long, dep long, arr long, transfers long, fare long, over boolean, score double, json string")
