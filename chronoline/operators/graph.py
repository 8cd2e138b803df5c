"""Station graphs: components, spanning links, searches over connections."""

from __future__ import annotations

import bisect
import heapq
import itertools
import json
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def undirected(conn: DataFrame, a: str = "dep_s", b: str = "arr_s") -> DataFrame:
    return conn.groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(F.count("*").alias("n"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local session without one gets its own, a cluster has to name one."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="chronoline-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def own_folder(spark: SparkSession) -> str:
    """This application's folder below the shared one; it goes when the driver ends."""
    sc = spark.sparkContext
    folder = f"{shared_folder(spark)}/chronoline/{sc.applicationId}"
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if not files.exists(path):
        files.mkdirs(path)
        files.deleteOnExit(path)
    return folder


def settled(df: DataFrame, name: str) -> DataFrame:
    """Write and reread in the shared folder, so that a loop's lineage ends."""
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 100) -> DataFrame:
    """(node, component): the smallest node that each node is linked to, by label propagation with pointer jumping."""
    both = settled(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(F.col(b), F.col(a))).distinct(), "edges")
    label = settled(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")), "label")
    for _ in range(rounds):
        near = both.join(label, both["v"] == label["node"]).groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        once = label.join(near, "node").select("node", F.least("label", "near").alias("label"))
        jump = once.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = settled(once.join(jump, "label", "left").select("node", F.least("label", F.coalesce("next", "label")).alias("label")), "label")
        moved = new.join(label.withColumnRenamed("label", "old"), "node").where("label <> old").isEmpty()
        label = new
        if moved:
            return label.select("node", F.col("label").alias("component"))
    raise RuntimeError("components did not settle")


def spanning_links(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(a, b, n): a spanning forest of the least (weight, a, b) edges, by Boruvka's rounds.

    edges: (a, b, n), the weight being n.  Each round every component takes its least outgoing edge.
    """
    left = settled(edges.select("a", "b", "n"), "edges")
    nodes = left.select(F.col("a").alias("node")).union(left.select("b")).distinct()
    label = settled(nodes.select("node", F.col("node").alias("component")), "label")
    chosen = None
    for _ in range(rounds):
        la, lb = label.select(F.col("node").alias("a"), F.col("component").alias("ca")), label.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        out = settled(left.join(la, "a").join(lb, "b").where("ca <> cb"), "crossing")
        if out.isEmpty():
            break
        edge = F.struct("n", "a", "b")
        best = out.select(F.col("ca").alias("c"), edge.alias("e")).union(out.select(F.col("cb"), edge.alias("e"))).groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct()
        chosen = settled(best if chosen is None else chosen.union(best).distinct(), "chosen")
        found = components(chosen.select("a", "b"))
        label = settled(nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "label")
    return (chosen if chosen is not None else left.limit(0)).select("a", "b", "n")


def reach_rounds(conn: DataFrame, foot: DataFrame, source: int, start: int, change: int = 4, rounds: int = 200) -> DataFrame:
    """(station_id, arr): earliest arrivals from one station by relational rounds.

    A connection may be taken from a station whose arrival is ``change`` minutes earlier (none at
    the source).  Walks follow each arrival.  Rounds go on until no label improves.
    """
    spark = conn.sparkSession
    walks = settled(foot.select("a", "b", "walk").union(foot.select("b", "a", "walk")), "walks")
    hops = settled(conn.where(F.col("dep_t") >= start).select("dep_s", "dep_t", "arr_s", "arr_t"), "hops")
    label = settled(spark.createDataFrame([(source, start, 0)], "station_id int, arr int, buffer int"), "label")
    for _ in range(rounds):
        ride = hops.join(label, (hops["dep_s"] == label["station_id"]) & (label["arr"] + label["buffer"] <= hops["dep_t"])).select(F.col("arr_s").alias("station_id"), F.col("arr_t").alias("arr"))
        walk = label.join(walks, label["station_id"] == walks["a"]).select(F.col("b").alias("station_id"), (F.col("arr") + F.col("walk")).alias("arr"))
        more = ride.unionByName(walk).withColumn("buffer", F.lit(change))
        best = label.unionByName(more).groupBy("station_id").agg(F.min(F.struct("arr", "buffer")).alias("x")).select("station_id", "x.arr", "x.buffer")
        new = settled(best, "label")
        same = new.exceptAll(label).isEmpty()
        label = new
        if same:
            return label.select("station_id", "arr")
    raise RuntimeError("labels did not settle")


class Runs:
    """Connections in order of (dep_t, trip_id, seq) in runs of columns, which lie in a file; those used last are held.

    ``packed`` makes the runs on the cluster, in any order; ``kinds`` are the (line, cls, operator) of their trips,
    which the column kind numbers.
    """

    ROWS, HELD = 10_000, 48
    COLUMNS = ["dep_s", "dep_t", "arr_s", "arr_t", "trip_id", "seq", "mode", "cal", "kind"]
    #: Of a trip that nothing is known of.
    UNKNOWN = '["",null,""]'

    def __init__(self, runs: Iterable[bytes]):
        self.file, found, end = tempfile.TemporaryFile(), [], 0
        self.kinds: list[tuple] = []
        self.numbers: dict[str, int] = {}
        self.held: dict[int, dict[str, np.ndarray]] = {}
        for run in runs:
            rows = self._read(run)
            for name in rows.column("kind").chunk(0).dictionary.to_pylist():
                if name not in self.numbers:
                    self.numbers[name] = len(self.kinds)
                    self.kinds.append(tuple(json.loads(name)))
            head = tuple(rows.column(c)[0].as_py() for c in ("dep_t", "trip_id", "seq"))
            found.append((head, rows.column("dep_t")[-1].as_py(), rows.num_rows, end, len(run)))
            self.file.write(run)
            end += len(run)
        found.sort(key=lambda x: x[0])
        self.heads, self.lasts, self.places = [x[0][0] for x in found], [x[1] for x in found], [x[3:] for x in found]
        self.bases = [0, *itertools.accumulate(x[2] for x in found)]

    @classmethod
    def of(cls, conn: pd.DataFrame) -> Runs:
        rows = conn.sort_values(["dep_t", "trip_id", "seq"], kind="stable")
        rows = rows if "kind" in rows else rows.assign(kind=cls.UNKNOWN)
        return cls(cls.cut(pa.Table.from_pandas(rows[cls.COLUMNS], preserve_index=False)))

    @classmethod
    def cut(cls, rows: pa.Table) -> Iterator[bytes]:
        """Sorted rows as runs."""
        for lo in range(0, rows.num_rows, cls.ROWS):
            part = rows.slice(lo, cls.ROWS).combine_chunks()
            part = part.set_column(part.column_names.index("kind"), "kind", part.column("kind").dictionary_encode())
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(part)
            yield sink.getvalue().to_pybytes()

    @staticmethod
    def _read(run: bytes) -> pa.Table:
        return pa.ipc.open_stream(run).read_all()

    def run(self, k: int) -> dict[str, np.ndarray]:
        if (c := self.held.pop(k, None)) is None:
            at, size = self.places[k]
            self.file.seek(at)
            rows = self._read(self.file.read(size))
            c = {x: rows.column(x).to_numpy() for x in self.COLUMNS if x != "kind"}
            kind = rows.column("kind").chunk(0)
            c["kind"] = np.array([self.numbers[x] for x in kind.dictionary.to_pylist()], np.int64)[kind.indices.to_numpy()]
            while len(self.held) >= self.HELD:
                del self.held[next(iter(self.held))]
        self.held[k] = c  # the last in order
        return c

    def since(self, dep: int) -> Iterator[tuple[int, int, dict[str, np.ndarray]]]:
        """(number of the first row, its departure, columns) of the runs from the first with a departure at ``dep`` or later."""
        for k in range(bisect.bisect_left(self.lasts, dep), len(self.lasts)):
            yield self.bases[k], self.heads[k], self.run(k)

    def row(self, i: int) -> tuple:
        k = bisect.bisect_right(self.bases, i) - 1
        c = self.run(k)
        return tuple(c[x][i - self.bases[k] : i - self.bases[k] + 1].tolist()[0] for x in self.COLUMNS)


def packed(conn: DataFrame) -> DataFrame:
    """(run): the connections, with their kind, as runs for ``Runs``; sorted and packed by ranges, so no process holds them all."""

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for run in Runs.cut(pa.Table.from_batches([part])):
                yield pa.RecordBatch.from_arrays([pa.array([run], pa.binary())], ["run"])

    return conn.select(*Runs.COLUMNS).orderBy("dep_t", "trip_id", "seq").mapInArrow(pack, "run binary")


class Scan:
    """Earliest arrival over a time-ordered list of connections, with the trips that were boarded."""

    CHANGE, BUS_CHANGE, EXTRA_DAYS = 4, 6, 2

    def __init__(self, conn: pd.DataFrame | Runs, foot: pd.DataFrame):
        self.conn = conn if isinstance(conn, Runs) else Runs.of(conn)
        self.walks: dict[int, list[tuple[int, int]]] = {}
        for a, b, w in foot[["a", "b", "walk"]].itertuples(index=False, name=None):
            self.walks.setdefault(a, []).append((b, w))
            self.walks.setdefault(b, []).append((a, w))

    def query(self, source: int, target: int | None, start: int, day: int | None = None, allow=lambda trip, mode: True, among=None) -> dict[int, tuple[int, tuple | None]]:
        """Station -> (arrival, how): how is None at the source, ('walk', from, minutes) or ('ride', boarding row, row, shift).

        allow(trip, mode) judges one connection, among(columns) those of a run at once.
        """
        label: dict[int, tuple[int, tuple | None]] = {source: (start, None)}
        on_foot = {source}
        last_mode: dict[int, int] = {}
        for s, w in self.walks.get(source, ()):
            label[s] = (start + w, ("walk", source, w))
            on_foot.add(s)
        for extra in range(self.EXTRA_DAYS + 1):
            boarded: dict[int, int] = {}
            shift = 1440 * extra
            for base, head, c in self.conn.since(start - shift):
                if target in label and head + shift > label[target][0]:
                    break
                may = c["dep_t"] + shift >= start
                if day is not None:
                    may &= c["cal"] >> day & 1 == 1
                if among is not None:
                    may &= among(c)
                at = np.flatnonzero(may)
                for i, dep_s, dep, arr_s, arr, trip, mode in zip((at + base).tolist(), *(c[x][at].tolist() for x in ("dep_s", "dep_t", "arr_s", "arr_t", "trip_id", "mode"))):
                    if not allow(trip, mode):
                        continue
                    dep, arr = dep + shift, arr + shift
                    if target in label and dep > label[target][0]:
                        return label
                    if trip not in boarded:
                        if dep_s not in label:
                            continue
                        need = 0 if dep_s in on_foot else self.BUS_CHANGE if mode == 1 or last_mode.get(dep_s) == 1 else self.CHANGE
                        if label[dep_s][0] + need > dep:
                            continue
                        boarded[trip] = i
                    if arr_s not in label or arr < label[arr_s][0]:
                        label[arr_s] = (arr, ("ride", boarded[trip], i, shift))
                        last_mode[arr_s] = mode
                        on_foot.discard(arr_s)
                        for s, w in self.walks.get(arr_s, ()):
                            if s not in label or arr + w < label[s][0]:
                                label[s] = (arr + w, ("walk", arr_s, w))
                                last_mode[s] = mode
                                on_foot.discard(s)
            if target in label:
                return label
        return label

    def legs(self, label: dict, target: int, kinds: dict[int, tuple] | None = None) -> list[tuple]:
        """Legs from the source: ('walk', from, to, minutes) or ('ride', trip, from, dep, to, arr); empty if not reached.

        kinds: takes the (line, cls, operator) of the trips on the way.
        """
        out, at, guard = [], target, 0
        while at in label and label[at][1] is not None and guard < 500:
            how = label[at][1]
            if how[0] == "walk":
                out.append(("walk", how[1], at, how[2]))
                at = how[1]
            else:
                on, off = self.conn.row(how[1]), self.conn.row(how[2])
                out.append(("ride", on[4], on[0], on[1] + how[3], off[2], off[3] + how[3]))
                if kinds is not None:
                    kinds[on[4]] = self.conn.kinds[on[8]]
                at = on[0]
            guard += 1
        return out[::-1]


class BatchScan:
    """The scan of ``Scan`` for many requests at once: one pass over the connections, a column of labels for each request.

    Connections are columns, sorted by departure; a pass begins at the first that any request can reach.
    """

    FAR = np.iinfo(np.int32).max // 2

    def __init__(self, conn: dict[str, np.ndarray], foot: dict[str, np.ndarray]):
        order = np.lexsort([conn["seq"], conn["trip_id"], conn["dep_t"]])
        self.conn = {k: v[order] for k, v in conn.items()}
        names = np.unique(np.concatenate([conn["dep_s"], conn["arr_s"], foot["a"], foot["b"]]))
        self.names, self.at = names, {int(n): i for i, n in enumerate(names)}
        trips, self.trip = np.unique(self.conn["trip_id"], return_inverse=True)
        self.trips = len(trips)
        dep, arr = (np.searchsorted(names, self.conn[c]) for c in ("dep_s", "arr_s"))
        self.rows = list(zip(dep.tolist(), self.conn["dep_t"].tolist(), arr.tolist(), self.conn["arr_t"].tolist(), self.trip.tolist(), self.conn["mode"].tolist(), self.conn["cal"].tolist()))
        self.walks: dict[int, list[tuple[int, int]]] = {}
        for x, y, w in zip(np.searchsorted(names, foot["a"]).tolist(), np.searchsorted(names, foot["b"]).tolist(), foot["walk"].tolist()):
            self.walks.setdefault(x, []).append((y, w))
            self.walks.setdefault(y, []).append((x, w))

    def query(self, source: np.ndarray, target: np.ndarray, start: np.ndarray, day: np.ndarray) -> None:
        """Set label, and how each label came about, for requests (day -1: any).  Stations are numbers of this network."""
        n, r = len(self.names), len(source)
        column = np.arange(r)
        self.label = label = np.full((n, r), self.FAR, np.int32)
        self.on, self.off, self.shift = (np.full((n, r), -1, np.int32) for _ in range(3))
        self.came, self.walked = np.full((n, r), -1, np.int32), np.zeros((n, r), np.int32)
        fresh, bus = np.zeros((n, r), bool), np.zeros((n, r), bool)
        label[source, column], fresh[source, column] = start, True
        for k in range(r):
            for s, w in self.walks.get(int(source[k]), ()):
                label[s, k], self.came[s, k], self.walked[s, k], fresh[s, k] = start[k] + w, source[k], w, True
        live, deps = np.ones(r, bool), self.conn["dep_t"]
        for extra in range(Scan.EXTRA_DAYS + 1):
            if not live.any():
                break
            boarded = np.full((self.trips, r), -1, np.int32)
            shift, open_ = 1440 * extra, live.copy()
            first = int(np.searchsorted(deps, start[open_].min() - shift, "left"))
            bound = label[target, column]
            for i in range(first, len(self.rows)):
                dep_s, dep, arr_s, arr, trip, mode, cal = self.rows[i]
                dep, arr = dep + shift, arr + shift
                open_ &= dep <= bound
                at, aboard = label[dep_s], boarded[trip]
                may = open_ & ((aboard >= 0) | (at <= dep)) & (start <= dep)
                if not may.any():
                    if not open_.any():
                        break
                    continue
                may &= (day < 0) | (cal >> np.maximum(day, 0) & 1 == 1)
                need = np.where(fresh[dep_s], 0, Scan.BUS_CHANGE if mode == 1 else np.where(bus[dep_s], Scan.BUS_CHANGE, Scan.CHANGE))
                steps = may & (aboard < 0) & (at + need <= dep)
                aboard[steps] = i
                better = np.flatnonzero(may & (aboard >= 0) & (arr < label[arr_s]))
                if not len(better):
                    continue
                label[arr_s, better], self.on[arr_s, better], self.off[arr_s, better], self.shift[arr_s, better], self.came[arr_s, better] = arr, aboard[better], i, shift, -1
                bus[arr_s, better], fresh[arr_s, better] = mode == 1, False
                for s, w in self.walks.get(arr_s, ()):
                    some = better[arr + w < label[s, better]]
                    label[s, some], self.came[s, some], self.walked[s, some], self.on[s, some] = arr + w, arr_s, w, -1
                    bus[s, some], fresh[s, some] = mode == 1, False
                bound = label[target, column]
            live &= label[target, column] >= self.FAR

    def legs(self, k: int, source: int, target: int) -> list[tuple]:
        """Legs of request k as ``Scan.legs`` gives them; empty if not reached."""
        out, at, guard = [], target, 0
        c, name = self.conn, lambda s: int(self.names[s])
        while self.label[at, k] < self.FAR and (self.came[at, k] >= 0 or self.on[at, k] >= 0) and guard < 500:
            if self.came[at, k] >= 0:
                out.append(("walk", name(self.came[at, k]), name(at), int(self.walked[at, k])))
                at = int(self.came[at, k])
            else:
                on, off, shift = int(self.on[at, k]), int(self.off[at, k]), int(self.shift[at, k])
                out.append(("ride", int(c["trip_id"][on]), int(c["dep_s"][on]), int(c["dep_t"][on]) + shift, int(c["arr_s"][off]), int(c["arr_t"][off]) + shift))
                at = self.rows[on][0]
            guard += 1
        return out[::-1]


def _columns(df: DataFrame) -> dict[str, np.ndarray]:
    table = df.toArrow()
    return {c: table.column(c).to_numpy().astype(np.int64) for c in table.column_names}


def search(requests: DataFrame, conn: DataFrame, foot: DataFrame, most_rows: int = 20_000_000, batch: int = 128) -> DataFrame:
    """Earliest arrivals for many requests (req, source, target, start, day) by the exact scan.

    Gives (req, dep, arr, rides, walks, path).  The network is a day's timetable, which does not
    grow with the requests: its size is checked, and it is broadcast as columns of numbers.  A task
    answers ``batch`` requests in one pass.  Requests that have no ride, or are not reached, give no row.
    """
    spark = requests.sparkSession
    rows = conn.select("dep_s", "dep_t", "arr_s", "arr_t", "trip_id", "seq", "mode", "cal")
    if (n := rows.count()) > most_rows:
        raise ValueError(f"{n} connections are more than one worker should hold; use reach_rounds")
    net = spark.sparkContext.broadcast((_columns(rows), _columns(foot.select("a", "b", "walk"))))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scan = None
        for whole in parts:
            scan = scan or BatchScan(*net.value)
            known = whole[whole["source"].isin(scan.at) & whole["target"].isin(scan.at)]
            # Requests of about one start share a pass best.
            known = known.sort_values("start", kind="stable")
            for lo in range(0, len(known), batch):
                part, out = known.iloc[lo : lo + batch], []
                source, target = (part[c].map(scan.at).to_numpy(np.int64) for c in ("source", "target"))
                scan.query(source, target, part["start"].to_numpy(np.int64), part["day"].fillna(-1).to_numpy(np.int64))
                for k, (req, s, t) in enumerate(zip(part["req"], source.tolist(), target.tolist())):
                    legs = scan.legs(k, s, t)
                    rides = [x for x in legs if x[0] == "ride"]
                    if rides:
                        first = legs[0]
                        dep = first[3] if first[0] == "ride" else rides[0][3] - first[3]
                        path = " ".join(f"{x[1]}:{x[2]}@{x[3]}>{x[4]}@{x[5]}" if x[0] == "ride" else f"w:{x[1]}>{x[2]}+{x[3]}" for x in legs)
                        out.append((req, dep, int(scan.label[t, k]), len(rides), len(legs) - len(rides), path))
                yield pd.DataFrame(out, columns=["req", "dep", "arr", "rides", "walks", "path"])

    return requests.select("req", "source", "target", "start", "day").mapInPandas(run, "req long, dep long, arr long, rides long, walks long, path string")


def route(edges: pd.DataFrame, source: int, target: int, penalty: float = 6.0, through: frozenset = frozenset(), banned: frozenset = frozenset()) -> dict | None:
    """The quickest path over (a, b, minutes, line) edges with one label a station, as minutes, path and the lines of its runs.

    banned: pairs (from, to) that may not be used.
    """
    near: dict[int, list] = {}
    for a, b, m, line in edges[["a", "b", "minutes", "line"]].itertuples(index=False, name=None):
        near.setdefault(a, []).append((b, m, line))
        near.setdefault(b, []).append((a, m, line))
    best, came = {source: 0.0}, {}
    heap: list[tuple[float, int, str]] = [(0.0, source, "")]
    while heap:
        d, at, line = heapq.heappop(heap)
        if d > best[at]:
            continue
        if at == target:
            break
        for to, m, via in sorted(near.get(at, ())):
            cost = d + m + (penalty if line and via != line and frozenset((line, via)) not in through else 0.0)
            if (at, to) not in banned and cost < best.get(to, float("inf")) - 1e-12:
                best[to], came[to] = cost, (at, via)
                heapq.heappush(heap, (cost, to, via))
    if target not in best:
        return None
    path, lines = [target], []
    while path[-1] != source:
        before, via = came[path[-1]]
        lines += [via] if not lines or lines[-1] != via else []
        path.append(before)
    return {"minutes": best[target], "path": path[::-1], "lines": lines[::-1]}


def alternatives(edges: pd.DataFrame, source: int, target: int, k: int = 3, longest: float = 3.0, **rules) -> list[dict]:
    """Up to ``k`` routes of different lines, the quickest first; others take at most ``longest`` times as long.

    An attempt bans, both ways, the pairs that the routes so far use around a spur point, which moves along one of
    them; pairs before it that are this route's own stay.
    """
    first = route(edges, source, target, **rules)
    found = [first] if first and len(first["path"]) > 1 else []
    seen = {tuple(r["lines"]) for r in found}
    for attempt in range(8 * k if found else 0):
        if len(found) >= k:
            break
        base = found[attempt % len(found)]["path"]
        spur = int((attempt / len(found) + 1) * len(base) / (2 * k))
        if not 0 < spur < len(base) - 1:
            continue
        gone = set()
        for r in found:
            for i, pair in enumerate(zip(r["path"], r["path"][1:])):
                shared = i < spur and i < len(base) - 1 and pair[0] == base[i]
                if spur - 1 <= i < spur + 2 and not shared:
                    gone |= {pair, pair[::-1]}
        other = route(edges, source, target, banned=frozenset(gone), **rules)
        if other and tuple(other["lines"]) not in seen and other["minutes"] <= longest * first["minutes"]:
            seen.add(tuple(other["lines"]))
            found.append(other)
    return found


def dijkstra_with_changes(edges: pd.DataFrame, source: int, penalty: float = 6.0, through: frozenset = frozenset()) -> dict[int, float]:
    """Least minutes over (a, b, minutes, line) edges with one label a station; a change of line costs ``penalty``."""
    near: dict[int, list] = {}
    for a, b, m, line in edges[["a", "b", "minutes", "line"]].itertuples(index=False, name=None):
        near.setdefault(a, []).append((b, m, line))
        near.setdefault(b, []).append((a, m, line))
    best: dict[int, float] = {source: 0.0}
    heap: list[tuple[float, int, str]] = [(0.0, source, "")]
    while heap:
        d, at, line = heapq.heappop(heap)
        if d > best[at]:
            continue
        for to, m, via in sorted(near.get(at, ())):
            cost = d + m + (penalty if line and via != line and frozenset((line, via)) not in through else 0.0)
            if cost < best.get(to, float("inf")) - 1e-12:
                best[to] = cost
                heapq.heappush(heap, (cost, to, via))
    return best
