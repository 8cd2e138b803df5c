"""Transit tables from the driver's tables, as DataFrames and as DuckDB common table expressions.

A trip is a user's events of one day; its line is its most frequent event type (the
smallest name on ties); its calendar bit follows the weekday.  Stations stand on a grid.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chronoline.functions.scalars import haversine_km
from chronoline.operators import graph, spatial, timetable

# Fixed values of the fixture: company of a line, and fare bands (company, ord, km up to, yen).
COMPANY = {"click": "Coast", "error": "Ridge", "purchase": "Metro", "signup": "Ridge", "view": "Metro"}
BANDS = [("Coast", 1, 1, 150), ("Coast", 2, 3, 190), ("Coast", 3, 6, 240), ("Metro", 1, 2, 180), ("Metro", 2, 4, 210), ("Ridge", 1, 1, 160), ("Ridge", 2, 2, 170), ("Ridge", 3, 5, 260), ("Ridge", 4, 9, 310)]


class Network:
    """The transit tables of one data folder; each is made once and only if asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")

    @functools.cached_property
    def ev(self) -> DataFrame:
        return self.read("events").select(
            "event_id",
            "user_id",
            "ts",
            "event_type",
            "value",
            (F.col("user_id") * 100 + F.dayofmonth("ts")).alias("trip_id"),
            F.get_json_object("props", "$.k").cast("int").alias("station_id"),
            (F.hour("ts") * 60 + F.minute("ts")).alias("t"),
        )

    @functools.cached_property
    def st(self) -> DataFrame:
        w = W.partitionBy("trip_id")
        return self.ev.select(
            "trip_id", "station_id", "t", "event_type", F.row_number().over(w.orderBy("t", "event_id")).cast("long").alias("seq"), F.count("*").over(w).alias("n_stops")
        )

    @functools.cached_property
    def trip(self) -> DataFrame:
        line = timetable.most_frequent(self.ev, ["trip_id"], "event_type", "line")
        day = self.ev.groupBy("trip_id").agg(F.min("user_id").alias("user_id"), F.min("ts").alias("ts"))
        cal = F.when(F.weekday("ts") < 5, 1).when(F.weekday("ts") == 5, 2).otherwise(4)
        return day.join(line, "trip_id").select("trip_id", "line", (F.col("user_id") % 3).cast("int").alias("type_id"), cal.alias("cal"), F.when(F.col("user_id") % 5 == 4, 1).otherwise(0).alias("mode"))

    @functools.cached_property
    def conn(self) -> DataFrame:
        return timetable.connections(self.st).join(self.trip, "trip_id")

    @functools.cached_property
    def stn(self) -> DataFrame:
        k = F.col("station_id")
        return self.ev.select("station_id").distinct().select(
            "station_id",
            F.concat(F.lit("S"), k).alias("name"),
            (35 + F.floor(k / 10) * F.lit(0.004)).alias("lat"),
            (139 + (k % 10) * F.lit(0.004)).alias("lon"),
            F.when(k >= 70, 1).otherwise(0).alias("mode"),
            (k % 7).alias("pref"),
        )

    @functools.cached_property
    def foot(self) -> DataFrame:
        return spatial.footpaths(self.stn)

    @functools.cached_property
    def edge(self) -> DataFrame:
        """Undirected station pairs with their number of connections."""
        return graph.undirected(self.conn)

    @functools.cached_property
    def band(self) -> DataFrame:
        return self.spark.createDataFrame(BANDS, "company string, ord int, max_km int, yen int")

    @functools.cached_property
    def company(self) -> DataFrame:
        return self.spark.createDataFrame(sorted(COMPANY.items()), "line string, company string")

    @functools.cached_property
    def leg(self) -> DataFrame:
        """Rides from a trip's first to its last stop: kilometres along the stops, by company."""
        a, b = self.stn.alias("a"), self.stn.alias("b")
        hop = self.conn.join(a, F.col("dep_s") == F.col("a.station_id")).join(b, F.col("arr_s") == F.col("b.station_id"))
        km = haversine_km(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
        return hop.groupBy("trip_id", "line").agg((F.round(F.sum(km), 6)).alias("km"), F.min("dep_t").alias("dep"), F.max("arr_t").alias("arr"), F.count("*").alias("hops")).join(self.company, "line")

    def __getitem__(self, name: str) -> DataFrame:
        return self.read(name) if name in TABLES else getattr(self, name)


TABLES = {"region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages"}
_KM = "2 * 6371.0 * asin(sqrt(power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2)))"
_VALUES = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)

#: DuckDB's version of the tables above.
CTES = {
    "ev": "SELECT event_id, user_id, ts, event_type, value, user_id * 100 + day(ts) AS trip_id, CAST(regexp_extract(props, '[0-9]+') AS INT) AS station_id, CAST(hour(ts) * 60 + minute(ts) AS INT) AS t FROM events",
    "st": "SELECT trip_id, station_id, t, event_type, row_number() OVER (PARTITION BY trip_id ORDER BY t, event_id) AS seq, count(*) OVER (PARTITION BY trip_id) AS n_stops FROM ev",
    "trip": """SELECT d.trip_id, l.event_type AS line, CAST(d.user_id % 3 AS INT) AS type_id, CAST(CASE WHEN isodow(d.ts) < 6 THEN 1 WHEN isodow(d.ts) = 6 THEN 2 ELSE 4 END AS INT) AS cal, CAST(CASE WHEN d.user_id % 5 = 4 THEN 1 ELSE 0 END AS INT) AS mode
        FROM (SELECT trip_id, min(user_id) AS user_id, min(ts) AS ts FROM ev GROUP BY trip_id) d
        JOIN (SELECT trip_id, event_type, row_number() OVER (PARTITION BY trip_id ORDER BY n DESC, event_type) AS r FROM (SELECT trip_id, event_type, count(*) AS n FROM ev GROUP BY ALL)) l ON d.trip_id = l.trip_id AND l.r = 1""",
    "conn": """SELECT c.trip_id, c.seq, c.dep_s, c.dep_t, c.arr_s, c.arr_t, t.line, t.type_id, t.cal, t.mode FROM (SELECT trip_id, seq, station_id AS dep_s, t AS dep_t, lead(station_id) OVER w AS arr_s, lead(t) OVER w AS arr_t FROM st WINDOW w AS (PARTITION BY trip_id ORDER BY seq)) c
        JOIN trip t ON c.trip_id = t.trip_id WHERE c.arr_s IS NOT NULL AND c.arr_s <> c.dep_s""",
    "stn": "SELECT station_id, 'S' || station_id AS name, 35 + floor(station_id / 10) * 0.004::DOUBLE AS lat, 139 + (station_id % 10) * 0.004::DOUBLE AS lon, CAST(CASE WHEN station_id >= 70 THEN 1 ELSE 0 END AS INT) AS mode, station_id % 7 AS pref FROM (SELECT DISTINCT station_id FROM ev)",
    "foot": f"SELECT a.station_id AS a, b.station_id AS b, CAST(round_even({_KM} * 15, 0) + 3 AS INT) AS walk FROM stn a JOIN stn b ON a.station_id < b.station_id AND NOT (a.mode = 1 AND b.mode = 1) AND {_KM} <= 0.4",
    "edge": "SELECT least(dep_s, arr_s) AS a, greatest(dep_s, arr_s) AS b, count(*) AS n FROM conn GROUP BY ALL",
    "band": f"SELECT * FROM (VALUES {_VALUES(BANDS)}) AS t(company, ord, max_km, yen)",
    "company": f"SELECT * FROM (VALUES {_VALUES(sorted(COMPANY.items()))}) AS t(line, company)",
    "leg": f"SELECT x.trip_id, x.line, x.km, x.dep, x.arr, x.hops, k.company FROM (SELECT c.trip_id, c.line, round(sum({_KM}), 6) AS km, min(c.dep_t) AS dep, max(c.arr_t) AS arr, count(*) AS hops FROM conn c JOIN stn a ON c.dep_s = a.station_id JOIN stn b ON c.arr_s = b.station_id GROUP BY c.trip_id, c.line) x JOIN company k ON x.line = k.line",
}


def duck(text: str) -> str:
    """A DuckDB statement over the transit tables; its own WITH list, if any, follows theirs."""
    own = re.match(r"\s*WITH (RECURSIVE )?", text)
    base = ",\n".join(f"{k} AS ({v})" for k, v in CTES.items())
    return f"WITH {(own and own[1]) or ''}{base}{',' if own else ''}\n{text[own.end() :] if own else text}"
