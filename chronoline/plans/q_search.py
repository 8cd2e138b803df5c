"""Graph operators, searches, composed queries and quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoline.operators import fares, graph, journeys, tickets, timetable
from chronoline.plans import q_sources
from chronoline.plans.adapter import BANDS, Network
from chronoline.plans.registry import both, op

_KM = "2 * 6371.0 * asin(sqrt(power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2)))"


def _requests(n: Network, rows: list[tuple]):
    return n.spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "req long, source int, target int, start int, day int")


_REACH = """WITH RECURSIVE walks AS (SELECT a, b, walk FROM foot UNION ALL SELECT b, a, walk FROM foot),
    lab(station_id, arr, buffer) USING KEY (station_id) AS (SELECT 8, 0, 0 UNION SELECT station_id, arr, buffer FROM (
    SELECT x.station_id, min(x.arr) AS arr, 4 AS buffer FROM (SELECT c.arr_s AS station_id, c.arr_t AS arr FROM lab l JOIN conn c ON c.dep_s = l.station_id AND l.arr + l.buffer <= c.dep_t UNION ALL SELECT w.b, l.arr + w.walk FROM lab l JOIN walks w ON l.station_id = w.a) x GROUP BY x.station_id) y
    WHERE y.arr < coalesce((SELECT r.arr FROM recurring.lab r WHERE r.station_id = y.station_id), 999999)) SELECT station_id, arr FROM lab"""


@op("g01_reach_rounds", _REACH)
def reach_rounds(n: Network):
    return graph.reach_rounds(n.conn, n.foot, 8, 0)


@op("g01_scan")
def scan(n: Network):
    return graph.search(_requests(n, [(8, 55, 400, None), (3, 77, 600, 0), (20, 21, 30, None), (64, 2, 900, 2), (1, 99, 0, 1)]), n.conn, n.foot)


@op("g01_thousand_requests")
def thousand_requests(n: Network):
    """A thousand requests, answered 128 at a time."""
    i = F.col("id")
    asked = n.spark.range(0, 1000, 1, 8).select(i.alias("req"), (i % 100).cast("int").alias("source"), ((i * 37 + 11) % 100).cast("int").alias("target"), (i * 7 % 1200).cast("int").alias("start"), F.lit(None).cast("int").alias("day"))
    return graph.search(asked, n.conn, n.foot).select("req", "dep", "arr", "rides", "walks")


@op("g02_paths")
def paths(n: Network):
    found = graph.search(_requests(n, [(8, b, 300, None) for b in range(0, 100, 9)]), n.conn, n.foot)
    return found.select("req", F.posexplode(F.split("path", " ")).alias("leg", "step"))


@op(
    "g03_components",
    "WITH RECURSIVE both_ways AS (SELECT a, b FROM edge WHERE n >= 2 UNION SELECT b, a FROM edge WHERE n >= 2), r(node, seen) AS (SELECT DISTINCT a, a FROM both_ways UNION SELECT r.node, e.b FROM r JOIN both_ways e ON r.seen = e.a) SELECT node, min(seen) AS component FROM r GROUP BY node",
)
def components(n: Network):
    return graph.components(n.edge.where("n >= 2").select("a", "b"))


@op("g04_spanning_links")
def spanning_links(n: Network):
    return graph.spanning_links(n.edge)


both("g05_dense_index", "SELECT station_id, CAST(row_number() OVER (ORDER BY station_id) - 1 AS BIGINT) AS idx FROM {stn} WHERE station_id IN (SELECT a FROM {edge} WHERE n >= 2 UNION SELECT b FROM {edge} WHERE n >= 2)")
both("g06_thresholded_edges", "SELECT least(dep_s, arr_s) AS a, greatest(dep_s, arr_s) AS b, count(*) AS n, bool_or(type_id = 0) AS local FROM {conn} GROUP BY least(dep_s, arr_s), greatest(dep_s, arr_s) HAVING bool_or(type_id = 0) OR count(*) >= 3")


def _slow_graph(n: Network):
    e = n.conn.groupBy(F.least("dep_s", "arr_s").alias("a"), F.greatest("dep_s", "arr_s").alias("b")).agg(F.median(F.col("arr_t") - F.col("dep_t")).alias("minutes"), F.min("line").alias("line"))
    return e.orderBy("a", "b").toPandas()  # the station graph, not the timetable: a few thousand pairs


@op("g07_change_penalty")
def change_penalty(n: Network):
    return n.spark.createDataFrame(sorted((int(k), float(v)) for k, v in graph.dijkstra_with_changes(_slow_graph(n), 8).items()), "station_id int, minutes double")


@op("g08_alternatives")
def alternatives(n: Network):
    """Up to three routes a target; the fixture's graph is walked on the driver, a few thousand pairs."""
    edges = _slow_graph(n)
    out = [(t, k, r["minutes"], ",".join(map(str, r["path"])), ",".join(r["lines"])) for t in (21, 55, 90) for k, r in enumerate(graph.alternatives(edges, 8, t))]
    return n.spark.createDataFrame(out, "target int, place int, minutes double, path string, lines string")


both("g09_loop_trim", "SELECT s.trip_id, max(s.seq) AS start_seq FROM {st} s JOIN (SELECT trip_id, station_id FROM {st} WHERE seq = 1) o ON s.trip_id = o.trip_id AND s.station_id = o.station_id GROUP BY s.trip_id")
both("g10_merged_clusters", "SELECT base, min(station_id) AS canonical, count(*) AS n, round(avg(lat), 6) AS lat FROM (SELECT s.*, s.station_id % 50 AS base FROM {stn} s) x GROUP BY base")
both("g11_direction_clusters", "SELECT station_id, nxt, count(*) AS n, CAST(sum(ahead) AS BIGINT) AS downstream FROM (SELECT station_id, lead(station_id) OVER (PARTITION BY trip_id ORDER BY seq) AS nxt, count(*) OVER (PARTITION BY trip_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING) AS ahead FROM {st}) x WHERE nxt IS NOT NULL GROUP BY station_id, nxt")
both("g12_termini", "SELECT line, s, count(DISTINCT o) AS neighbours FROM (SELECT line, dep_s AS s, arr_s AS o FROM {conn} WHERE cal = 2 UNION ALL SELECT line, arr_s, dep_s FROM {conn} WHERE cal = 2) x GROUP BY line, s HAVING count(DISTINCT o) <= 1")
both("g13_through_pairs", "SELECT DISTINCT least(a.line, b.line) AS a, greatest(a.line, b.line) AS b FROM {trip} a JOIN {trip} b ON a.trip_id = b.trip_id + 100 AND a.line <> b.line")


@op("g14_gap_probe")
def gap_probe(n: Network):
    one_way = n.conn.select(F.col("arr_s").alias("source"), F.col("dep_s").alias("target")).distinct().join(n.conn.select(F.col("dep_s").alias("source"), F.col("arr_s").alias("target")).distinct(), ["source", "target"], "left_anti")
    req = F.shiftleft(F.col("source").cast("long"), 32).bitwiseOR(F.col("target").cast("long"))  # one number a pair, without a global order
    asked = one_way.select(req.alias("req"), "source", "target", F.lit(0).alias("start"), F.lit(None).cast("int").alias("day"))
    return graph.search(asked.repartition(4 * n.spark.sparkContext.defaultParallelism, "req"), n.conn, n.foot).select("req", "dep", "arr")


both("g15_orphans", "SELECT s.station_id FROM {stn} s WHERE NOT EXISTS (SELECT 1 FROM (SELECT dep_s AS x FROM {conn} WHERE line = 'signup' AND cal = 2 UNION SELECT arr_s FROM {conn} WHERE line = 'signup' AND cal = 2) c WHERE c.x = s.station_id)")


# -- composed searches ---------------------------------------------------------------------
def _profile(n: Network, source: int, target: int, starts: range):
    return graph.search(_requests(n, [(source, target, s, None) for s in starts]), n.conn, n.foot).select("dep", "arr", "rides", "path").distinct()


def _fare(j: journeys.Journey) -> tuple[int, int]:
    """The fixture's fare: by minutes on board; a third less without a reserved seat."""
    total = 150 + 10 * sum((x[5] - x[3]) // 30 for x in j.rides)
    return total, total * 2 // 3


def _plan(n: Network, asked: list[tuple]):
    requests = n.spark.createDataFrame([(i, *r) for i, r in enumerate(asked)], "req long, what string, source int, target int, at int, options string")
    cls = F.when((F.col("line") == "purchase") & (F.col("type_id") == 2), "paid").when((F.col("line") == "signup") & (F.col("type_id") == 1), "shinkansen")
    trips = n.trip.join(n.company, "line").select("trip_id", "line", cls.alias("cls"), F.col("company").alias("operator"))
    return journeys.plan(requests, n.conn, n.foot, trips, _fare)


op("q01_journeys")(lambda n: _plan(n, [("find", 8, 55, 400, None), ("find", 8, 55, 400, '{"budget": 200}'), ("find", 3, 77, 500, '{"no_bus": true}'), ("find", 21, 90, 300, '{"operators": ["Metro"], "express": false}')]))
op("q02_next_journey")(lambda n: _plan(n, [("next", 8, 55, 500, None), ("next", 3, 77, 700, '{"day": 0}')]))
op("q03_previous_journey")(lambda n: _plan(n, [("previous", 8, 55, 500, None), ("previous", 3, 77, 700, None)]))
op("q04_first_and_last")(lambda n: _plan(n, [("first", 8, 55, 0, None), ("last", 8, 55, 0, None), ("last", 3, 77, 0, '{"bus_only": true}')]))
op("q05_latest_departure")(lambda n: _plan(n, [("latest", 8, 55, 1200, None), ("latest", 3, 77, 900, None)]))


@op("q07_budget", "SELECT trip_id, fare IS NULL AS unknown, coalesce(least_fare > 400, false) AS over, CAST(CASE WHEN coalesce(least_fare > 400, false) THEN least_fare - 400 ELSE 0 END AS BIGINT) AS over_by, CASE WHEN fare > 400 AND least_fare <= 400 THEN 'nonreserved' END AS seat_hint FROM (SELECT trip_id, CASE WHEN company = 'Coast' THEN NULL ELSE hops * 180 END AS fare, CASE WHEN company = 'Coast' THEN NULL ELSE hops * 150 END AS least_fare FROM leg) x")
def budget(n: Network):
    known = F.col("company") != "Coast"
    j = n.leg.select("trip_id", F.when(known, F.col("hops") * 180).alias("fare"), F.when(known, F.col("hops") * 150).alias("min_fare"))
    return fares.with_budget(j, F.lit(400)).select("trip_id", "unknown", "over", F.col("over_by").cast("long").alias("over_by"), "seat_hint")


@op("q08_budget_filter", "SELECT trip_id FROM (SELECT trip_id, hops * 150 > 500 AS over, count_if(hops * 150 <= 500) OVER (PARTITION BY line) > 0 AS any_within FROM leg) x WHERE NOT any_within OR NOT over")
def budget_filter(n: Network):
    j = n.leg.select("trip_id", "line", (F.col("hops") * 150 > 500).alias("over"), F.lit(False).alias("unknown"))
    return fares.within_budget_or_cheapest(j, "line").select("trip_id")


@op("q09_score", "SELECT trip_id, CAST(round(arr + 4 * hops + least((hops * 180 - 180) / 40.0, 120), 6) AS DOUBLE) AS score FROM leg")
def score(n: Network):
    fare = F.col("hops") * 180
    return n.leg.select("trip_id", F.round(fares.score(F.col("arr"), F.col("hops"), fare, F.lit(180), F.lit(False)).cast("double"), 6).alias("score"))


both("q10_name_candidates", "SELECT q, station_id FROM (SELECT q.q, s.station_id, CASE WHEN s.name = q.q AND s.mode = 0 THEN 0 WHEN s.name LIKE q.q || '%' AND s.mode = 0 THEN 1 WHEN s.name = q.q THEN 2 ELSE 3 END AS p, min(CASE WHEN s.name = q.q AND s.mode = 0 THEN 0 WHEN s.name LIKE q.q || '%' AND s.mode = 0 THEN 1 WHEN s.name = q.q THEN 2 ELSE 3 END) OVER (PARTITION BY q.q) AS best FROM (VALUES ('S1'), ('S7'), ('S75'), ('S9')) AS q(q) JOIN {stn} s ON s.name LIKE q.q || '%') x WHERE p = best")


@op("q11_cross_candidates")
def cross_candidates(n: Network):
    found = graph.search(_requests(n, [(a, b, 480, None) for a in (8, 18, 28) for b in (55, 65)]), n.conn, n.foot)
    return found.select("dep", "arr", "rides", "path").distinct().orderBy("arr", F.desc("dep"), "rides")


@op("q12_best_as_json")
def best_as_json(n: Network):
    best = _profile(n, 8, 55, range(480, 500, 5)).agg(F.min(F.struct("arr", "rides", "dep", "path")).alias("x")).select("x.*")
    return best.select(F.to_json(F.struct("dep", "arr", (F.col("arr") - F.col("dep")).alias("minutes"), (F.col("rides") - 1).alias("transfers"), "path")).alias("json"))


# All stops; without a later departure, half the station's headway (as in q15) after the walk.
both(
    "q13_assigned_times",
    "WITH d AS (SELECT s, m, asked, min(dep) OVER (PARTITION BY s ORDER BY m RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS board FROM (SELECT DISTINCT dep_s AS s, dep_t AS m, dep_t AS dep, 0 AS asked FROM {conn} UNION ALL SELECT DISTINCT station_id, t + 3, CAST(NULL AS INT), 1 FROM {st}) x), h AS (SELECT dep_s, CASE WHEN count(*) >= 2 THEN (max(dep_t) - min(dep_t)) * 1.0E0 / (count(*) - 1) ELSE 15.0E0 END AS headway FROM {conn} WHERE dep_t BETWEEN 600 AND 960 GROUP BY dep_s) SELECT t.trip_id, t.seq, coalesce(d.board, t.t + 3 + CAST(floor(coalesce(h.headway, 15.0E0) / 2 + 0.5E0) AS INT)) AS board, CAST(d.board IS NOT NULL AS BOOLEAN) AS from_timetable FROM {st} t JOIN d ON d.s = t.station_id AND d.m = t.t + 3 AND d.asked = 1 LEFT JOIN h ON h.dep_s = t.station_id",
)
both("q14_next_departure", "SELECT dep_s, line, min(dep_t) AS next_dep FROM {conn} WHERE dep_t >= 700 GROUP BY dep_s, line")
both("q15_headway", "SELECT dep_s, CASE WHEN count(*) >= 2 THEN round((max(dep_t) - min(dep_t)) * 1.0E0 / (count(*) - 1), 6) ELSE 15.0E0 END AS headway FROM {conn} WHERE dep_t BETWEEN 600 AND 960 GROUP BY dep_s")
@op(
    "q16_company_runs",
    """SELECT user_id, company, island, CAST(CASE WHEN company = 'other' THEN floor(km * 25 + 0.5) ELSE coalesce((SELECT min_by(b.yen, b.ord) FROM band b WHERE b.company = x.company AND ceil(x.km) <= b.max_km), (SELECT max_by(b.yen, b.ord) FROM band b WHERE b.company = x.company)) END AS INT) AS fare
    FROM (SELECT user_id, company, CAST(island AS BIGINT) AS island, round(sum(value) / 100, 6) AS km FROM (SELECT *, sum(CASE WHEN company = prev THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts) AS island FROM (SELECT *, lag(company) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM (SELECT e.user_id, e.ts, e.value, CASE WHEN k.company = 'Coast' OR k.company IS NULL THEN 'other' ELSE k.company END AS company FROM ev e LEFT JOIN company k ON e.event_type = k.line) v) w) y GROUP BY user_id, company, island) x""",
)
def company_runs(n: Network):
    """Fares of runs of one company along a user's events; companies without bands pay by the kilometre."""
    known = F.when((F.col("company") == "Coast") | F.col("company").isNull(), "other").otherwise(F.col("company"))
    rows = n.ev.join(n.company.withColumnRenamed("line", "event_type"), "event_type", "left").withColumn("company", known)
    runs = timetable.islands(rows, ["user_id"], "ts", F.col("company")).groupBy("user_id", "company", "island").agg(F.round(F.sum("value") / 100, 6).alias("km"))
    tariff = tickets.Tariff(bands={c: [(km, yen) for name, _, km, yen in sorted(BANDS) if name == c] for c in {b[0] for b in BANDS}})
    return runs.select("user_id", "company", "island", tickets.ticket(tariff, F.col("company"), F.col("km")).cast("int").alias("fare"))


@op("q17_day_comparison")
def day_comparison(n: Network):
    asked = _requests(n, [(8, b, 420, d) for b in (3, 21, 55, 90) for d in (0, 1, 2)])
    found = graph.search(asked, n.conn, n.foot)
    return asked.join(found, "req", "left").groupBy("source", "target").pivot("day", [0, 1, 2]).agg(F.min("arr")).withColumnsRenamed({"0": "weekday", "1": "saturday", "2": "holiday"})


@op("q18_batch_status")
def batch_status(n: Network):
    asked = _requests(n, [(8, 55, 420, None), (8, 1000, 420, None), (3, 4, 1430, None), (21, 90, 600, 0)])
    known = n.stn.select(F.col("station_id").alias("target"), F.lit(True).alias("known"))
    found = graph.search(asked, n.conn, n.foot)
    status = F.when(F.col("known").isNull(), "NO_STATION").when(F.col("arr").isNull(), "NO_ROUTE").when(F.col("arr") - F.col("dep") > 720, "RANGE").otherwise("OK")
    return asked.join(known, "target", "left").join(found, "req", "left").select("req", status.alias("status"))




# -- quality checks ------------------------------------------------------------------------
both("m01_missing_pages", "SELECT DISTINCT station_id FROM {stn} WHERE station_id NOT IN (SELECT dep_s FROM {conn} WHERE mode = 1 AND cal = 2) AND station_id NOT IN (SELECT arr_s FROM {conn} WHERE mode = 1 AND cal = 2)")
both("m02_reverse_collection", "SELECT DISTINCT c.arr_s AS station, c.line FROM {conn} c WHERE NOT EXISTS (SELECT 1 FROM {conn} d WHERE d.dep_s = c.arr_s AND d.line = c.line AND d.cal = 2)")
both("m03_fetch_status", "SELECT event_id, CASE WHEN event_type = 'error' AND station_id % 4 = 0 THEN 'final' WHEN event_type = 'error' THEN 'retry' ELSE 'done' END AS status FROM {ev}")
both("m08_neighbour_outliers", f"SELECT e.a, round(min({_KM}), 6) AS km FROM (SELECT a, b FROM {{edge}} UNION ALL SELECT b, a FROM {{edge}}) e JOIN {{stn}} a ON e.a = a.station_id JOIN {{stn}} b ON e.b = b.station_id GROUP BY e.a HAVING min({_KM}) > 0.36")
both("m09_prefecture_outliers", f"SELECT a.station_id, round({_KM}, 6) AS km FROM {{stn}} a JOIN (SELECT pref, avg(lat) AS lat, avg(lon) AS lon FROM {{stn}} GROUP BY pref) b ON a.pref = b.pref WHERE {_KM} > 2")
both("m10_footpath_wormholes", f"WITH d AS (SELECT e.a, min({_KM}) AS km FROM (SELECT a, b FROM {{edge}} UNION ALL SELECT b, a FROM {{edge}}) e JOIN {{stn}} a ON e.a = a.station_id JOIN {{stn}} b ON e.b = b.station_id GROUP BY e.a) SELECT f.a, f.b, round(least(x.km, y.km), 6) AS km FROM {{foot}} f JOIN d x ON f.a = x.a JOIN d y ON f.b = y.a WHERE least(x.km, y.km) > 0.3")
both("m11_footpath_audit", f"SELECT f.a, f.b, CAST(abs(f.walk - (floor({_KM} * 15 + 0.5) + 3)) > 0 AS BOOLEAN) AS odd FROM {{foot}} f JOIN {{stn}} a ON f.a = a.station_id JOIN {{stn}} b ON f.b = b.station_id")
both("m12_same_name_far", f"SELECT a.station_id AS a, b.station_id AS b, round({_KM}, 6) AS km FROM {{stn}} a JOIN {{stn}} b ON a.station_id % 30 = b.station_id % 30 AND a.station_id < b.station_id WHERE {_KM} >= 2")
both("m13_name_variants", "SELECT lower(p_brand) AS norm, count(DISTINCT p_brand) AS variants, count(*) AS n FROM {part} GROUP BY lower(p_brand)")
both("m14_missing_attributes", "SELECT mode, count_if(lat IS NULL) AS no_lat, count_if(pref = 0) AS no_pref, count(*) AS n FROM {stn} GROUP BY mode")
both("m15_operator_probe", "SELECT k.company, bool_or(c.trip_id IS NOT NULL) AS present FROM {company} k LEFT JOIN {conn} c ON c.line = k.line AND c.mode = 1 GROUP BY k.company")
both("m16_line_coverage", "SELECT line, count(DISTINCT s) AS stations, min(t) AS first_t, max(t) AS last_t FROM (SELECT line, dep_s AS s, dep_t AS t FROM {conn} UNION ALL SELECT line, arr_s, arr_t FROM {conn}) x GROUP BY line")
both("m17_thin_stations", "SELECT s.station_id, CASE WHEN d.n IS NULL THEN 'no_departures' WHEN d.n < 40 THEN 'thin' WHEN d.first_dep >= 540 THEN 'late_start' WHEN d.last_dep <= 1020 THEN 'early_end' ELSE 'ok' END AS flag FROM {stn} s LEFT JOIN (SELECT dep_s, count(*) AS n, min(dep_t) AS first_dep, max(dep_t) AS last_dep FROM {conn} GROUP BY dep_s) d ON s.station_id = d.dep_s")
both("m18_one_way_ratchet", "SELECT DISTINCT c.dep_s, c.arr_s FROM {conn} c WHERE NOT EXISTS (SELECT 1 FROM {conn} d WHERE d.dep_s = c.arr_s AND d.arr_s = c.dep_s) AND NOT EXISTS (SELECT 1 FROM (VALUES (1, 2), (3, 4)) AS a(x, y) WHERE a.x = c.dep_s AND a.y = c.arr_s)")
both("m19_unresolved_companies", "SELECT e.event_type, count(*) AS n FROM {ev} e LEFT JOIN (SELECT * FROM {company} WHERE line <> 'error') k ON e.event_type = k.line WHERE k.line IS NULL GROUP BY e.event_type")


@op("m21_platform_coverage")
def platform_coverage(n: Network):
    found = graph.search(_requests(n, [(8, b, 420, None) for b in (3, 21, 55, 90)]), n.conn, n.foot)
    tracks = n.stn.where("station_id % 3 = 0").select(F.col("station_id").cast("string").alias("s"))
    legs = found.select(F.explode(F.split("path", " ")).alias("step")).where("step not like 'w:%'").select(F.regexp_extract("step", "^[0-9]+:([0-9]+)@", 1).alias("s"))
    return legs.join(tracks.withColumn("hit", F.lit(1)), "s", "left").agg(F.count("*").alias("legs"), F.count("hit").alias("with_track"))


both("m22_presence", "SELECT q.id, bool_or(s.station_id IS NOT NULL) AS present FROM (VALUES (5), (42), (99), (100)) AS q(id) LEFT JOIN {stn} s ON s.station_id = q.id GROUP BY q.id")


@op(
    "m24_component_sizes",
    "WITH RECURSIVE both_ways AS (SELECT a, b FROM edge WHERE n >= 2 UNION SELECT b, a FROM edge WHERE n >= 2), r(node, seen) AS (SELECT DISTINCT a, a FROM both_ways UNION SELECT r.node, e.b FROM r JOIN both_ways e ON r.seen = e.a) SELECT component, count(*) AS n FROM (SELECT node, min(seen) AS component FROM r GROUP BY node) x GROUP BY component",
)
def component_sizes(n: Network):
    return graph.components(n.edge.where("n >= 2").select("a", "b")).groupBy("component").agg(F.count("*").alias("n"))


both("m25_board_merge", "SELECT o.dep_s, o.line, CASE WHEN count(DISTINCT d.arr_s) = 1 THEN 'merged' WHEN count(DISTINCT d.arr_s) = 0 THEN 'skipped' ELSE 'adopted' END AS verdict FROM (SELECT DISTINCT dep_s, line FROM {conn} WHERE mode = 1) o LEFT JOIN {conn} d ON d.dep_s = o.dep_s AND d.line = o.line AND d.mode = 0 AND d.type_id = 1 GROUP BY o.dep_s, o.line")
both("m26_board_label", "SELECT dep_s, arr_s AS top, CAST(n * 2 < total AS BOOLEAN) AS needs_second FROM (SELECT dep_s, arr_s, n, sum(n) OVER (PARTITION BY dep_s) AS total, row_number() OVER (PARTITION BY dep_s ORDER BY n DESC, arr_s) AS r FROM (SELECT dep_s, arr_s, count(*) AS n FROM {conn} GROUP BY dep_s, arr_s) x) y WHERE r = 1")


@op("m27_readings", "SELECT kana, romaji FROM (VALUES ('シンジュク', 'shinjuku'), ('おおさか', 'osaka'), ('きょうと', 'kyoto'), ('ホッカイドウ', 'hokkaido'), ('じゅんじ', 'junji')) AS t(kana, romaji)")
def readings(n: Network):
    from chronoline.functions import kana

    return n.spark.createDataFrame([("シンジュク",), ("おおさか",), ("きょうと",), ("ホッカイドウ",), ("じゅんじ",)], "kana string").select("kana", kana.hepburn("kana").alias("romaji"))



@op("m28_round_trip", "SELECT a.trip_id, CAST(a.sig = b.sig AS BOOLEAN) AS same FROM (SELECT trip_id, @list(station_id; seq)@ AS sig FROM {st} GROUP BY trip_id) a FULL OUTER JOIN (SELECT trip_id, @list(station_id; t, seq)@ AS sig FROM {st} GROUP BY trip_id) b ON a.trip_id = b.trip_id")
def round_trip(n: Network):
    return q_sources.round_trip(q_sources.times(n), q_sources.unpacked_stops(n))


both("m29_external_buckets", "SELECT CASE WHEN abs(fare - other) = 0 THEN 'exact' WHEN abs(fare - other) <= 110 THEN 'near' WHEN abs(fare - other) <= 500 THEN 'far' ELSE 'off' END AS bucket, count(*) AS n, count_if(abs(took - hops * 60) <= 10) AS on_time FROM (SELECT hops * 180 AS fare, hops * 150 + 30 AS other, arr - dep AS took, hops FROM {leg}) x GROUP BY 1")
both(
    "m30_leg_existence",
    "SELECT trip_id, seq, CAST(near > mine AS BOOLEAN) AS found FROM (SELECT trip_id, seq, count(*) OVER (PARTITION BY dep_s, arr_s ORDER BY dep_t RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near, count(*) OVER (PARTITION BY dep_s, arr_s, trip_id ORDER BY dep_t RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS mine, count(*) OVER (PARTITION BY dep_s, arr_s) AS n, count(*) OVER (PARTITION BY dep_s, arr_s, trip_id) AS own FROM {conn}) x WHERE n > own",
    "SELECT a.trip_id, a.seq, bool_or(abs(a.dep_t - b.dep_t) <= 2) AS found FROM conn a JOIN conn b ON a.dep_s = b.dep_s AND a.arr_s = b.arr_s AND a.trip_id <> b.trip_id GROUP BY a.trip_id, a.seq",
)
both("m32_rounded_key_join", "SELECT a.station_id, b.station_id AS other FROM {stn} a JOIN {stn} b ON round(a.lat, 2) = round(b.lat, 2) AND round(a.lon, 2) = round(b.lon, 2) AND a.station_id < b.station_id")
both("ui_suggest", "SELECT q.q, s.station_id, CAST(row_number() OVER (PARTITION BY q.q ORDER BY s.mode, s.name = q.q DESC, length(s.name), s.station_id) AS BIGINT) AS place FROM (VALUES ('S1'), ('S7')) AS q(q) JOIN {stn} s ON startswith(s.name, q.q)", "SELECT q.q, s.station_id, CAST(row_number() OVER (PARTITION BY q.q ORDER BY s.mode, s.name = q.q DESC, length(s.name), s.station_id) AS BIGINT) AS place FROM (VALUES ('S1'), ('S7')) AS q(q) JOIN stn s ON starts_with(s.name, q.q)")


@op("ui_parse_budget", "SELECT text, lim FROM (VALUES ('1500', 1500.0::DOUBLE), ('0', NULL), ('', NULL), ('abc', NULL), ('-3', NULL)) AS t(text, lim)")
def parse_budget(n: Network):
    t = n.spark.createDataFrame([("1500",), ("0",), ("",), ("abc",), ("-3",)], "text string")
    return t.select("text", fares.budget_limit(F.col("text")).alias("lim"))


both("ui_overnight_hint", "SELECT trip_id, CAST(km * 1000 >= 1200 AS BOOLEAN) AS overnight FROM {leg}")
