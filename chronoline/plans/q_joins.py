"""Joins, lookups, fares and platforms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoline.functions import scalars
from chronoline.operators import fares, platforms, spatial
from chronoline.plans.adapter import Network
from chronoline.plans.registry import both, op

_KM = "2 * 6371.0 * asin(sqrt(power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2)))"

# Transfers to every later departure: arrivals by the minute from which they can board, six minutes after them if either is a bus and four
# otherwise, with the departures from that minute on, less those of the arriving trip itself.
both(
    "j02_transfer_join",
    "WITH e AS (SELECT arr_s AS s, d.m AS kind, arr_t + CASE WHEN mode = 1 OR d.m = 1 THEN 6 ELSE 4 END AS t, 1 AS arrs, 0 AS deps FROM {conn} CROSS JOIN (VALUES (0), (1)) AS d(m) UNION ALL SELECT dep_s, mode, dep_t, 0, 1 FROM {conn}), m AS (SELECT s, kind, t, sum(arrs) AS arrs, sum(deps) AS deps FROM e GROUP BY s, kind, t), p AS (SELECT s, arrs * sum(deps) OVER (PARTITION BY s, kind ORDER BY t DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM m UNION ALL SELECT a.arr_s, -1 FROM {conn} a JOIN {conn} b ON a.arr_s = b.dep_s AND a.trip_id = b.trip_id AND a.arr_t + CASE WHEN a.mode = 1 OR b.mode = 1 THEN 6 ELSE 4 END <= b.dep_t) SELECT s AS station, CAST(sum(n) AS BIGINT) AS transfers FROM p GROUP BY s HAVING sum(n) > 0",
    "SELECT a.arr_s AS station, count(*) AS transfers FROM conn a JOIN conn b ON a.arr_s = b.dep_s AND a.trip_id <> b.trip_id AND a.arr_t + CASE WHEN a.mode = 1 OR b.mode = 1 THEN 6 ELSE 4 END <= b.dep_t GROUP BY a.arr_s",
)
both("j03_trip_attributes", "SELECT c.trip_id, c.seq, t.cal, k.company FROM {conn} c JOIN {trip} t ON c.trip_id = t.trip_id JOIN {company} k ON t.line = k.line")

both("j04_footpath_expansion", "SELECT c.trip_id, c.seq, f.b AS station, CAST(c.arr_t + f.walk AS INT) AS at FROM {conn} c JOIN (SELECT a, b, walk FROM {foot} UNION ALL SELECT b, a, walk FROM {foot}) f ON c.arr_s = f.a")

@op("j05_near_pairs", f"SELECT a.station_id AS a, b.station_id AS b, round({_KM}, 6) AS km FROM stn a JOIN stn b ON a.station_id < b.station_id WHERE {_KM} <= 0.4")
def near_pairs(n: Network):
    return spatial.within(n.stn).select("a", "b", F.round("km", 6).alias("km"))


@op("j06_same_base_name", f"WITH s AS (SELECT *, station_id % 10 + 10 * (station_id // 20) AS base, count(*) OVER (PARTITION BY station_id % 10 + 10 * (station_id // 20)) AS n FROM stn) SELECT a.station_id AS a, b.station_id AS b, round({_KM}, 6) AS km FROM s a JOIN s b ON a.base = b.base AND a.station_id < b.station_id WHERE a.n BETWEEN 2 AND 8 AND {_KM} <= 1.2")
def same_base_name(n: Network):
    return spatial.same_name_walks(n.stn.withColumn("base", F.col("station_id") % 10 + 10 * F.floor(F.col("station_id") / 20)), "base").select("a", "b", F.round("km", 6).alias("km"))


both("j07_bus_to_rail", f"SELECT a.station_id AS a, b.station_id AS b, round({_KM}, 6) AS km FROM {{stn}} a JOIN {{stn}} b ON a.mode = 1 AND b.mode = 0 AND a.station_id % 10 = b.station_id % 10 WHERE {_KM} <= 0.6")
both("j08_least_walk", "SELECT a, b, min(walk) AS walk FROM (SELECT a, b, walk FROM {foot} UNION ALL SELECT a, b, walk + 1 FROM {foot} UNION ALL SELECT b, a, walk FROM {foot}) x GROUP BY a, b")
both("j09_as_of_next", "SELECT s.station_id, q.since, min(c.dep_t) AS next_dep FROM {stn} s CROSS JOIN (VALUES (480), (720), (1200)) AS q(since) LEFT JOIN {conn} c ON c.dep_s = s.station_id AND c.dep_t >= q.since GROUP BY s.station_id, q.since")
# The user's latest earlier event, however far back.
both("j09_as_of_last", "SELECT event_id, before FROM (SELECT event_id, last_value(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM {ev}) x WHERE place > 1")

_BAND = "coalesce((SELECT min_by(b.yen, b.ord) FROM band b WHERE b.company = l.company AND ceil(l.km) <= b.max_km), (SELECT max_by(b.yen, b.ord) FROM band b WHERE b.company = l.company))"


@op("j10_band_fare", f"SELECT l.trip_id, l.company, {_BAND} AS fare FROM leg l")
def band_fare(n: Network):
    return fares.band_fare(n.leg, n.band, F.col("km"), ["company"]).select("trip_id", "company", "fare")


_RULES = [("match", "京成スカイアクセス", "京成SA"), ("prefix", "京成", "京成"), ("prefix", "京", "京の会社"), ("match", "東西線", "東京メトロ"), ("prefix", "都営", "都営地下鉄")]
_LINES = ["京成スカイアクセス", "京成本線", "京急線", "東西線", "東西", "都営浅草線", "名鉄"]
_VALUES = "(VALUES " + ", ".join(f"('{x}')" for x in _LINES) + ") AS s(line)"
_RULE_VALUES = "(VALUES " + ", ".join(f"('{k}', '{t}', '{c}')" for k, t, c in _RULES) + ") AS r(kind, text, company)"


@op("j11_longest_prefix", f"SELECT line, coalesce((SELECT r.company FROM {_RULE_VALUES} WHERE (r.kind = 'match' AND r.text = s.line) OR (r.kind = 'prefix' AND starts_with(s.line, r.text)) ORDER BY r.kind = 'match' DESC, length(r.text) DESC LIMIT 1), '') AS company FROM {_VALUES}")
def longest_prefix(n: Network):
    lines = n.spark.createDataFrame([(x,) for x in _LINES], "line string")
    return fares.longest_prefix(lines, n.spark.createDataFrame(_RULES, "kind string, text string, company string"), "line")


@op("j12_first_substring", f"SELECT line, CASE WHEN line LIKE '%スカイ%' THEN 'sky' WHEN line LIKE '%線%' THEN 'line' END AS hit FROM {_VALUES}")
def first_substring(n: Network):
    lines = n.spark.createDataFrame([(x,) for x in _LINES], "line string")
    return lines.select("line", fares.first_substring(F.col("line"), [("スカイ", "sky"), ("線", "line")]).alias("hit"))


@op("j13_special_pair", "SELECT c.trip_id, c.seq, s.yen AS special FROM conn c LEFT JOIN (VALUES (3, 40, 120), (77, 5, 90), (12, 13, 60)) AS s(a, b, yen) ON (c.dep_s = s.a AND c.arr_s = s.b) OR (c.dep_s = s.b AND c.arr_s = s.a)")
def special_pair(n: Network):
    table = n.spark.createDataFrame([(3, 40, 120), (77, 5, 90), (12, 13, 60)], "a int, b int, yen int")
    return fares.special_pair(n.conn, table, "dep_s", "arr_s").select("trip_id", "seq", "special")


_ANCHORS = [("North", 1, 35.036, 139.018), ("South", 2, 35.0, 139.018), ("East", 3, 35.018, 139.036), ("West", 4, 35.018, 139.0)]


@op("j14_nearest_anchor", f"SELECT s.station_id, (SELECT a.name FROM (VALUES {', '.join(map(str, _ANCHORS))}) AS a(name, ord, lat, lon) ORDER BY round(power(s.lat - a.lat, 2) + power((s.lon - a.lon) * 0.82, 2), 12), a.ord LIMIT 1) AS name FROM stn s")
def nearest_anchor(n: Network):
    return spatial.nearest(n.stn, n.spark.createDataFrame(_ANCHORS, "name string, ord int, lat double, lon double"), "station_id", "name")


both(
    "j15_candidates",
    "SELECT q, station_id FROM (SELECT q.q, s.station_id, row_number() OVER (PARTITION BY q.q ORDER BY CASE WHEN s.station_id = q.q THEN 0 WHEN s.station_id % 20 = q.q % 20 THEN 1 ELSE 2 END, abs(s.pref - q.q % 7), s.station_id) AS r FROM (VALUES (3), (25), (120), (341)) AS q(q) JOIN {stn} s ON s.station_id = q.q OR s.station_id % 20 = q.q % 20 OR s.pref = q.q % 7) x WHERE r = 1",
)
both("j16_fill_missing", "SELECT s.station_id, coalesce(CASE WHEN s.station_id % 9 <> 0 THEN s.lat END, k.lat) AS lat FROM {stn} s LEFT JOIN (SELECT pref, min(lat) AS lat FROM {stn} GROUP BY pref) k ON s.pref = k.pref")
both("j17_overwrite_far", f"SELECT a.station_id, CASE WHEN {_KM} > 2 THEN round(b.lat, 6) ELSE a.lat END AS lat FROM {{stn}} a JOIN (SELECT pref, avg(lat) AS lat, avg(lon) AS lon FROM {{stn}} GROUP BY pref) b ON a.pref = b.pref")


def _fills(passes: int = 5) -> str:
    """DuckDB's version of the passes: each is one more table that reads the one before."""
    steps = ["ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge)", "p0 AS (SELECT station_id, CASE WHEN station_id % 3 <> 1 THEN lat END AS lat, CASE WHEN station_id % 3 <> 1 THEN lon END AS lon, 0 AS filled FROM stn)"]
    for k in range(1, passes + 1):
        mean = f"SELECT w.a AS id, round(avg(q.lat), 6) AS mla, round(avg(q.lon), 6) AS mlo FROM ways w JOIN p{k - 1} q ON q.station_id = w.b AND q.lat IS NOT NULL GROUP BY w.a"
        steps.append(f"p{k} AS (SELECT p.station_id, coalesce(p.lat, m.mla) AS lat, coalesce(p.lon, m.mlo) AS lon, CASE WHEN p.lat IS NULL AND m.mla IS NOT NULL THEN {k} ELSE p.filled END AS filled FROM p{k - 1} p LEFT JOIN ({mean}) m ON m.id = p.station_id)")
    return "WITH " + ", ".join(steps) + f" SELECT station_id, round(lat, 4) AS lat, round(lon, 4) AS lon, filled FROM p{passes}"


@op("j18_anchored_fill", _fills())
def anchored_fill(n: Network):
    from chronoline.operators import geocode

    holes = n.stn.withColumn("lat", F.when(F.col("station_id") % 3 != 1, F.col("lat"))).withColumn("lon", F.when(F.col("station_id") % 3 != 1, F.col("lon")))
    found = geocode.fill_from_neighbours(holes, n.edge.select("a", "b"))
    return found.select("station_id", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"), "filled")


both("j19_manual_patch", "SELECT s.station_id, coalesce(p.lat, s.lat) AS lat, CAST(p.lat IS NOT NULL AND abs(p.lat - s.lat) <= 0.07 AS BOOLEAN) AS patched FROM {stn} s LEFT JOIN (VALUES (3, 35.01), (50, 35.9)) AS p(id, lat) ON s.station_id = p.id")
both("j20_nearest_same_name", "SELECT station_id, other FROM (SELECT a.station_id, b.station_id AS other, row_number() OVER (PARTITION BY a.station_id ORDER BY round(power(a.lat - b.lat, 2) + power((a.lon - b.lon) * 0.82, 2), 12), b.station_id) AS r FROM {stn} a JOIN {stn} b ON a.station_id % 13 = b.station_id % 13 AND a.station_id <> b.station_id AND power(a.lat - b.lat, 2) + power((a.lon - b.lon) * 0.82, 2) < 0.0025) x WHERE r = 1")
both("j22_line_anti", "SELECT DISTINCT c.dep_s, c.line FROM {conn} c LEFT JOIN (SELECT DISTINCT arr_s, line FROM {conn} WHERE cal = 2) d ON c.dep_s = d.arr_s AND c.line = d.line WHERE d.arr_s IS NULL")
both("j23_one_way", "SELECT DISTINCT c.dep_s, c.arr_s FROM {conn} c WHERE NOT EXISTS (SELECT 1 FROM {conn} d WHERE d.dep_s = c.arr_s AND d.arr_s = c.dep_s)")
both("j24_new_trips", "SELECT t.trip_id FROM {trip} t LEFT JOIN (SELECT trip_id FROM {trip} WHERE trip_id % 3 = 0) k ON t.trip_id = k.trip_id WHERE k.trip_id IS NULL")
both("j25_edge_line", "SELECT e.a, e.b, coalesce(min(CASE WHEN c.line = 'view' THEN c.line END), min(c.line)) AS line FROM {edge} e JOIN {conn} c ON e.a = least(c.dep_s, c.arr_s) AND e.b = greatest(c.dep_s, c.arr_s) GROUP BY e.a, e.b")
both("j27_neighbours", f"SELECT e.a, e.b, round({_KM}, 6) AS km FROM {{edge}} e JOIN {{stn}} a ON e.a = a.station_id JOIN {{stn}} b ON e.b = b.station_id")
both("j28_same_name", "SELECT station_id % 10 AS base, @list(station_id; station_id)@ AS ids FROM {stn} GROUP BY station_id % 10")

# -- fares ---------------------------------------------------------------------------------


@op(
    "d01_journey_fare",
    f"""SELECT trip_id, CAST(fare + coalesce(special, 0) + CASE WHEN o = 7 OR d = 7 THEN 140 ELSE 0 END AS BIGINT) AS total FROM (SELECT l.trip_id, {_BAND} AS fare, s.yen AS special, e.o, e.d FROM leg l JOIN (SELECT trip_id, min_by(station_id, seq) AS o, max_by(station_id, seq) AS d FROM st GROUP BY trip_id) e ON l.trip_id = e.trip_id LEFT JOIN (VALUES (3, 40, 120), (77, 5, 90)) AS s(a, b, yen) ON least(e.o, e.d) = least(s.a, s.b) AND greatest(e.o, e.d) = greatest(s.a, s.b)) x""",
)
def journey_fare(n: Network):
    ends = n.st.groupBy("trip_id").agg(F.min_by("station_id", "seq").alias("o"), F.max_by("station_id", "seq").alias("d"))
    special = n.spark.createDataFrame([(3, 40, 120), (77, 5, 90)], "a int, b int, yen int")
    priced = fares.special_pair(fares.band_fare(n.leg, n.band, F.col("km"), ["company"]).join(ends, "trip_id"), special, "o", "d")
    surcharge = F.when((F.col("o") == 7) | (F.col("d") == 7), 140).otherwise(0)
    return priced.select("trip_id", (F.col("fare") + F.coalesce("special", F.lit(0)) + surcharge).cast("long").alias("total"))


@op("d02_scaled_fare", "SELECT l.trip_id, coalesce((SELECT min_by(b.yen, b.ord) FROM band b WHERE b.company = l.company AND ceil(l.km * CASE WHEN l.company = 'Metro' THEN 1.25 ELSE 1 END) <= b.max_km), (SELECT max_by(b.yen, b.ord) FROM band b WHERE b.company = l.company)) AS fare FROM leg l")
def scaled_fare(n: Network):
    km = F.col("km") * F.when(F.col("company") == "Metro", 1.25).otherwise(1.0)
    return fares.band_fare(n.leg, n.band, km, ["company"]).select("trip_id", "fare")


both("d03_surcharges", "SELECT e.trip_id, CAST(sum(r.yen) AS BIGINT) AS yen FROM (SELECT s.trip_id, min_by(s.station_id, s.seq) AS o, max_by(s.station_id, s.seq) AS d, min(k.company) AS company FROM {st} s JOIN {trip} t ON s.trip_id = t.trip_id JOIN {company} k ON t.line = k.line GROUP BY s.trip_id) e JOIN (VALUES (7, 'Metro', 140), (9, NULL, 50), (44, 'Ridge', 190)) AS r(station, company, yen) ON (e.o = r.station OR e.d = r.station) AND (r.company IS NULL OR r.company = e.company) GROUP BY e.trip_id")
both("d04_transfer_discount", "SELECT user_id, CAST(CASE WHEN count(DISTINCT CASE WHEN k.company IN ('Metro', 'Coast') THEN k.company END) = 2 THEN -70 ELSE 0 END AS INT) AS yen FROM {ev} e JOIN {company} k ON e.event_type = k.line GROUP BY user_id")
both("d05_fare_groups", "SELECT company, CASE WHEN company IN ('Coast', 'Ridge') THEN 'CR' ELSE company END AS grp, count(*) AS n FROM {leg} GROUP BY company")
both("d06_milepost_km", "SELECT c.trip_id, c.seq, coalesce(abs(a.km - b.km), CAST(c.arr_t - c.dep_t AS DOUBLE)) AS km FROM {conn} c LEFT JOIN (SELECT station_id, station_id * 5.0E0 AS km FROM {stn} WHERE station_id < 50) a ON c.dep_s = a.station_id LEFT JOIN (SELECT station_id, station_id * 5.0E0 AS km FROM {stn} WHERE station_id < 50) b ON c.arr_s = b.station_id")
both("d07_bullet_group", "SELECT trip_id, seq, CASE WHEN line = 'purchase' AND greatest(dep_s, arr_s) > 60 THEN 'akita' WHEN line = 'signup' AND greatest(dep_s, arr_s) > 30 THEN 'yamagata' WHEN least(dep_s, arr_s) >= 55 THEN 'sanyo' ELSE 'tokaido' END AS grp FROM {conn}")
both("d08_express_fare", "SELECT l.trip_id, CASE WHEN l.line = 'view' THEN 410 WHEN l.company = 'Coast' THEN CASE WHEN ceil(l.km) <= 2 THEN 520 WHEN ceil(l.km) <= 5 THEN 920 ELSE 1340 END ELSE 0 END AS yen FROM {leg} l")
both("d09_premium", "SELECT l.trip_id, CASE WHEN l.line LIKE '%click%' THEN CASE WHEN ceil(l.km) <= 3 THEN 320 WHEN ceil(l.km) <= 5 THEN 530 ELSE 640 END ELSE 0 END AS yen FROM {leg} l")
both("d10_seat_delta", "SELECT l.trip_id, CASE WHEN l.line = 'error' THEN NULL WHEN l.company = 'Metro' THEN -530 WHEN l.company = 'Coast' THEN CASE WHEN l.km <= 3 THEN -400 ELSE -500 END END AS delta FROM {leg} l")


@op("d11_charges", "SELECT user_id, event_id, CAST(CASE WHEN kind = 'paid' AND (coalesce(prev = 'shinkansen', false) OR coalesce(nxt = 'shinkansen', false)) THEN floor(yen / 20.0) * 10 ELSE yen END AS BIGINT) AS charge FROM (SELECT *, lag(kind) OVER w AS prev, lead(kind) OVER w AS nxt FROM (SELECT user_id, event_id, CASE WHEN event_type = 'purchase' THEN 'shinkansen' ELSE 'paid' END AS kind, station_id * 10 + 500 AS yen FROM ev) k WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) x")
def charges(n: Network):
    units = n.ev.select("user_id", "event_id", F.when(F.col("event_type") == "purchase", "shinkansen").otherwise("paid").alias("kind"), (F.col("station_id") * 10 + 500).alias("yen"))
    return fares.charges(units, "user_id", "event_id").select("user_id", "event_id", "charge")


both("d12_station_companies", "SELECT c.dep_s, @list(company; company)@ AS companies FROM (SELECT DISTINCT c.dep_s, k.company FROM {conn} c JOIN {company} k ON c.line = k.line WHERE c.mode = 0) c GROUP BY c.dep_s")

_OPERATORS = "(VALUES ('ＪＲ東西線', ''), ('富山地方鉄道本線', ''), ('京成本線', '京成'), ('あおなみ線', ''), ('神戸高速線＜東西線＞', ''), ('JR北海道線', 'JR北海道'), ('', '')) AS s(line, company)"


@op("d13_line_operator", f"SELECT line, CASE WHEN line = '' THEN '' WHEN regexp_matches(line, '^(ＪＲ|JR)') THEN 'JR' WHEN company LIKE 'JR%' THEN 'JR' WHEN company <> '' THEN company WHEN regexp_extract(regexp_replace(line, '＜.+＞$', ''), '^(.+?(?:鐵道|鉄道|電鉄|電気軌道|軌道|急行|交通|地下鉄|モノレール)).', 1) <> '' THEN regexp_extract(regexp_replace(line, '＜.+＞$', ''), '^(.+?(?:鐵道|鉄道|電鉄|電気軌道|軌道|急行|交通|地下鉄|モノレール)).', 1) ELSE regexp_replace(line, '＜.+＞$', '') END AS operator FROM {_OPERATORS}")
def line_operator(n: Network):
    return n.spark.sql(f"SELECT * FROM {_OPERATORS}").select("line", scalars.operator_of(F.col("line"), F.col("company")).alias("operator"))


_ENTRIES = [("A", 1, "1", "中央線（快速）", None, "新宿方面"), ("A", 2, "2", "中央線", None, "東京方面"), ("A", 3, "3", "総武線", None, "千葉方面"), ("B", 1, "1", "京王線", "各停", "橋本"), ("B", 2, "2", "京王線", "特急", "橋本"), ("B", 3, "3", "京王線", "特急", "新宿"), ("C", 1, "10", "東海道新幹線", None, "大阪"), ("C", 2, "9", "東海道新幹線", None, "大阪")]
_LEGS = [(1, "A", "ＪＲ中央線", None, ["新宿"], []), (2, "A", "ＪＲ総武線", None, [], []), (3, "B", "京王線", "特急", ["橋本"], ["新宿"]), (4, "B", "京王線", "各停", [], []), (5, "C", "東海道新幹線", None, ["大阪"], []), (6, "C", "東海道線", None, ["大阪"], []), (7, "A", "ＪＲ中央線", None, [], [])]


@op("d14_platform_match", "SELECT CAST(leg AS BIGINT) AS leg, track FROM (VALUES (1, '1'), (2, '3'), (3, '2'), (4, '1'), (5, '9・10')) AS t(leg, track)")
def platform_match(n: Network):
    entries = n.spark.createDataFrame(_ENTRIES, "station string, ord int, track string, line string, type string, dest string")
    legs = n.spark.createDataFrame(_LEGS, "leg long, station string, line string, kind string, ahead array<string>, behind array<string>")
    return platforms.match(legs, entries)


_PAIRS = "(VALUES ('東海道新幹線', '東海道線', 0), ('中央線（快速）', 'ＪＲ中央線', 2), ('東海道・山陽新幹線', '山陽新幹線', 1), ('京王線', '京王井の頭線', 1), ('南武線', '横浜線', 0)) AS t(entry, leg, score)"


@op("d15_line_score", f"SELECT entry, leg, score FROM {_PAIRS}")
def line_score(n: Network):
    return n.spark.sql(f"SELECT entry, leg FROM {_PAIRS}").select("entry", "leg", platforms.line_score(F.col("entry"), F.col("leg")).alias("score"))


_CELLS = "(VALUES ('快速急行・急行', '急行', true), ('特急ロマンスカー', '特急', true), ('各駅停車', '普通', true), ('急行', '快速', false), ('', '急行', false)) AS t(cell, kind, fits)"


@op("d16_type_match", f"SELECT cell, kind, fits FROM {_CELLS}")
def type_match(n: Network):
    return n.spark.sql(f"SELECT cell, kind FROM {_CELLS}").select("cell", "kind", platforms.type_matches(F.col("cell"), F.col("kind")).alias("fits"))


@op("d17_track_format", "SELECT track, label FROM (VALUES ('20 - 23', '20-23番線'), ('1・2', '1・2番線'), ('', '')) AS t(track, label)")
def track_format(n: Network):
    return n.spark.createDataFrame([("20 - 23",), ("1・2",), ("",)], "track string").select("track", platforms.format_track(F.col("track")).alias("label"))


@op("d18_direction_hints", "SELECT a.trip_id, a.seq, string_agg(CAST(b.station_id AS VARCHAR), ',' ORDER BY b.seq) AS ahead FROM st a JOIN st b ON a.trip_id = b.trip_id AND b.seq > a.seq GROUP BY a.trip_id, a.seq")
def direction_hints(n: Network):
    """The stations ahead of each stop, from a frame of the trip's following rows."""
    ahead = F.collect_list("station_id").over(Window.partitionBy("trip_id").orderBy("seq").rowsBetween(1, Window.unboundedFollowing))
    return n.st.withColumn("ahead", ahead).where(F.size("ahead") > 0).select("trip_id", "seq", F.array_join(F.col("ahead").cast("array<string>"), ",").alias("ahead"))


# -- scalars -------------------------------------------------------------------------------
@op("x01_clock", "SELECT event_id, lpad(CAST(t // 60 AS STRING), 2, '0') || ':' || lpad(CAST(t % 60 AS STRING), 2, '0') AS at, t AS back FROM ev")
def clock(n: Network):
    at = scalars.clock(F.col("t"))
    return n.ev.select("event_id", at.alias("at"), scalars.minutes(at).alias("back"))


@op("x02_period", "SELECT event_id, CASE WHEN t // 60 BETWEEN 7 AND 9 THEN 'morning' WHEN t // 60 BETWEEN 17 AND 19 THEN 'evening' WHEN t // 60 < 7 OR t // 60 >= 22 THEN 'off' ELSE 'day' END AS part FROM ev")
def period(n: Network):
    return n.ev.select("event_id", scalars.period(F.col("t")).alias("part"))


_NAMES = "(VALUES ('西武新宿', '新宿'), ('京成上野駅', '上野'), ('三ノ宮(ＪＲ)', '三ノ宮'), ('新宿', '新宿')) AS t(name, base)"


@op("x03_base_name", f"SELECT name, base FROM {_NAMES}")
def base_names(n: Network):
    return n.spark.sql(f"SELECT name FROM {_NAMES}").select("name", scalars.base_name(F.col("name")).alias("base"))


_CANON = "(VALUES ('ＪＲ中央線', '中央線'), ('東京メトロ東西線', '東西線'), ('京浜急行電鉄 本線', '京急本線'), ('北総鉄道北総線', '北総鉄道')) AS t(name, short)"


@op("x04_canonical_line", f"SELECT name, short FROM {_CANON}")
def canonical(n: Network):
    return n.spark.sql(f"SELECT name FROM {_CANON}").select("name", scalars.canonical_line(F.col("name")).alias("short"))


_TAILS = "(VALUES ('1001HB', '1001'), ('B1025SR', '1025'), ('12_2', '12'), ('abc', 'abc')) AS t(tail, core)"


@op("x05_core_number", f"SELECT tail, core FROM {_TAILS}")
def core_number(n: Network):
    return n.spark.sql(f"SELECT tail FROM {_TAILS}").select("tail", scalars.core_number(F.col("tail")).alias("core"))


@op("x06_haversine", f"SELECT a.station_id AS a, b.station_id AS b, round({_KM}, 6) AS km FROM stn a JOIN stn b ON b.station_id = a.station_id + 1")
def haversine(n: Network):
    a, b = n.stn.alias("a"), n.stn.alias("b")
    km = scalars.haversine_km(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    return a.join(b, F.col("b.station_id") == F.col("a.station_id") + 1).select(F.col("a.station_id").alias("a"), F.col("b.station_id").alias("b"), F.round(km, 6).alias("km"))
