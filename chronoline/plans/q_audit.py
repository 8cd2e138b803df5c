"""Sinks, maintenance and audits by the operators' own rules."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from chronoline.functions import names
from chronoline.operators import feeds, geocode, journeys, platforms, spatial, tickets, timetable
from chronoline.operators.graph import own_folder, search
from chronoline.plans import q_rules, q_search, q_sources
from chronoline.plans.adapter import Network
from chronoline.plans.q_rules import _values
from chronoline.plans.registry import both, op
from chronoline.sources import gtfs, sinks, tv3


# -- sinks and sources ---------------------------------------------------------------------
@op("s06_json_sink", "SELECT trip_id, line FROM trip WHERE cal > 1")
def json_sink(n: Network):
    """A JSON table that is written and then replaced."""
    path = f"{own_folder(n.spark)}/json-{uuid.uuid4().hex}"
    sinks.replace_json(n.trip.select("trip_id", "line"), path)
    sinks.replace_json(n.trip.where("cal > 1").select("trip_id", "line"), path)
    return n.spark.read.schema("trip_id long, line string").json(path)


@op("s33_json_log", "SELECT event_id, event_type FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-15'")
def json_log(n: Network):
    """Two appends to a log of lines, exported from a day on."""
    path = f"{own_folder(n.spark)}/log-{uuid.uuid4().hex}"
    rows = n.read("events").select("event_id", "event_type", "ts")
    for odd in (0, 1):
        sinks.append_log(rows.where(F.col("event_id") % 2 == odd), path, F.col("ts").cast("timestamp"))
    return sinks.read_log(n.spark, path, "event_id long, event_type string", "2024-01-15").select("event_id", "event_type")


@op("s15_feed_info_rows", "SELECT * FROM (VALUES ('a', 'City', 'https://city.example', DATE '2026-01-01', DATE '2026-12-31'), ('b', 'Coast', 'https://coast.example', DATE '2026-04-01', NULL)) AS t(feed, publisher, url, since, until)")
def feed_info_rows(n: Network):
    import io
    import zipfile

    def feed(text: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(zipfile.ZipInfo("feed_info.txt"), text.encode("utf-8-sig"))
        return out.getvalue()

    head = "feed_publisher_name,feed_publisher_url,feed_lang,feed_start_date,feed_end_date\n"
    files = [("a.zip", feed(head + "City,https://city.example,ja,20260101,20261231\nOther,x,ja,20200101,20200101\n")), ("b.zip", feed(head + "Coast,https://coast.example,ja,20260401,\n"))]
    return gtfs.feed_info(gtfs.members(n.spark, q_sources.written(n, files), "feed_info.txt"))


_RECORDS = [("t1", "A", None, [("1", None, "08:00"), ("2", "08:10", None)]), ("t2", "A", "HTTP 500", [("1", None, "09:00"), ("2", "09:10", None)]), ("t3", "B", None, [("1", None, "10:00")]), ("t4", "B", None, [("3", None, None), ("4", "24:05", "24:06"), ("5", "24:30", None)])]


@op("s24_train_records", f"SELECT tx, line, CAST(first_dep AS INT) AS first_dep, CAST(stops AS INT) AS stops FROM {_values([('t1', 'A', 480, 2), ('t4', 'B', 1446, 3)], 'tx, line, first_dep, stops')}")
def train_records(n: Network):
    rows = n.spark.createDataFrame(_RECORDS, "tx string, line string, error string, stops array<struct<s:string,a:string,d:string>>")
    return timetable.train_table(rows).select("tx", "line", "first_dep", F.size("stops").alias("stops"))


@op(
    "s26_until_empties",
    "SELECT trip_id, seq FROM (SELECT *, min(CASE WHEN run = 4 THEN seq END) OVER (PARTITION BY trip_id) AS stop FROM (SELECT *, sum(CASE WHEN station_id % 3 <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY trip_id ORDER BY seq ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS run FROM st) x) y WHERE stop IS NULL OR seq <= stop",
)
def enumerated(n: Network):
    return feeds.until_empties(n.st, "trip_id", "seq", F.col("station_id") % 3 != 0).select("trip_id", "seq")


@op("s31_guarded_files", f"SELECT file, CAST(trips AS BIGINT) AS trips, refused FROM {_values([('cut.tv3', None, True), ('good.tv3', 1, False), ('markup.tv3', None, True), ('other.tv3', None, True)], 'file, trips, refused')}")
def guarded_files(n: Network):
    """Packed files judged where they are read."""
    trips = [[(1, None, 5), (2, 9, None)]]
    files = [("good.tv3", tv3.pack(trips)), ("cut.tv3", tv3.pack(trips, False)[:20]), ("markup.tv3", b"<html>busy</html>"), ("other.tv3", b"TVX" + bytes(20))]
    return tv3.guarded(n.spark, q_sources.written(n, files)).select("file", "trips", F.col("error").isNotNull().alias("refused"))


# -- joins ---------------------------------------------------------------------------------
_NAMED = "CASE WHEN station_id >= 90 THEN 'B' || (station_id - 90) || '駅前' WHEN station_id >= 70 THEN 'X' || station_id ELSE 'B' || (station_id % 10 + 10 * (station_id // 30)) END"
_KM = "2 * 6371.0 * asin(sqrt(power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2)))"


@op(
    "j08_all_footpaths",
    f"""WITH s AS (SELECT station_id, lat, lon, mode, {_NAMED} AS name FROM stn), g AS (SELECT *, count(*) OVER (PARTITION BY name) AS n FROM s),
    x AS (SELECT a.station_id AS a, b.station_id AS b, {_KM} AS km FROM s a JOIN s b ON a.station_id < b.station_id AND NOT (a.mode = 1 AND b.mode = 1) AND {_KM} <= 0.4
    UNION ALL SELECT a.station_id, b.station_id, {_KM} FROM g a JOIN g b ON a.name = b.name AND a.station_id < b.station_id WHERE a.n BETWEEN 2 AND 8 AND {_KM} <= 1.2
    UNION ALL SELECT least(a.station_id, b.station_id), greatest(a.station_id, b.station_id), {_KM} FROM s a JOIN s b ON a.mode = 1 AND b.mode = 0 AND regexp_extract(a.name, '^(.+?)駅', 1) = b.name WHERE {_KM} <= 0.6)
    SELECT a, b, min(CAST(round_even(km * 15, 0) + 3 AS INT)) AS walk FROM x GROUP BY a, b""",
)
def all_footpaths(n: Network):
    k = F.col("station_id")
    name = F.when(k >= 90, F.concat(F.lit("B"), k - 90, F.lit("駅前"))).when(k >= 70, F.concat(F.lit("X"), k)).otherwise(F.concat(F.lit("B"), k % 10 + 10 * F.floor(k / 30)))
    stops = n.stn.withColumn("name", name)
    return spatial.all_footpaths(stops, stops.withColumn("base", F.col("name")))


@op("j19_patched_places", f"SELECT station_id, patched, CAST(lat AS DOUBLE) AS lat FROM {_values([(1, 'yes', 35.01), (2, 'far', 36.0), (3, 'ambiguous', 37.0), (4, 'ambiguous', 38.0), (5, None, 39.0), (6, 'yes', 40.0)], 'station_id, patched, lat')}")
def patched_places(n: Network):
    points = n.spark.createDataFrame([(1, "a", 35.0, 139.0), (2, "b", 36.0, 139.0), (3, "c", 37.0, 139.0), (4, "c", 38.0, 139.0), (5, "d", 39.0, 139.0), (6, "e", None, None)], "station_id int, name string, lat double, lon double")
    manual = n.spark.createDataFrame([("a", 35.01, 139.0), ("b", 36.5, 139.0), ("c", 37.0, 139.1), ("e", 40.0, 139.0)], "name string, lat double, lon double")
    return geocode.patch(points, manual).select("station_id", "patched", "lat")


_TRAINS = "tx string, first int, last int, dep int"


@op("j24_new_trains", f"SELECT tx FROM {_values([('9-a-2',), ('7-c-1',)], 'tx')}")
def new_trains(n: Network):
    existing = n.spark.createDataFrame([("1-a-1", 1, 5, 480), ("2-a-1", 1, 5, 500)], _TRAINS)
    found = n.spark.createDataFrame([("1-a-1", 1, 5, 480), ("1-b-1", 1, 5, 480), ("9-a-2", 1, 5, 480), ("9-b-2", 1, 5, 480), ("7-c-1", 2, 5, 480)], _TRAINS)
    return feeds.new_trains(found, existing).select("tx")


@op("m05_inherited_calendar", f"SELECT tx, CAST(cal AS INT) AS cal FROM {_values([('1-x-9', 3), ('2-y-1', 3), ('3-z-1', 5), ('4-z-1', 7), ('5', 7), ('6-q-6', 1 | 2 | 4)], 'tx, cal')}")
def inherited_calendar(n: Network):
    trains = n.spark.createDataFrame([("1-x-9",), ("2-y-1",), ("3-z-1",), ("4-z-1",), ("5",), ("6-q-6",)], "tx string")
    existing = n.spark.createDataFrame([("1-a-9", 3, 1), ("1-b-9", 1, 2), ("4-a-1", None, 3)], "tx string, cal int, ord int")
    keys = lambda *k: n.spark.createDataFrame([(x,) for x in k], "key string")
    return feeds.inherited_calendar(trains, existing, keys("2|1", "6|6"), keys("3|1", "6|6"))


@op("m03_fetch_outcome", f"SELECT page, status FROM {_values([(1, 'done'), (2, 'final'), (3, 'retry'), (4, 'retry'), (5, 'retry')], 'page, status')}")
def fetch_outcome(n: Network):
    rows = n.spark.createDataFrame([(1, 200, None), (2, 404, None), (3, 503, None), (4, None, "timeout"), (5, 200, "cut off")], "page int, code int, error string")
    return rows.select("page", feeds.fetch_status(F.col("code"), F.col("error")).alias("status"))


op("w03_running_best", "SELECT trip_id, seq, min(arr_t) OVER (PARTITION BY arr_s ORDER BY dep_t, trip_id, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best FROM conn")(lambda n: timetable.running_best(n.conn).select("trip_id", "seq", "best"))

_ROUTES = [(1, 600, 700, 2, 1), (2, 610, 704, 1, 2), (3, 603, 703, 0, 3), (4, 500, 650, 3, 4)]


@op("o03_threshold_order", f"SELECT ord, CAST(place AS BIGINT) AS place FROM {_values([(4, 1), (2, 2), (3, 3), (1, 4)], 'ord, place')}")
def threshold_order(n: Network):
    rows = n.spark.createDataFrame([("x", *r[1:4], r[0]) for r in _ROUTES], "req string, dep int, arr int, transfers int, ord int")
    return timetable.threshold_order(rows, "req").select("ord", "place")


@op("q15_period_headway", f"SELECT line, hour, CAST(headway AS INT) AS headway FROM {_values([('A', 7, 4), ('A', 12, 8), ('A', 18, 4), ('A', 20, 12), ('A', 23, 20), ('B', 8, 10), ('B', 5, 30)], 'line, hour, headway')}")
def period_headway(n: Network):
    rows = n.spark.createDataFrame([("A", 7), ("A", 12), ("A", 18), ("A", 20), ("A", 23), ("B", 8), ("B", 5)], "line string, hour int")
    table = {"A": {"rush": 4, "day": 8, "night": 12, "early": 20}}
    return rows.select("line", "hour", timetable.headway(F.col("line"), F.col("hour"), table, {"rush": 10, "day": 15, "night": 20, "early": 30}).alias("headway"))


# -- fares ---------------------------------------------------------------------------------
_ENDS = [(1, "成田空港", "上野", "京成", "京成"), (2, "上野", "成田空港", "京成", "京成スカイアクセス"), (3, "羽田空港第３ターミナル(京急)", "品川", "東急", "京急"), (4, "関西空港", "難波", "南海", "南海"), (5, "関西空港", "大阪", "JR西日本", "JR西日本")]


@op("d03_surcharge_rules", f"SELECT journey, label, CAST(yen AS INT) AS yen FROM {_values([(1, '京成空港加算', 140), (3, '京急空港加算', 50), (4, '南海空港加算', 190)], 'journey, label, yen')}")
def surcharge_rules(n: Network):
    return tickets.surcharges(n.spark.createDataFrame(_ENDS, "journey int, origin string, destination string, first_company string, last_company string"), q_rules.TARIFF)


@op("d04_discount_rules", f"SELECT journey, CAST(yen AS INT) AS yen FROM {_values([(1, -70)], 'journey, yen')}")
def discount_rules(n: Network):
    used = [(1, "東京メトロ"), (1, "都営地下鉄"), (1, "東京メトロ"), (2, "東京メトロ"), (3, "都営地下鉄"), (3, "JR")]
    return tickets.discounts(n.spark.createDataFrame(used, "journey int, company string"), q_rules.TARIFF).select("journey", "yen")


@op("d05_fare_segments", f"SELECT journey, CAST(seg AS INT) AS seg, company, CAST(km AS DOUBLE) AS km FROM {_values([(1, 1, 'JR', 30.0), (1, 2, '京成スカイアクセス', 12.0), (1, 3, '京急', 4.0), (2, 1, '京成', 5.0)], 'journey, seg, company, km')}")
def fare_segments(n: Network):
    rows = [(1, 1, 0, "JR", 10.0), (1, 2, 0, "JR", 20.0), (1, 3, 0, "京成", 5.0), (1, 3, 1, "京成スカイアクセス", 7.0), (1, 4, 0, "京急", 4.0), (2, 1, 0, "京成", 5.0)]
    parts = n.spark.createDataFrame([(*r, []) for r in rows], "journey int, ord int, part int, company string, km double, stops array<struct<name:string,lat:double,lon:double,companies:array<string>>>")
    return tickets.segments(parts).select("journey", F.col("seg").cast("int").alias("seg"), "company", "km")


_GROUPS = [(1, "東海道新幹線", "のぞみ", 0.0, 552.6, "tokaido"), (2, "東海道・山陽新幹線", "のぞみ", 552.6, 1174.9, "sanyo"), (3, "東北・北海道新幹線", "こまち", 0.0, 662.6, "akita"), (4, "東北・北海道新幹線", "こまち", 0.0, 351.8, "tohoku"), (5, "東北・北海道新幹線", "つばさ", 0.0, 359.9, "yamagata"), (6, "山陽・九州新幹線", "みずほ", 1174.9, 1463.8, "sanyo_kyushu"), (7, "東海道新幹線", "ひかり", None, 600.0, "tokaido"), (8, "西九州新幹線", "かもめ", None, None, "nishikyushu")]


@op("d07_bullet_groups", f"SELECT ride, grp FROM {_values([(g[0], g[5]) for g in _GROUPS], 'ride, grp')}")
def bullet_groups(n: Network):
    rows = n.spark.createDataFrame([g[:5] for g in _GROUPS], "ride int, line string, kind string, a double, b double")
    return rows.select("ride", tickets.bullet_group(q_rules.TARIFF, F.col("line"), F.col("kind"), F.col("a"), F.col("b")).alias("grp"))


@op("d09_premiums", f"SELECT kind, CAST(km AS DOUBLE) AS km, CAST(yen AS INT) AS yen FROM {_values([('はやぶさ', 300.0, 320), ('はやぶさ', 300.5, 530), ('はやぶさ', 900.0, 640), ('のぞみ', 500.0, 0)], 'kind, km, yen')}")
def premiums(n: Network):
    rows = n.spark.createDataFrame([("はやぶさ", 300.0), ("はやぶさ", 300.5), ("はやぶさ", 900.0), ("のぞみ", 500.0)], "kind string, km double")
    return rows.select("kind", "km", tickets.premium(q_rules.TARIFF, F.col("kind"), F.col("km")).alias("yen"))


_SEATS = [(1, "shinkansen", "tokaido", 300.0, "のぞみ", "JR", -760), (2, "shinkansen", "tohoku", 300.0, "はやぶさ", "JR", None), (3, "shinkansen", "akita", 600.0, "x", "JR", None), (4, "paid", None, 60.0, "しらさぎ", "JR", -530), (5, "paid", None, 60.0, "あずさ", "JR", None), (6, "paid", None, 60.0, "スカイライナー", "京成", None), (7, "paid", None, 60.0, "特急", "近鉄", None)]


@op("d10_seat_deltas", f"SELECT unit, CAST(delta AS INT) AS delta FROM {_values([(s[0], s[6]) for s in _SEATS], 'unit, delta')}")
def seat_deltas(n: Network):
    rows = n.spark.createDataFrame([s[:6] for s in _SEATS], "unit int, kind string, grp string, km double, type string, company string")
    return rows.select("unit", tickets.seat_delta(q_rules.TARIFF, F.struct("kind", "grp", "km", "type", "company")).alias("delta"))


_CURATED = [("東京", "東海道本線"), ("東京", "東京メトロ丸ノ内線"), ("東京", "東北新幹線"), ("渋谷", "東急東横線"), ("渋谷", "ＪＲ埼京線"), ("京都", "東西線"), ("京都", "近鉄京都線"), ("京都", "琵琶湖線"), ("我孫子", "成田線我孫子支線"), ("釧路", "根室本線: 釧路 => 根室"), ("大森", "京浜東北線"), ("x", "謎の線")]


@op("d12_curated_companies", f"SELECT station, companies FROM {_values([('東京', 'JR,東京メトロ'), ('渋谷', 'JR,東急'), ('京都', 'JR,近鉄'), ('我孫子', 'JR'), ('釧路', 'JR'), ('大森', 'JR'), ('x', '')], 'station, companies')}")
def curated_companies(n: Network):
    lines = n.spark.createDataFrame([("ＪＲ東海道本線",), ("ＪＲ成田線",), ("ＪＲ根室本線",), ("ＪＲ京浜東北・根岸線",), ("ＪＲ東西線",), ("東急東横線",)], "line string")
    rules = n.spark.createDataFrame([("match", "東西線", "東京メトロ"), ("prefix", "東京メトロ", "東京メトロ"), ("prefix", "東急", "東急"), ("prefix", "近鉄", "近鉄")], "kind string, text string, company string")
    found = tickets.station_companies(n.spark.createDataFrame(_CURATED, "station string, line string"), rules, tickets.jr_bare_names(lines))
    return found.select("station", F.array_join("companies", ",").alias("companies"))


# -- platforms and names -------------------------------------------------------------------
@op("d18_attached_tracks", f"SELECT CAST(leg AS BIGINT) AS leg, track FROM {_values([(1, '1'), (2, '2'), (3, '3'), (4, None)], 'leg, track')}")
def attached_tracks(n: Network):
    from chronoline.plans.q_joins import _ENTRIES

    entries = n.spark.createDataFrame(_ENTRIES, "station string, ord int, track string, line string, type string, dest string")
    rows = [(1, "A", "ＪＲ中央線", "ＪＲ中央線", None, ["東京", "A", "新宿"], 1, "高尾"), (2, "A", "ＪＲ中央線", "ＪＲ中央線", None, ["新宿", "A", "東京"], 1, None), (3, "A", "直通線", "ＪＲ総武線", None, ["A", "x"], 0, "千葉"), (4, "C", "東海道線", "東海道線", None, ["C"], 0, "大阪")]
    legs = n.spark.createDataFrame(rows, "leg long, station string, shown string, line string, kind string, stops array<string>, at int, dest string")
    return platforms.attach(legs, entries).select("leg", "track")


_SUGGEST = [("新橋", "しんばし", "shimbashi", 0), ("新橋", "しんばし", "shimbashi", 1), ("新橋駅前", "しんばしえきまえ", "shimbashiekimae", 1), ("羽田空港第２ターミナル(東京モノレール)", "はねだくうこう", "haneda", 0), ("大新橋", "おおしんばし", "oshimbashi", 0)]


@op("ui_station_suggest", f"SELECT q, name, CAST(mode AS INT) AS mode, CAST(place AS BIGINT) AS place FROM {_values([('新橋', '新橋', 0, 1), ('新橋', '大新橋', 0, 2), ('新橋', '新橋', 1, 3), ('新橋', '新橋駅前', 1, 4), ('シンバシ', '新橋', 0, 1), ('シンバシ', '大新橋', 0, 2), ('シンバシ', '新橋', 1, 3), ('シンバシ', '新橋駅前', 1, 4), ('haneda', '羽田空港第２ターミナル(東京モノレール)', 0, 1), ('羽田空港第2', '羽田空港第２ターミナル(東京モノレール)', 0, 1)], 'q, name, mode, place')}")
def station_suggest(n: Network):
    from pyspark.sql import Window

    stations = n.spark.createDataFrame(_SUGGEST, "name string, kana string, romaji string, mode int")
    asked = n.spark.createDataFrame([("新橋",), ("シンバシ",), ("haneda",), ("羽田空港第2",), ("",)], "q string")
    met = asked.join(F.broadcast(stations), F.lit(True)).withColumn("rank", names.suggest_rank(F.col("q"), F.col("name"), F.col("kana"), F.col("romaji"), F.col("mode"))).where("rank is not null")
    return met.select("q", "name", "mode", F.row_number().over(Window.partitionBy("q").orderBy("rank")).cast("long").alias("place"))


@op("m13_name_groups", f"SELECT key, CAST(variants AS BIGINT) AS variants FROM {_values([('ケ関', 2), ('jr淡路', 2)], 'key, variants')}")
def name_groups(n: Network):
    rows = n.spark.createDataFrame([("ＪＲ淡路",), ("JR淡路",), ("淡路",), ("け関",), ("ケ関",), ("丸の内",), ("丸ノ内2",)], "name string")
    return rows.groupBy(names.search_key(F.col("name")).alias("key")).agg(F.countDistinct("name").alias("variants")).where("variants > 1")


both("m11_footpath_checks", f"SELECT f.a, f.b, CAST({_KM} > 0.38 AS BOOLEAN) AS far, CAST(abs(f.walk - (floor({_KM} * 15 + 0.5) + 3)) > 3 AS BOOLEAN) AS odd, CAST(a.lat IS NULL OR b.lat IS NULL AS BOOLEAN) AS placeless FROM {{foot}} f JOIN {{stn}} a ON f.a = a.station_id JOIN {{stn}} b ON f.b = b.station_id")
both("u04_all_sibling_minutes", "SELECT o.dep_s, o.line, o.dep_t FROM (SELECT DISTINCT dep_s, line, dep_t FROM {conn} WHERE mode = 1) o LEFT JOIN (SELECT DISTINCT dep_s, line, dep_t FROM {conn} WHERE mode = 0) s ON o.dep_s = s.dep_s AND o.line = s.line AND o.dep_t = s.dep_t WHERE s.dep_t IS NULL")
both("g15_graph_checks", "SELECT 'orphan' AS what, CAST(s.station_id AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b FROM {stn} s LEFT JOIN (SELECT dep_s AS x FROM {conn} UNION SELECT arr_s FROM {conn}) c ON c.x = s.station_id WHERE c.x IS NULL UNION ALL SELECT 'no_train', CAST(e.a AS BIGINT), CAST(e.b AS BIGINT) FROM {edge} e LEFT JOIN (SELECT DISTINCT least(dep_s, arr_s) AS a, greatest(dep_s, arr_s) AS b FROM {conn} WHERE mode = 0) c ON e.a = c.a AND e.b = c.b WHERE c.a IS NULL UNION ALL SELECT 'thin', CAST(s AS BIGINT), CAST(n AS BIGINT) FROM (SELECT dep_s AS s, count(*) AS n FROM {conn} GROUP BY dep_s) x WHERE n < 30")


@op("a15_busiest_day", "SELECT CAST(trip_id % 100 AS INT) AS day, count(*) AS trips FROM trip GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def busiest_day(n: Network):
    return feeds.representative_day(n.trip, (F.col("trip_id") % 100).cast("int"))


# -- searches ------------------------------------------------------------------------------
def _departures(n: Network, source: int, target: int):
    """The search at every departure of a station."""
    starts = n.conn.where(F.col("dep_s") == source).select("dep_t").distinct()
    asked = starts.select(F.col("dep_t").cast("long").alias("req"), F.lit(source).alias("source"), F.lit(target).alias("target"), F.col("dep_t").alias("start"), F.lit(None).cast("int").alias("day"))
    return search(asked, n.conn, n.foot).select("dep", "arr", "rides", "path").distinct()


@op("q19_through_service")
def fewest_changes(n: Network):
    return _departures(n, 8, 55).agg(F.min(F.struct("rides", "arr", "dep")).alias("x")).select("x.*")


@op("m23_top_candidates")
def candidates(n: Network):
    """The twelve candidates that arrive first, of all departures."""
    return _departures(n, 8, 90).orderBy("arr", F.desc("dep"), "rides", "path").limit(12)


@op("q17_day_flags")
def day_flags(n: Network):
    """Day types side by side; flagged where one lacks a journey or takes 20 minutes more than the weekday."""
    asked = q_search._requests(n, [(8, b, 420, d) for b in (3, 21, 55, 90) for d in (0, 1, 2)])
    took = asked.join(search(asked, n.conn, n.foot), "req", "left").withColumn("took", F.col("arr") - F.col("dep"))
    days = took.groupBy("source", "target").pivot("day", [0, 1, 2]).agg(F.min("took")).withColumnsRenamed({"0": "weekday", "1": "saturday", "2": "holiday"})
    worse = lambda c: F.col(c).isNull() | (F.col(c) >= F.col("weekday") + 20)
    return days.withColumn("flagged", F.col("weekday").isNull() | worse("saturday") | worse("holiday"))


@op("ui_overnight", f"SELECT CAST(km AS DOUBLE) AS km, overnight FROM {_values([(1199.9, False), (1200.0, True), (2000.0, True)], 'km, overnight')}")
def overnight(n: Network):
    return n.spark.createDataFrame([(1199.9,), (1200.0,), (2000.0,)], "km double").select("km", journeys.overnight(F.col("km")).alias("overnight"))


# -- filters by class, stops by distance ---------------------------------------------------
# The fixture's lines as real ones, and kinds of trains by their type.
_LINE = {"click": "ＪＲ中央線", "error": "京急本線", "purchase": "東海道新幹線", "signup": "京成本線", "view": "近鉄奈良線"}
_KIND = ["普通", "特急", "スカイライナー"]


@op("f04_by_service_class", "SELECT trip_id, CAST(CASE WHEN line = 'purchase' THEN 'shinkansen' WHEN type_id = 2 THEN 'paid' WHEN type_id = 1 AND line IN ('click', 'view') THEN 'paid' END AS VARCHAR) AS class FROM trip WHERE line <> 'purchase'")
def by_service_class(n: Network):
    """Trips with their class, the bullet trains left out."""
    from chronoline.functions import scalars

    lines = F.create_map(*[x for k, v in _LINE.items() for x in (F.lit(k), F.lit(v))])
    name = F.try_element_at(lines, F.col("line"))
    kind = F.get(F.array(*map(F.lit, _KIND)), F.col("type_id"))
    cls = scalars.service_class(name, kind, F.array(*map(F.lit, scalars.PAID_NAMES)), F.when(name.startswith("近鉄"), "近鉄").otherwise(""))
    return n.trip.select("trip_id", cls.alias("class")).where(F.coalesce("class", F.lit("")) != "shinkansen")
