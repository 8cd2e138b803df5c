"""Sources and sinks, on files written from the fixture."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoline.operators.graph import own_folder, settled
from chronoline.plans.adapter import Network
from chronoline.plans.registry import both, op
from chronoline.sources import gtfs, html, tv3

_TIMES = "SELECT trip_id, seq, station_id, CASE WHEN seq > 1 THEN t END AS arr, CASE WHEN seq < n_stops THEN t END AS dep FROM st"


def times(n: Network):
    return n.st.select("trip_id", "seq", "station_id", F.when(F.col("seq") > 1, F.col("t")).alias("arr"), F.when(F.col("seq") < F.col("n_stops"), F.col("t")).alias("dep"))


def _unpacked(n: Network):
    """The fixture's stop times through the packed format, one file a day of the month."""
    from collections.abc import Iterator

    import numpy as np
    import pandas as pd

    files = tv3.packed(times(n).withColumn("day", F.col("trip_id") % 100), by="day")

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for by, content in zip(part["by"], part["content"]):
                offsets, station, arr, dep = tv3.unpack(content)
                sizes = np.diff(offsets.astype(np.int64))
                seq = np.arange(len(station)) - np.repeat(offsets[:-1].astype(np.int64), sizes) + 1
                yield pd.DataFrame({"day": int(by), "trip": np.repeat(np.arange(len(sizes)), sizes), "seq": seq, "station_id": station.astype("int64"), "arr": arr.astype("int64"), "dep": dep.astype("int64")})

    return files.mapInPandas(rows, "day long, trip long, seq long, station_id long, arr long, dep long")


def unpacked_stops(n: Network):
    """(trip_id, seq, station_id, arr, dep) as read back from the packed files, whose trips stand in order of their numbers."""
    w = Window.partitionBy("day").orderBy("trip_id")
    numbered = n.st.select("trip_id", (F.col("trip_id") % 100).alias("day")).distinct().withColumn("trip", (F.row_number().over(w) - 1).cast("long"))
    known = lambda c: F.when(F.col(c) != tv3.NULL, F.col(c)).cast("int").alias(c)
    return _unpacked(n).join(numbered, ["day", "trip"], "left").select("trip_id", "seq", F.col("station_id").cast("int").alias("station_id"), known("arr"), known("dep"))


def round_trip(expected, found):
    """(trip_id, same): whether a trip's stops and times are those of the packed file; trips on one side only are not the same."""
    stops = lambda df, name: df.groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct("seq", "station_id", "arr", "dep"))).alias(name))
    return stops(expected, "a").join(stops(found, "b"), "trip_id", "full").select("trip_id", F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("same"))


def differences(now, golden):
    """(trip_id, seq) of rows that only one of the tables has."""
    return now.exceptAll(golden).unionByName(golden.exceptAll(now)).select("trip_id", "seq").distinct()


@op("s01_packed_scan", "SELECT trip_id % 100 AS day, count(DISTINCT trip_id) AS trips, count(*) AS stops, CAST(sum(station_id) AS BIGINT) AS stations, count_if(seq = 1) AS no_arr FROM st GROUP BY 1")
def packed_scan(n: Network):
    return _unpacked(n).groupBy("day").agg(F.countDistinct("trip").alias("trips"), F.count("*").alias("stops"), F.sum("station_id").alias("stations"), F.count_if(F.col("arr") == tv3.NULL).alias("no_arr"))


@op("s03_nested_trips", "SELECT trip_id, count(*) AS n, min_by(station_id, seq) AS first_stop, max_by(station_id, seq) AS last_stop FROM st GROUP BY trip_id")
def nested_trips(n: Network):
    x = tv3.nested(times(n), "trip_id")
    return x.select("trip_id", F.size("stops").cast("long").alias("n"), F.element_at("stops", 1)["station_id"].alias("first_stop"), F.element_at("stops", -1)["station_id"].alias("last_stop"))


@op("s04_packed_sink")
def packed_sink(n: Network):
    return tv3.packed(times(n).withColumn("day", F.col("trip_id") % 100), by="day").select("by", F.length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))


@op("s05_json_scan", "SELECT event_id, station_id FROM ev")
def json_scan(n: Network):
    return n.read("events").select("event_id", F.from_json("props", "k int")["k"].alias("station_id"))


@op("s06_table_sink", "SELECT trip_id, line, cal FROM trip")
def table_sink(n: Network):
    return settled(n.trip.select("trip_id", "line", "cal"), "sink")


def _zips(n: Network):
    """Two small feeds as zip files in memory, as the binary-file source would give them."""

    def feed(files: dict[str, str]) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, text in files.items():
                z.writestr(zipfile.ZipInfo(name), text.encode("utf-8-sig"))
        return out.getvalue()

    a = feed({"stops.txt": "stop_id,stop_name,stop_lat,stop_lon\n1,First,35.0,139.0\n2,Second,bad,139.1\n3,Third\n", "stop_times.txt": "trip_id,arrival_time,departure_time,stop_id,stop_sequence\nt,08:00:00,08:01:00,1,1\nt,25:10:00,25:11:00,2,2\n"})
    b = feed({"stops.txt": "stop_id,stop_name,stop_lat,stop_lon\n1,Other,36.5,140.0\n"})
    return [("a.zip", a), ("b.zip", b)]


def written(n: Network, files: list[tuple[str, bytes]]) -> str:
    """Write small files into a new folder of the shared one, whatever its file system; the folder's path."""
    import uuid

    sc = n.spark.sparkContext
    fs = sc._jvm.org.apache.hadoop.fs
    top = f"{own_folder(n.spark)}/files-{uuid.uuid4().hex}"
    for name, content in files:
        path = fs.Path(f"{top}/{name}")
        out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
        try:
            out.write(bytearray(content))
        finally:
            out.close()
    return top


def _members(n: Network, name: str):
    return gtfs.members(n.spark, written(n, _zips(n)), name)


@op("s07_zip_members", "SELECT * FROM (VALUES ('a', 3::BIGINT, 1::BIGINT), ('b', 1::BIGINT, 0::BIGINT)) AS t(feed, n, short)")
def zip_members(n: Network):
    return _members(n, "stops.txt").groupBy("feed").agg(F.count("*").alias("n"), F.count_if("short").alias("short"))


@op("s08_short_rows", "SELECT 'a' AS feed, 2::BIGINT AS line")
def short_rows(n: Network):
    return _members(n, "stops.txt").where("short").select("feed", "line")


@op("s09_feed_stops", "SELECT * FROM (VALUES ('a:1', 'First', 35.0::DOUBLE, 139.0::DOUBLE), ('a:2', 'Second', NULL, 139.1), ('b:1', 'Other', 36.5, 140.0)) AS t(stop, name, lat, lon)")
def feed_stops(n: Network):
    return gtfs.stops(_members(n, "stops.txt"))


@op("s09_feed_stop_times", "SELECT * FROM (VALUES ('a:t', 1, 'a:1', 480, 481), ('a:t', 2, 'a:2', 1510, 1511)) AS t(trip, seq, stop, arr, dep)")
def feed_stoptimes(n: Network):
    return gtfs.stop_times(_members(n, "stop_times.txt"))


both("s10_catalogue_filter", "SELECT p_partkey, lower(p_brand) AS key FROM {part} WHERE p_brand LIKE '%1%' AND p_partkey % 10 <> 0")


@op("s11_version_as_of", "SELECT * FROM (VALUES ('a', DATE '2026-02-01', 'v2'), ('b', DATE '2027-01-01', 'w1')) AS t(key, since, url)")
def version_as_of(n: Network):
    rows = n.spark.sql("SELECT key, CAST(since AS DATE) AS since, url FROM (VALUES ('a', '2026-01-01', 'v1'), ('a', '2026-02-01', 'v2'), ('a', '2026-09-01', 'v3'), ('b', '2027-01-01', 'w1'), ('b', '2028-01-01', 'w2')) AS t(key, since, url)")
    return gtfs.as_of(rows, "key", "since", F.lit("2026-06-01").cast("date"))


both("s12_fixed_feeds", "SELECT * FROM (VALUES ('city', 'https://feeds.example/city.zip'), ('coast', 'https://feeds.example/coast.zip')) AS t(key, url)")


@op("s13_changed_files", "SELECT user_id, CASE WHEN n < 8 THEN 'error' WHEN user_id % 2 = 0 THEN 'same' ELSE 'new' END AS status FROM (SELECT user_id, length('feed-' || user_id) AS n FROM ev GROUP BY user_id) x")
def changed_files(n: Network):
    files = n.ev.select(F.col("user_id").alias("key")).distinct().withColumn("content", F.concat(F.lit("feed-"), "key").cast("binary"))
    manifest = files.select("key", F.when(F.col("key") % 2 == 0, F.sha2("content", 256)).otherwise("old").alias("sha256"))
    return gtfs.changed(files, manifest, 8).select(F.col("key").alias("user_id"), "status")


@op("s14_manifest_upsert", "SELECT trip_id AS key, CASE WHEN trip_id % 2 = 0 THEN 'new' ELSE 'old' END AS state FROM trip WHERE trip_id % 3 <> 0")
def manifest_upsert(n: Network):
    keys = n.trip.select(F.col("trip_id").alias("key"))
    return gtfs.upsert(keys.withColumn("state", F.lit("old")), keys.where("key % 2 = 0").withColumn("state", F.lit("new")), keys.where("key % 3 <> 0"))


both("s15_feed_info", "SELECT user_id, min_by(event_type, event_id) AS publisher FROM {ev} GROUP BY user_id")
@op("s16_paged_source", "SELECT CAST(floor((r - 1) / 100) AS BIGINT) AS page, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY event_id) AS r FROM ev) x GROUP BY 1")
def paged_source(n: Network):
    from chronoline.operators import timetable

    return timetable.placed(n.ev.select("event_id"), ["event_id"], "r").groupBy(F.floor((F.col("r") - 1) / 100).alias("page")).agg(F.count("*").alias("n"))


@op("s17_point_rows", "SELECT station_id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM stn")
def point_rows(n: Network):
    text = n.stn.select("station_id", F.concat(F.lit("Point("), F.round("lon", 6), F.lit(" "), F.round("lat", 6), F.lit(")")).alias("p"))
    part = lambda k: F.regexp_extract("p", r"Point\(([-0-9.]+) ([-0-9.]+)\)", k).cast("double")
    return text.select("station_id", part(1).alias("lon"), part(2).alias("lat"))


@op("s18_merged_lines", "SELECT s, string_agg(line, ',' ORDER BY line) AS lines FROM (SELECT DISTINCT s, line FROM (SELECT dep_s AS s, line FROM conn WHERE mode = 0 UNION ALL SELECT arr_s, line FROM conn WHERE mode = 1) x) y GROUP BY s")
def merged_lines(n: Network):
    a = n.conn.where("mode = 0").groupBy(F.col("dep_s").alias("s")).agg(F.collect_set("line").alias("a"))
    b = n.conn.where("mode = 1").groupBy(F.col("arr_s").alias("s")).agg(F.collect_set("line").alias("b"))
    none = F.array().cast("array<string>")
    return a.join(b, "s", "full").select("s", F.array_join(F.array_sort(F.array_union(F.coalesce("a", none), F.coalesce("b", none))), ",").alias("lines"))


@op("s19_page_links", "SELECT page_id, count(*) AS n, CAST(sum(length(link)) AS BIGINT) AS chars FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM pages) x GROUP BY page_id")
def page_links(n: Network):
    return html.links(n.read("pages"), "page_id", "html").groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.length("link")).alias("chars"))


@op("s20_compact_board", "SELECT station_id, event_type, string_agg(CAST(t AS STRING), ' ' ORDER BY t) AS minutes FROM ev GROUP BY station_id, event_type")
def compact_board(n: Network):
    return n.ev.groupBy("station_id", "event_type").agg(F.concat_ws(" ", F.array_sort(F.collect_list("t"))).alias("minutes"))


@op("s21_best_page", "SELECT split_part(regexp_extract(url, '://([^/?#]*)', 1), '.', 1) AS grp, max_by(page_id, length(html) * 100000 + page_id) AS page_id FROM pages GROUP BY 1")
def best_page(n: Network):
    p = n.read("pages")
    return p.groupBy(F.split_part(F.regexp_extract("url", "://([^/?#]*)", 1), F.lit("."), F.lit(1)).alias("grp")).agg(F.max_by("page_id", F.length("html").cast("long") * 100000 + F.col("page_id")).alias("page_id"))


@op("s22_page_headings", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, 'lang=\"([a-z]+)\"', 1) AS lang FROM pages")
def page_headings(n: Network):
    return n.read("pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang"))


both("s24_train_table", "SELECT line, count(*) AS trains, min(dep) AS first_dep, max(arr) AS last_arr, CAST(sum(hops) AS BIGINT) AS hops FROM {leg} WHERE hops >= 2 GROUP BY line")
both("s26_enumerated_keys", "SELECT line, min(trip_id) AS first_key, max(trip_id) AS last_key, count(*) AS n FROM {trip} GROUP BY line")

_TABLE = "<h2>Fares</h2><h3>Metro</h3><table><tr><th>km</th><th>2025-01-01</th><th>2026-04-01</th><th>2030-01-01</th></tr><tr><td>3</td><td>150</td><td rowspan=2>160</td><td>170</td></tr><tr><td>6</td><td>180</td><td>200</td></tr><tr><td>10</td><td>200</td><td>210</td><td>230</td></tr></table>"


def _table_pages(n: Network):
    return n.spark.createDataFrame([(1, _TABLE), (2, "<p>none</p>"), (3, None)], "key long, html string")


@op("s27_table_grid", "SELECT * FROM (VALUES (0::BIGINT, 4::BIGINT), (1, 4), (2, 4), (3, 4)) AS t(row, cells)")
def table_grid(n: Network):
    return html.cells(_table_pages(n), "key", "html").groupBy("row").agg(F.count("*").alias("cells"))


@op("s28_platform_rows", "SELECT * FROM (VALUES ('Fares / Metro', 16::BIGINT)) AS t(heading, n)")
def platform_rows(n: Network):
    return html.cells(_table_pages(n), "key", "html").groupBy("heading").agg(F.count("*").alias("n"))


_STATION = (
    "<h2>駅構造</h2><h3>JR東日本</h3><h4>のりば</h4><table><tr><th>番線</th><th>路線</th><th>方向</th><th>行先</th></tr><tr><td>1</td><td rowspan=2>■中央線<sup class='x'></sup></td><td>西行</td><td>新宿 ・ 高尾方面</td></tr>"
    "<tr><td>2</td><td>東行</td><td>東京方面</td></tr><tr><td colspan=4>2階ホーム</td></tr><tr><td>3</td><td>総武線</td><td></td><td>降車専用</td></tr><tr><td>4</td><td>総武線</td><td></td><td>千葉方面</td></tr><tr><td>4</td><td>総武線</td><td></td><td>千葉方面</td></tr></table>"
    "<h3>京王電鉄（京王線）</h3><table><tr><th>ホーム</th><th>種別</th><th>方面</th></tr><tr><td>1・2</td><td>特急</td><td>橋本</td></tr></table>"
    "<h3>バスのりば</h3><table><tr><th>のりば</th><th>系統</th><th>行先</th></tr><tr><td>1</td><td>12</td><td>市役所</td></tr></table><h2>歴史</h2><table><tr><th>番線</th><th>行先</th></tr><tr><td>9</td><td>旧線</td></tr></table>"
)


@op("s28_platform_entries", "SELECT * FROM (VALUES (1::BIGINT, 0::BIGINT, '1', '中央線', '西行', '新宿・高尾方面', NULL, 'JR東日本'), (1, 1, '2', '中央線', '東行', '東京方面', NULL, 'JR東日本'), (1, 2, '4', '総武線', NULL, '千葉方面', NULL, 'JR東日本'), (1, 3, '1・2', NULL, NULL, '橋本', '特急', '京王電鉄（京王線）')) AS t(key, ord, track, line, dir, dest, type, op)")
def platform_entries(n: Network):
    return html.platform_entries(n.spark.createDataFrame([(1, _STATION), (2, "<p>none</p>"), (3, None)], "key long, html string"), "key", "html")


_TRAIN = (
    '<span class="ek-onetrain-title-inner"><b>つくばエクスプレス</b>　始発：つくば 区間快速　秋葉原行き</span><table><tr><td class="td-station-name"><a href="/timetable/railway/station/7001">つくば</a></td><td class="td-dep-and-arr-time">06:05発</td></tr>'
    '<tr><td>x</td></tr><tr><td class="td-station-name"><a href="/timetable/railway/station/7002">守谷</a></td><td class="td-dep-and-arr-time"><span>06:20着</span><br>06:22発</td></tr><tr><td class="td-station-name"><a href="/x">秋葉原</a></td><td class="td-dep-and-arr-time">07:01着</td></tr></table>'
)


@op("s22_train_details", "SELECT * FROM (VALUES (1::BIGINT, 'つくばエクスプレス', 'つくば', '区間快速', '秋葉原', '7001:つくば:-:06:05,7002:守谷:06:20:06:22,-:秋葉原:07:01:-'), (2, NULL, NULL, NULL, NULL, '')) AS t(key, line, origin, type, dest, stops)")
def train_details(n: Network):
    found = html.train_details(n.spark.createDataFrame([(1, _TRAIN), (2, "<p>none</p>")], "key long, html string"), "key", "html")
    text = F.transform("stops", lambda s: F.concat_ws(":", *[F.coalesce(s[c], F.lit("-")) for c in ("s", "n", "a", "d")]))
    return found.withColumn("stops", F.array_join(text, ","))


_BOARD = 'a href="/timetable/railway/train?sf=1&tx=9-1&dw=0&dt=1&departure=0605&SFF=77&d=1" b href="/timetable/railway/train?sf=1&tx=9-2&dw=0&dt=1&departure=0700&SFF=77&d=2" '


@op("s21_train_links", "SELECT * FROM (VALUES (1::BIGINT, '1', '9-1', '0605', '77', '1'), (1, '1', '9-2', '0700', '77', '2'), (2, '2', '9-3', '0810', '78', '1')) AS t(key, sf, tx, departure, sff, d)")
def train_links(n: Network):
    second = _BOARD.replace("sf=1", "sf=3") + 'href="/timetable/railway/train?sf=2&tx=9-3&dw=&dt=&departure=0810&SFF=78&d=1"'
    return html.train_links(n.spark.createDataFrame([(1, _BOARD), (2, second), (3, None)], "key long, html string"), "key", "html")


@op("s28_article_titles", "SELECT * FROM (VALUES ('大宮(埼玉)', '大宮駅,大宮駅 (埼玉県)'), ('渋谷', '渋谷駅,渋谷駅 (東京都)')) AS t(name, titles)")
def article_titles(n: Network):
    rows = n.spark.createDataFrame([("大宮(埼玉)", [], "埼玉県"), ("渋谷", ["渋谷駅", "東横線"], "東京都")], "name string, lines array<string>, pref string")
    return rows.select("name", F.array_join(F.array_sort(html.article_titles(F.col("name"), F.col("lines"), F.col("pref"))), ",").alias("titles"))


@op("s02_packed_files", "SELECT trip_id % 100 AS day, count(DISTINCT trip_id) AS trips, count(*) AS stops, CAST(sum(coalesce(arr, 0) + coalesce(dep, 0)) AS BIGINT) AS minutes FROM (" + _TIMES + ") x GROUP BY 1")
def packed_files(n: Network):
    """The packed files of all days written to the shared folder as one binary each, and scanned by ``tv3.read``."""
    files = tv3.packed(times(n).withColumn("day", F.col("trip_id") % 100), by="day").collect()  # one small file a day of the month
    folder = written(n, [(f"{r.by}.tv3", bytes(r.content)) for r in files])
    found = tv3.read(n.spark, folder)
    minutes = F.coalesce("arr", F.lit(0)) + F.coalesce("dep", F.lit(0))
    return found.groupBy(F.regexp_extract("file", "([0-9]+)", 1).cast("long").alias("day")).agg(F.countDistinct("trip").alias("trips"), F.count("*").alias("stops"), F.sum(minutes).alias("minutes"))


@op("s10_allowed_feeds", "SELECT * FROM (VALUES ('city-bus-main', 'main'), ('city-bus-night-2', 'night 2')) AS t(key, feed)")
def allowed_feeds(n: Network):
    rows = n.spark.createDataFrame([("City Bus", "main", "CC BY 4.0", None), ("City Bus", "night 2", "CC0", "2027-01-01"), ("City Bus", "old", "CC0", "2025-01-01"), ("Coast", "x", "all rights", None), ("Coast", "skip", "CC0", None)], "operator string, feed string, license string, until string")
    kept = gtfs.allowed(rows.withColumn("until", F.col("until").cast("date")), ["CC BY 4.0", "CC0"], ["skip"], F.lit("2026-06-01").cast("date"))
    return kept.select("key", "feed")


@op(
    "j26_service_days",
    "WITH c AS (SELECT user_id AS service, min(CAST(ts AS DATE)) AS start, max(CAST(ts AS DATE)) AS stop FROM ev GROUP BY user_id), d AS (SELECT CAST(DATE '2024-01-01' + CAST(i AS INT) AS DATE) AS day FROM range(30) r(i)), x AS (SELECT user_id AS service, CAST(ts AS DATE) AS day, arg_max(CASE WHEN event_type = 'error' THEN 2 ELSE 1 END, event_id) AS kind FROM ev WHERE event_type IN ('error', 'view') GROUP BY ALL), "
    "w AS (SELECT c.service, d.day FROM c JOIN d ON d.day BETWEEN c.start AND c.stop WHERE isodow(d.day) < 6 AND (c.service + isodow(d.day)) % 2 = 0) SELECT service, count(*) AS days FROM (SELECT service, day FROM w WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.service = w.service AND x.day = w.day AND kind = 2) UNION SELECT service, day FROM x WHERE kind = 1) y GROUP BY service",
)
def service_days(n: Network):
    day = F.col("ts").cast("date")
    week = F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.when((i < 6) & ((F.col("service") + i) % 2 == 0), 1).otherwise(0))
    calendar = n.ev.groupBy(F.col("user_id").alias("service")).agg(F.min(day).alias("start"), F.max(day).alias("stop")).withColumn("week", week)
    marked = n.ev.where("event_type in ('error', 'view')")
    exceptions = marked.select(F.col("user_id").alias("service"), day.alias("day"), F.when(F.col("event_type") == "error", 2).otherwise(1).alias("kind"), F.col("event_id").alias("line"))
    return gtfs.service_days(calendar, exceptions, F.lit("2024-01-01").cast("date"), 30).groupBy("service").agg(F.count("*").alias("days"))


@op("s29_fare_table", "SELECT * FROM (VALUES (1::BIGINT, DATE '2026-04-01', 3, 160), (1, DATE '2026-04-01', 6, 160), (1, DATE '2026-04-01', 10, 210)) AS t(key, since, km, yen)")
def fare_table(n: Network):
    return html.fare_bands(html.cells(_table_pages(n), "key", "html"), "2026-06-01")


both("s30_fare_rules", "SELECT company, ord, max_km, yen FROM {band}")


@op("s31_guarded_scan", "SELECT 'markup' AS what, true AS refused UNION ALL SELECT 'cut', true UNION ALL SELECT 'good', false")
def guarded_scan(n: Network):
    good = tv3.pack([[(1, None, 5), (2, 9, None)]])
    out = []
    for what, data in (("markup", b"<html>"), ("cut", tv3.pack([[(1, None, 5), (2, 9, None)]], False)[:20]), ("good", good)):
        try:
            tv3.unpack(data)
            out.append((what, False))
        except ValueError:
            out.append((what, True))
    return n.spark.createDataFrame(out, "what string, refused boolean")


@op("s32_golden_diff", "SELECT trip_id, seq FROM conn WHERE false")
def golden_diff(n: Network):
    """Connections against a baseline from the packed files, which the window over stops has no part in."""
    stops = unpacked_stops(n)
    a = stops.select("trip_id", "seq", F.col("station_id").alias("dep_s"), F.col("dep").alias("dep_t"))
    b = stops.select("trip_id", (F.col("seq") - 1).alias("seq"), F.col("station_id").alias("arr_s"), F.col("arr").alias("arr_t"))
    golden = settled(a.join(b, ["trip_id", "seq"]).where("dep_s <> arr_s"), "golden")
    return differences(n.conn.select(golden.columns), golden)


both("s35_stop_patterns", "SELECT trip_id, @list(station_id; seq)@ AS pattern FROM {st} WHERE trip_id IN (SELECT trip_id FROM {trip} WHERE line = 'view') GROUP BY trip_id")
