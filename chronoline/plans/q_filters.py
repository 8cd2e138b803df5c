"""Filters, aggregates, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoline.functions import scalars
from chronoline.operators import timetable
from chronoline.plans.adapter import Network
from chronoline.plans.registry import both, op

# -- filters -------------------------------------------------------------------------------
both("f01_day_filter", "SELECT trip_id, seq, dep_s, arr_s, dep_t FROM {conn} WHERE (cal & 2) <> 0")
both(
    "f02_mode_filters",
    "SELECT CAST(user_bus AS STRING) AS what, n FROM (SELECT 'no_bus' AS user_bus, count(*) AS n FROM {conn} WHERE mode = 0 UNION ALL SELECT 'bus_only', count(*) FROM {conn} WHERE mode = 1 UNION ALL SELECT 'bus_only_wins', count(*) FROM {conn} WHERE CASE WHEN true THEN mode = 1 ELSE mode = 0 END) x",
)
both("f03_operator_filter", "SELECT trip_id, seq, line FROM {conn} WHERE mode = 0 AND line IN (SELECT line FROM {company} WHERE company IN ('Metro', 'Coast'))")
both("f03_operator_none", "SELECT trip_id, seq, line FROM {conn} WHERE mode = 0 AND line IN (SELECT line FROM {company} WHERE company = 'Nobody')")
both("f04_without_paid", "SELECT trip_id, seq, line, type_id FROM {conn} WHERE NOT (line = 'purchase' AND type_id = 2)")
both("f05_bans", "SELECT trip_id, seq FROM {conn} WHERE line NOT IN ('error', 'click') AND trip_id NOT IN (SELECT trip_id FROM {trip} WHERE type_id = 1 AND line = 'view')")
both("f10_travel_time", "SELECT dep_s, arr_s, count(*) AS n, min(arr_t - dep_t) AS least, max(arr_t - dep_t) AS most FROM {conn} WHERE arr_t - dep_t BETWEEN 1 AND 240 GROUP BY dep_s, arr_s")
both(
    "f11_stop_membership",
    "SELECT trip_id, kept, dropped FROM (SELECT trip_id, count_if(station_id < 90) AS kept, count_if(station_id >= 90) AS dropped FROM {st} GROUP BY trip_id) x WHERE kept >= 2",
)
both("f12_invariants", "SELECT count_if(seq < 1 OR seq > n_stops) AS bad_seq, count_if(station_id NOT BETWEEN 0 AND 99) AS bad_station, count_if(t NOT BETWEEN 0 AND 1439) AS bad_time, count(*) AS n FROM {st}")
both("f13_route_type", "SELECT t.trip_id, t.type_id, k.company FROM {trip} t JOIN {company} k ON t.line = k.line WHERE t.type_id = 2")
both("f14_all_in_box", "SELECT s.trip_id, bool_and(p.lat BETWEEN 35.0 AND 35.03 AND p.lon BETWEEN 139.0 AND 139.03) AS inside FROM {st} s JOIN {stn} p ON s.station_id = p.station_id GROUP BY s.trip_id")
both("f15_no_terminal_departures", "SELECT trip_id, seq, station_id, t FROM (SELECT *, lead(t) OVER (PARTITION BY trip_id ORDER BY seq) AS nxt FROM {st}) x WHERE nxt IS NOT NULL")
both("f16_invalid_journeys", "SELECT trip_id, dep, arr FROM {leg} WHERE NOT arr <= dep")
both("f17_noise_lines", "SELECT name FROM (SELECT DISTINCT line || CAST(type_id AS STRING) AS name FROM {trip}) x WHERE NOT regexp_like(name, '^(error|click)[01]$')", "SELECT name FROM (SELECT DISTINCT line || CAST(type_id AS STRING) AS name FROM trip) x WHERE NOT regexp_matches(name, '^(error|click)[01]$')")
both(
    "f18_geo_gate",
    "SELECT e.a, CAST(min(2 * 6371.0 * asin(sqrt(power(sin(radians(q.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(q.lat)) * power(sin(radians(q.lon - p.lon) / 2), 2)))) <= 0.5 AS BOOLEAN) AS near FROM {edge} e JOIN {stn} p ON e.a = p.station_id JOIN {stn} q ON e.b = q.station_id GROUP BY e.a",
)
both("f19_licence_allow", "SELECT p_partkey, p_brand FROM {part} WHERE p_brand IN (SELECT max(p_brand) FROM {part} UNION SELECT min(p_brand) FROM {part})")

_SERVICES = "(VALUES ('ＪＲ中央線', '特急あずさ'), ('東海道新幹線', 'のぞみ'), ('京急本線', '快速特急'), ('近鉄線', '特急'), ('ＪＲ線', '通勤特急'), ('南海線', '特急'), ('京王線', ''), ('南海線', 'ラピート')) AS s(line, kind)"
_PAID = ["あずさ", "ラピート", "しまかぜ"]


def _services(n: Network):
    return n.spark.sql(f"SELECT * FROM {_SERVICES}")


@op(
    "f06_service_class",
    f"""SELECT line, kind, CASE WHEN kind = '' THEN NULL WHEN line LIKE '%新幹線%' THEN 'shinkansen' WHEN regexp_matches(kind, '{scalars.FREE_EXPRESS}') THEN NULL
    WHEN kind LIKE '%あずさ%' OR kind LIKE '%ラピート%' OR kind LIKE '%しまかぜ%' THEN 'paid' WHEN kind LIKE '%特急%' AND (regexp_matches(line, '^(ＪＲ|JR)') OR line LIKE '近鉄%') THEN 'paid' END AS class FROM {_SERVICES}""",
)
def service_class(n: Network):
    s = _services(n)
    company = F.when(F.col("line").startswith("近鉄"), "近鉄").otherwise("")
    return s.select("line", "kind", scalars.service_class(F.col("line"), F.col("kind"), F.array(*map(F.lit, _PAID)), company).alias("class"))


@op("f07_legacy_paid", f"SELECT line, kind, kind <> '' AND NOT regexp_matches(kind, '^(快速|通勤|準)') AS paid FROM {_SERVICES}")
def legacy_paid(n: Network):
    return _services(n).select("line", "kind", ((F.col("kind") != "") & ~F.col("kind").rlike("^(快速|通勤|準)")).alias("paid"))


_TYPES = "(VALUES ('各停'), ('普通'), ('急行'), ('通勤急行'), (''), ('ホームライナー'), ('臨時快速'), ('京王ライナー'), ('ライナー')) AS s(kind)"


@op("f08_local_or_express", f"SELECT kind, kind IN ('各停', '各駅停車', '普通', '普通車', '') AS local FROM {_TYPES}")
def local_or_express(n: Network):
    return n.spark.sql(f"SELECT * FROM {_TYPES}").select("kind", F.col("kind").isin(scalars.LOCAL_TYPES).alias("local"))


@op("f09_weekday_only", f"SELECT kind, regexp_matches(kind, '{scalars.WEEKDAY_ONLY}') AS weekday_only FROM {_TYPES}")
def weekday_only(n: Network):
    return n.spark.sql(f"SELECT * FROM {_TYPES}").select("kind", F.col("kind").rlike(scalars.WEEKDAY_ONLY).alias("weekday_only"))


# -- aggregates ----------------------------------------------------------------------------
both("a01_departure_histogram", "SELECT dep_t, n, CAST(sum(n) OVER (ORDER BY dep_t) - n AS BIGINT) AS before FROM (SELECT dep_t, count(*) AS n FROM {conn} GROUP BY dep_t) x")


_SEEN = "min(trip_id * 10000 + seq)"


@op("a02_edge_majority", f"SELECT dep_s, arr_s, line FROM (SELECT dep_s, arr_s, line, row_number() OVER (PARTITION BY dep_s, arr_s ORDER BY count(*) DESC, {_SEEN}) AS r FROM conn WHERE mode = 0 GROUP BY dep_s, arr_s, line) x WHERE r = 1")
def edge_majority(n: Network):
    return timetable.edge_majority(n.conn.where("mode = 0"), F.struct("trip_id", "seq"))


@op(
    "a03_leg_label",
    f"""WITH dom AS (SELECT dep_s, arr_s, line FROM (SELECT dep_s, arr_s, line, row_number() OVER (PARTITION BY dep_s, arr_s ORDER BY count(*) DESC, {_SEEN}) AS r FROM conn GROUP BY dep_s, arr_s, line) x WHERE r = 1)
    SELECT trip_id, label FROM (SELECT c.trip_id, d.line AS label, row_number() OVER (PARTITION BY c.trip_id ORDER BY count(*) DESC, min(c.seq)) AS r FROM conn c JOIN dom d ON c.dep_s = d.dep_s AND c.arr_s = d.arr_s GROUP BY c.trip_id, d.line) y WHERE r = 1""",
)
def leg_label(n: Network):
    hops = n.conn.select("trip_id", "seq", "dep_s", "arr_s").join(timetable.edge_majority(n.conn, F.struct("trip_id", "seq")), ["dep_s", "arr_s"])
    return timetable.most_frequent(hops, ["trip_id"], "line", "label", "seq")


both(
    "a04_ghost_lines",
    "SELECT dep_s, arr_s, line, n FROM (SELECT dep_s, line, arr_s, n, max(n) OVER (PARTITION BY dep_s, arr_s) AS top FROM (SELECT dep_s, arr_s, line, count(*) AS n FROM {conn} GROUP BY dep_s, arr_s, line) x) y WHERE n >= 0.15 * top",
)
# Lines beside the dominant one, which is the first seen on ties, take 0.05 minutes more; without a sane time, two minutes.
both(
    "a05_median_time",
    "SELECT dep_s, arr_s, line, CAST(bround(coalesce(mid, 2), 0) + CASE WHEN row_number() OVER (PARTITION BY dep_s, arr_s ORDER BY n DESC, seen) > 1 THEN 0.05E0 ELSE 0 END AS DOUBLE) AS minutes FROM (SELECT dep_s, arr_s, line, count(*) AS n, min(trip_id * 10000 + seq) AS seen, median(CASE WHEN arr_t - dep_t BETWEEN 1 AND 240 THEN arr_t - dep_t END) AS mid FROM {conn} GROUP BY dep_s, arr_s, line) x",
    "SELECT dep_s, arr_s, line, CAST(round_even(coalesce(mid, 2), 0) + CASE WHEN row_number() OVER (PARTITION BY dep_s, arr_s ORDER BY n DESC, seen) > 1 THEN 0.05 ELSE 0 END AS DOUBLE) AS minutes FROM (SELECT dep_s, arr_s, line, count(*) AS n, min(trip_id * 10000 + seq) AS seen, median(CASE WHEN arr_t - dep_t BETWEEN 1 AND 240 THEN arr_t - dep_t END) AS mid FROM conn GROUP BY dep_s, arr_s, line) x",
)


@op("a06_common_type", "SELECT line, common FROM (SELECT line, type_id AS common, row_number() OVER (PARTITION BY line ORDER BY count(*) DESC, min(trip_id)) AS r FROM trip GROUP BY line, type_id) x WHERE r = 1")
def common_type(n: Network):
    return timetable.most_frequent(n.trip, ["line"], "type_id", "common", "trip_id")


both("a07_calendar_or", "SELECT t.line, bit_or(t.cal) AS bits FROM {trip} t GROUP BY t.line")
both("a08_calendar_histogram", "SELECT cal, count(*) AS n FROM {trip} GROUP BY cal")
both("a09_line_day_counts", "SELECT line, count(*) AS total, count_if((cal & 1) <> 0) AS weekday, count_if((cal & 2) <> 0) AS saturday, count_if((cal & 4) <> 0) AS holiday FROM {trip} GROUP BY line")
both("a10_ratio_buckets", "SELECT bucket, count(*) AS n_stations, CAST(sum(n) AS BIGINT) AS trips FROM (SELECT station_id, count(*) AS n, CAST(floor(count_if(t >= 720) * 10.0 / count(*)) AS INT) AS bucket FROM {st} GROUP BY station_id) x GROUP BY bucket")
both(
    "a11_threshold_sweep",
    "SELECT h.h, count_if(x.ratio < h.h / 10.0) AS below, CAST(sum(CASE WHEN x.ratio < h.h / 10.0 THEN x.n ELSE 0 END) AS BIGINT) AS trips FROM (SELECT station_id, count(*) AS n, count_if(t >= 720) * 1.0 / count(*) AS ratio FROM {st} GROUP BY station_id) x CROSS JOIN (VALUES (1), (3), (5), (7), (9)) AS h(h) GROUP BY h.h",
)
both("a12_station_day_counts", "SELECT c.dep_s, count_if(c.cal = 1) AS weekday, count_if(c.cal = 2) AS saturday, count_if(c.cal = 4) AS holiday FROM {conn} c GROUP BY c.dep_s HAVING count_if(c.cal = 1) > 0 AND count_if(c.cal <> 1) > 0")
both("a13_line_extent", "SELECT line, count(DISTINCT trip_id) AS trips, count(DISTINCT dep_s) AS stations, min(dep_t) AS first_dep, max(dep_t) AS last_dep FROM {conn} GROUP BY line")
both("a14_busiest_station", "SELECT line, dep_s, n FROM (SELECT line, dep_s, n, row_number() OVER (PARTITION BY line ORDER BY n DESC, dep_s) AS r FROM (SELECT line, dep_s, count(*) AS n FROM {conn} GROUP BY line, dep_s) x) y WHERE r = 1")
both(
    "a15_representative_day",
    "SELECT day, trips FROM (SELECT CAST(trip_id % 100 AS INT) AS day, count(*) AS trips, row_number() OVER (ORDER BY count(*) DESC, CAST(trip_id % 100 AS INT)) AS r FROM {trip} GROUP BY CAST(trip_id % 100 AS INT)) x WHERE r = 1",
)
both("a16_centroids", "SELECT pref, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, count(*) AS n FROM {stn} GROUP BY pref")
both("a17_distinct_cores", "SELECT line, count(DISTINCT CAST(trip_id / 100 AS INT)) AS cores FROM {trip} GROUP BY line", "SELECT line, count(DISTINCT trip_id // 100) AS cores FROM trip GROUP BY line")
both("a18_volume_ratio", "SELECT line, round(count_if(cal = 2) * 1.0E0 / nullif(count_if(cal = 1), 0), 6) AS rho FROM {trip} GROUP BY line", "SELECT line, CAST(round(count_if(cal = 2) / nullif(count_if(cal = 1), 0), 6) AS DOUBLE) AS rho FROM trip GROUP BY line")
both("a19_station_lines", "SELECT dep_s, @list(line; line)@ AS lines FROM (SELECT DISTINCT dep_s, line FROM {conn}) x GROUP BY dep_s")
both("a20_operators", "SELECT k.company, count(*) AS lines FROM (SELECT DISTINCT line FROM {trip} WHERE mode = 0) t JOIN {company} k ON t.line = k.line WHERE k.company <> 'Coast' GROUP BY k.company")
both("a21_fare_sums", "SELECT company, CAST(sum(yen) AS BIGINT) AS total, min(yen) AS least, max(yen) AS most FROM {band} GROUP BY company")
both("a22_licence_counts", "SELECT p_brand, count(*) AS n FROM {part} GROUP BY p_brand")
both("a23_fingerprint", "SELECT line, sha2(@list(sig; sig)@, 256) AS digest FROM (SELECT line, CAST(trip_id AS STRING) || ':' || CAST(min(dep_t) AS STRING) AS sig FROM {conn} GROUP BY line, trip_id) x GROUP BY line", "SELECT line, sha256(string_agg(sig, ',' ORDER BY sig)) AS digest FROM (SELECT line, trip_id || ':' || min(dep_t) AS sig FROM conn GROUP BY line, trip_id) x GROUP BY line")

# -- sorts and set operations --------------------------------------------------------------
@op("o01_stable_order", "SELECT trip_id, seq, CAST(row_number() OVER (ORDER BY dep_t, trip_id, seq) AS BIGINT) AS place FROM conn")
def stable_order(n: Network):
    return timetable.placed(n.conn.select("trip_id", "seq", "dep_t"), ["dep_t", "trip_id", "seq"], "place").drop("dep_t")


@op("o02_journey_ranking", "SELECT trip_id, CAST(rank() OVER (ORDER BY arr + 4 * hops, hops, arr, dep DESC) AS BIGINT) AS place FROM leg")
def journey_ranking(n: Network):
    legs = n.leg.select("trip_id", "hops", "arr", "dep").withColumn("cost", F.col("arr") + 4 * F.col("hops"))
    return timetable.placed(legs, ["cost", "hops", "arr", F.desc("dep")], "place", ties=True).select("trip_id", "place")


@op("o04_resolution_order", "SELECT trip_id, CAST(rank() OVER (ORDER BY arr, dep DESC, hops) AS BIGINT) AS place FROM leg")
def resolution_order(n: Network):
    return timetable.placed(n.leg.select("trip_id", "arr", "dep", "hops"), ["arr", F.desc("dep"), "hops"], "place", ties=True).select("trip_id", "place")


both("o05_timetable_order", "SELECT trip_id, seq, CAST(row_number() OVER (PARTITION BY dep_s ORDER BY dep_t, line, trip_id, seq) AS BIGINT) AS place FROM {conn}")


@op("o06_locale_sort", "SELECT name, CAST(row_number() OVER (ORDER BY name) AS BIGINT) AS place FROM (VALUES ('あさひ'), ('かすが'), ('さくら'), ('たかお')) AS t(name)")
def locale_sort(n: Network):
    from pyspark.sql import Window

    names = n.spark.createDataFrame([("たかお",), ("あさひ",), ("さくら",), ("かすが",)], "name string")
    return names.withColumn("place", F.row_number().over(Window.orderBy(F.expr("name COLLATE ja"))).cast("long"))


both("o07_lower_bound", "SELECT q.since, min(c.dep_t) AS first_dep, count(c.dep_t) AS later FROM (VALUES (0), (360), (720), (1080), (1439)) AS q(since) LEFT JOIN {conn} c ON c.dep_t >= q.since GROUP BY q.since")
both("o08_feature_sort", "SELECT dep_s, n FROM (SELECT dep_s, n, row_number() OVER (ORDER BY n DESC, dep_s) AS r FROM (SELECT dep_s, count(*) AS n FROM {conn} GROUP BY dep_s) x) y WHERE r <= 20")
both("u01_service_keys", "SELECT trip_id, 'minus' AS what FROM (SELECT trip_id FROM {trip} WHERE cal = 1 EXCEPT SELECT trip_id FROM {trip} WHERE type_id = 0) x UNION ALL SELECT trip_id, 'union' FROM (SELECT trip_id FROM {trip} WHERE cal = 2 UNION SELECT trip_id FROM {trip} WHERE type_id = 1) y")
both("u02_footpath_diff", "SELECT 'added' AS what, a, b FROM (SELECT a, b FROM {foot} WHERE walk <= 9 EXCEPT SELECT a, b FROM {foot} WHERE a % 2 = 0) x UNION ALL SELECT 'removed', a, b FROM (SELECT a, b FROM {foot} WHERE a % 2 = 0 EXCEPT SELECT a, b FROM {foot} WHERE walk <= 9) y")


def _merged(ev):
    from chronoline.operators import graph

    p = ev.select(F.col("trip_id").alias("t"), F.col("station_id").alias("s")).distinct()
    links = p.join(p.groupBy("t").agg(F.min("s").alias("m")), "t").select(F.col("m").alias("a"), F.col("s").alias("b"))
    return graph.components(links).select(F.col("node").alias("s"), F.col("component").alias("merged"))


@op(
    "u03_overlap_merge",
    "WITH RECURSIVE pairs AS (SELECT DISTINCT trip_id AS t, station_id AS s FROM ev), near AS (SELECT DISTINCT a.s AS a, b.s AS b FROM pairs a JOIN pairs b ON a.t = b.t), r(s, seen) AS (SELECT DISTINCT s, s FROM pairs UNION SELECT r.s, near.b FROM r JOIN near ON r.seen = near.a) SELECT s, min(seen) AS merged FROM r GROUP BY s",
)
def overlap_merge(n: Network):
    """Station groups that share a trip, merged until none overlaps."""
    return _merged(n.ev)


both("u04_sibling_minutes", "SELECT DISTINCT dep_s, dep_t FROM {conn} c WHERE line = 'view' AND NOT EXISTS (SELECT 1 FROM {conn} d WHERE d.line = 'click' AND d.dep_s = c.dep_s AND d.dep_t = c.dep_t)")
both("u05_company_overlap", "SELECT x.a, x.b, count(*) AS shared FROM (SELECT DISTINCT e.a, e.b, k.company FROM {edge} e JOIN {conn} c ON c.dep_s = e.a JOIN {company} k ON c.line = k.line) x JOIN (SELECT DISTINCT c.dep_s, k.company FROM {conn} c JOIN {company} k ON c.line = k.line) y ON x.b = y.dep_s AND x.company = y.company GROUP BY x.a, x.b")
both("u06_used_stops", "SELECT line, count(DISTINCT s) AS stops FROM (SELECT line, dep_s AS s FROM {conn} UNION SELECT line, arr_s FROM {conn}) x GROUP BY line")
both("u07_line_station_diff", "SELECT s.station_id, l.line FROM {stn} s CROSS JOIN (SELECT DISTINCT line FROM {trip}) l WHERE NOT EXISTS (SELECT 1 FROM {conn} c WHERE c.dep_s = s.station_id AND c.line = l.line AND c.cal = 2)")
both(
    "u08_baseline_diff",
    "SELECT coalesce(a.dep_s, b.dep_s) AS station, CASE WHEN a.n IS NULL THEN 'appeared' WHEN b.n IS NULL THEN 'lost' WHEN b.n < a.n THEN 'worse' WHEN b.n > a.n THEN 'better' ELSE 'same' END AS verdict FROM (SELECT dep_s, count(*) AS n FROM {conn} WHERE line = 'view' GROUP BY dep_s) a FULL OUTER JOIN (SELECT dep_s, count(*) AS n FROM {conn} WHERE line = 'click' GROUP BY dep_s) b ON a.dep_s = b.dep_s",
)
both("u09_wanted_edges", "SELECT arr_s AS a, dep_s AS b FROM {conn} EXCEPT SELECT dep_s, arr_s FROM {conn}")
