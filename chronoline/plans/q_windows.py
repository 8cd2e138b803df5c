"""Connections, boards, windows, calendars and feeds."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoline.operators import feeds, timetable
from chronoline.plans.adapter import Network
from chronoline.plans.registry import both, op

op("j01_connections", "SELECT trip_id, seq, dep_s, dep_t, arr_s, arr_t FROM conn")(lambda n: timetable.connections(n.st))


@op("w01_unwrap_midnight", "SELECT user_id, event_id, CAST(t + sum(wrap) OVER (PARTITION BY user_id ORDER BY ts) AS BIGINT) AS at FROM (SELECT *, CASE WHEN t < lag(t) OVER (PARTITION BY user_id ORDER BY ts) THEN 1440 ELSE 0 END AS wrap FROM ev) x")
def unwrap(n: Network):
    return timetable.unwrap_midnight(n.ev, "user_id", "ts", "t", "at").select("user_id", "event_id", "at")


@op("w02_late_night", "SELECT trip_id, seq, dep_t, arr_t, 0 AS copy FROM conn UNION ALL SELECT trip_id, seq, dep_t + 1440, arr_t + 1440, 1 FROM conn WHERE dep_t < 360")
def late_night(n: Network):
    return timetable.with_late_night(n.conn).select("trip_id", "seq", "dep_t", "arr_t", "copy")


@op(
    "w04_collapse_repeats",
    """SELECT trip_id, CAST(island AS BIGINT) AS island, CAST(place AS BIGINT) AS place, min_by(t, seq) AS arr, max_by(t, seq) AS dep FROM (SELECT *, sum(new) OVER (PARTITION BY trip_id ORDER BY seq) AS island FROM (SELECT *, station_id // 25 AS place, CASE WHEN station_id // 25 = lag(station_id // 25) OVER (PARTITION BY trip_id ORDER BY seq) THEN 0 ELSE 1 END AS new FROM st) x) y GROUP BY trip_id, island, place""",
)
def collapse(n: Network):
    return timetable.collapse_repeats(n.st, "trip_id", "seq", F.floor(F.col("station_id") / 25))


@op(
    "w05_board_times",
    "SELECT trip_id, seq, CASE WHEN seq > 1 AND (seq = n_stops OR t <> t - seq % 2) THEN t - seq % 2 END AS arr, CASE WHEN seq < n_stops THEN t END AS dep FROM st",
)
def board_times(n: Network):
    s = n.st.select("trip_id", "seq", (F.col("t") - F.col("seq") % 2).alias("arr"), F.col("t").alias("dep"))
    return timetable.board_times(s, "trip_id", "seq").select("trip_id", "seq", F.col("arr2").alias("arr"), F.col("dep2").alias("dep"))


@op(
    "w06_line_segments",
    "SELECT user_id, CAST(island AS BIGINT) AS island, event_type, count(*) AS hops FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS island FROM (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) THEN 0 ELSE 1 END AS new FROM ev) x) y GROUP BY ALL",
)
def line_segments(n: Network):
    return timetable.islands(n.ev, ["user_id"], "ts", F.col("event_type")).groupBy("user_id", "island", "event_type").agg(F.count("*").alias("hops"))


both(
    "w07_fare_segments",
    """SELECT user_id, CAST(island AS BIGINT) AS island, grp, round(sum(value), 4) AS dist, max(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS upgraded FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS island FROM (SELECT *, CASE WHEN grp = lag(grp) OVER (PARTITION BY user_id ORDER BY ts) THEN 0 ELSE 1 END AS new FROM (SELECT e.*, k.company AS grp FROM {ev} e JOIN {company} k ON e.event_type = k.line) v) x) y GROUP BY user_id, island, grp""",
)
both(
    "w08_charge_units",
    """SELECT user_id, CAST(island AS BIGINT) AS island, event_type, round(sum(value), 4) AS km, max_by(station_id, station_id) AS premium FROM (SELECT *, sum(CASE WHEN event_type = prev AND station_id >= 20 AND ps >= 20 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts) AS island FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS prev, lag(station_id) OVER (PARTITION BY user_id ORDER BY ts) AS ps FROM {ev}) x) y GROUP BY user_id, island, event_type""",
)
both(
    "w09_ended_after_empties",
    """SELECT trip_id, min(seq) AS ended_at FROM (SELECT trip_id, island, min(seq) + 1 AS seq, count(*) AS run FROM (SELECT *, seq - row_number() OVER (PARTITION BY trip_id, station_id < 60 ORDER BY seq) AS island FROM {st}) x WHERE station_id < 60 GROUP BY trip_id, island) y WHERE run >= 2 GROUP BY trip_id""",
)


@op("w10_stride_pick", "SELECT line, trip_id FROM (SELECT line, trip_id, row_number() OVER (PARTITION BY line ORDER BY trip_id) - 1 AS r, count(*) OVER (PARTITION BY line) AS n FROM trip) x WHERE EXISTS (SELECT 1 FROM range(7) t(i) WHERE i * n // least(7, n) = r AND i < least(7, n))")
def stride_pick(n: Network):
    return timetable.stride_pick(n.trip, ["line"], ["trip_id"], 7).select("line", "trip_id")


@op(
    "w11_day_selection",
    """WITH g AS (SELECT line, trip_id, cal <> 1 AS matched, count(*) OVER (PARTITION BY line) AS n_all, count_if(cal <> 1) OVER (PARTITION BY line) AS m FROM trip),
    q AS (SELECT *, CAST(greatest(0, least(n_all, round_even(0.6 * n_all, 0)) - m) AS BIGINT) AS need FROM g),
    r AS (SELECT *, row_number() OVER (PARTITION BY line, matched ORDER BY trip_id) - 1 AS r, count(*) OVER (PARTITION BY line, matched) AS n FROM q)
    SELECT line, trip_id FROM r WHERE matched OR (need > 0 AND CASE WHEN need >= n THEN true ELSE (CAST(ceil(r * need / n) AS BIGINT) < need AND CAST(ceil(r * need / n) AS BIGINT) * n // need = r) END)""",
)
def day_selection(n: Network):
    return feeds.day_selection(n.trip.withColumn("matched", F.col("cal") != 1), "line", "matched", "trip_id", 0.6).select("line", "trip_id")


both(
    "w12_round_robin",
    "SELECT station_id, CAST(row_number() OVER (ORDER BY CASE WHEN r <= 3 THEN r ELSE 4 END, CASE WHEN r <= 3 THEN pref ELSE 0 END, n DESC, station_id) AS BIGINT) AS place FROM (SELECT s.station_id, s.pref, c.n, row_number() OVER (PARTITION BY s.pref ORDER BY c.n DESC, s.station_id) AS r FROM {stn} s JOIN (SELECT dep_s, count(*) AS n FROM {conn} GROUP BY dep_s) c ON s.station_id = c.dep_s) x",
)


@op("w13_budgeted_cover")
def budgeted_cover(n: Network):
    stops = n.st.join(n.trip, "trip_id").groupBy("line", "type_id").agg(F.collect_set("station_id").alias("stops"), F.countDistinct("trip_id").alias("trips"))
    return feeds.budgeted_cover(stops.select(F.concat_ws("-", "line", "type_id").alias("feed"), "trips", "stops"), 100)


both(
    "w14_lookahead",
    "SELECT trip_id, seq, CAST(count(*) OVER (PARTITION BY trip_id, side, island ORDER BY seq DESC) AS BIGINT) AS run FROM (SELECT *, station_id >= 50 AS side, seq - row_number() OVER (PARTITION BY trip_id, station_id >= 50 ORDER BY seq) AS island FROM {st}) x",
)


both(
    "w16_bridged_distance",
    """SELECT trip_id, round(sum(2 * 6371.0 * asin(sqrt(power(sin(radians(lat - pla) / 2), 2) + cos(radians(pla)) * cos(radians(lat)) * power(sin(radians(lon - plo) / 2), 2)))) * 1.06, 6) AS km
    FROM (SELECT trip_id, lat, lon, lag(lat) OVER (PARTITION BY trip_id ORDER BY seq) AS pla, lag(lon) OVER (PARTITION BY trip_id ORDER BY seq) AS plo FROM (SELECT s.trip_id, s.seq, p.lat, p.lon FROM {st} s JOIN {stn} p ON s.station_id = p.station_id AND p.station_id % 10 <> 3) k) x WHERE pla IS NOT NULL GROUP BY trip_id""",
)
# Departures are followed, 80 at most, until one takes more than 1.8 times as long as the one before and 30 minutes, or leaves on the next day.
both(
    "w17_last_good_service",
    """SELECT line, max(dep) AS last_good FROM (SELECT line, dep, r, sum(CASE WHEN dep >= 1440 OR arr - dep > 1.8 * prev + 30 THEN 1 ELSE 0 END) OVER (PARTITION BY line ORDER BY dep, trip_id ROWS UNBOUNDED PRECEDING) AS broken FROM (SELECT *, lag(arr - dep) OVER (PARTITION BY line ORDER BY dep, trip_id) AS prev, row_number() OVER (PARTITION BY line ORDER BY dep, trip_id) AS r FROM {leg}) x) y WHERE broken = 0 AND r <= 81 GROUP BY line""",
)
both("w18_visible_once", "SELECT dep_s, dep_t, line, arr_s, trip_id FROM (SELECT *, row_number() OVER (PARTITION BY dep_s, dep_t, line, type_id, arr_s ORDER BY trip_id, seq) AS r FROM {conn}) x WHERE r = 1")
both("w19_signature_once", "SELECT sig, min(trip_id) AS trip_id, count(*) AS n FROM (SELECT trip_id, @list(station_id; seq)@ AS sig FROM {st} GROUP BY trip_id) x GROUP BY sig")
both("w20_top_routes", "SELECT dep_s, line, n FROM (SELECT dep_s, line, n, row_number() OVER (PARTITION BY dep_s ORDER BY n DESC, line) AS r FROM (SELECT dep_s, line, count(*) AS n FROM {conn} GROUP BY dep_s, line) x) y WHERE r <= 2")
both("w21_earliest_per_direction", "SELECT dep_s, CAST(arr_s > dep_s AS BOOLEAN) AS up, min(dep_t) AS first_dep FROM {conn} WHERE dep_t >= 600 GROUP BY dep_s, arr_s > dep_s")
both(
    "j26_calendar_dates",
    "SELECT t.cal, d.day, count(*) AS trips FROM {trip} t JOIN (SELECT id AS day, CASE WHEN id % 7 < 5 THEN 1 WHEN id % 7 = 5 THEN 2 ELSE 4 END AS bit FROM range(56)) d ON (t.cal & d.bit) <> 0 GROUP BY t.cal, d.day",
    "SELECT t.cal, d.day, count(*) AS trips FROM trip t JOIN (SELECT i AS day, CASE WHEN i % 7 < 5 THEN 1 WHEN i % 7 = 5 THEN 2 ELSE 4 END AS bit FROM range(56) r(i)) d ON (t.cal & d.bit) <> 0 GROUP BY t.cal, d.day",
)


@op(
    "q06_timetable",
    """WITH dom AS (SELECT dep_s, arr_s, line FROM (SELECT dep_s, arr_s, line, row_number() OVER (PARTITION BY dep_s, arr_s ORDER BY count(*) DESC, line) AS r FROM conn GROUP BY dep_s, arr_s, line) x WHERE r = 1),
    busy AS (SELECT dep_s FROM conn GROUP BY dep_s ORDER BY count(*) DESC, dep_s LIMIT 1)
    SELECT dep_t, line, type_id, arr_s, trip_id FROM (SELECT c.dep_t, d.line, c.type_id, c.arr_s, c.trip_id, row_number() OVER (PARTITION BY c.dep_t, d.line, c.type_id, c.arr_s ORDER BY c.trip_id, c.seq) AS r FROM conn c JOIN dom d ON c.dep_s = d.dep_s AND c.arr_s = d.arr_s JOIN busy b ON c.dep_s = b.dep_s) x WHERE r = 1""",
)
def busiest_timetable(n: Network):
    top = n.conn.groupBy("dep_s").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dep_s").first()
    return timetable.timetable(n.conn, top.dep_s if top else -1).orderBy("dep_t", "line")


# -- calendars and feeds -------------------------------------------------------------------
@op("m20_day_key_match", "SELECT line, CASE WHEN sat = 0 THEN 'no-evidence' WHEN sat * 1.0 / nullif(wk, 0) < 0.1 THEN 'low-rho' ELSE 'volume' END AS kind FROM (SELECT line, count(DISTINCT CASE WHEN cal = 2 THEN trip_id // 100 END) AS sat, count(DISTINCT CASE WHEN cal = 1 THEN trip_id // 100 END) AS wk FROM trip GROUP BY line) x")
def day_key_match(n: Network):
    core = F.floor(F.col("trip_id") / 100)
    x = n.trip.groupBy("line").agg(F.countDistinct(F.when(F.col("cal") == 2, core)).alias("sat"), F.countDistinct(F.when(F.col("cal") == 1, core)).alias("wk"))
    return x.select("line", F.when(F.col("sat") == 0, "no-evidence").when(F.try_divide("sat", "wk") < 0.1, "low-rho").otherwise("volume").alias("kind"))


both("s25_day_type_keys", "SELECT DISTINCT CAST(trip_id / 100 AS BIGINT) AS key, cal FROM {trip} WHERE cal IN (2, 4)", "SELECT DISTINCT trip_id // 100 AS key, cal FROM trip WHERE cal IN (2, 4)")
both("m05_calendar_inheritance", "SELECT t.trip_id, coalesce(e.cal, CASE WHEN t.type_id = 1 THEN t.cal END, 7) AS cal FROM {trip} t LEFT JOIN (SELECT line, type_id, min_by(cal, trip_id) AS cal FROM {trip} WHERE type_id = 0 GROUP BY line, type_id) e ON t.line = e.line AND t.type_id = e.type_id")
both("m07_calendar_reset", "SELECT trip_id, CASE WHEN mode = 0 AND coalesce(max(CASE WHEN mode = 0 THEN cal & 6 END) OVER (PARTITION BY line), 0) = 0 THEN 7 ELSE cal END AS cal FROM {trip}")
both("m06_resume_state", "SELECT trip_id, max(done) AS done FROM (SELECT trip_id, 0 AS done FROM {trip} UNION ALL SELECT trip_id, 1 FROM {trip} WHERE cal = 1) x GROUP BY trip_id")
both("m04_scoped_merge", "SELECT DISTINCT c.trip_id FROM {conn} c WHERE EXISTS (SELECT 1 FROM (SELECT arr_s AS a, dep_s AS b FROM {conn} EXCEPT SELECT dep_s, arr_s FROM {conn}) w WHERE c.arr_s = w.a AND c.dep_s = w.b)")


# The holidays of 2026 as announced.
_HOLIDAYS = "01-01 fixed,01-12 monday,02-11 fixed,02-23 fixed,03-20 equinox,04-29 fixed,05-03 fixed,05-04 fixed,05-05 fixed,05-06 substitute,07-20 monday,08-11 fixed,09-21 monday,09-22 between,09-23 equinox,10-12 monday,11-03 fixed,11-23 fixed"


@op("ui_holidays", f"SELECT CAST('2026-' || x[1:5] AS DATE) AS day, x[7:] AS kind FROM (SELECT unnest(string_split('{_HOLIDAYS}', ',')) AS x) t")
def holidays(n: Network):
    return feeds.holidays(n.spark, 2026)


@op("x08_daily_counts", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def service_windows(n: Network):
    return n.ev.groupBy(F.date_trunc("day", "ts").alias("day"), "event_type").agg(F.count("*").alias("n"))


@op("x07_user_sessions", "SELECT user_id, CAST(s AS BIGINT) AS session, count(*) AS n FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 43200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT *, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) AS gap FROM events) x) y GROUP BY user_id, s")
def sessions(n: Network):
    w = W.partitionBy("user_id").orderBy("ts")
    at = F.col("ts").cast("timestamp").cast("double")
    gap = at - F.lag(at).over(w)
    return n.ev.withColumn("new", F.when(gap.isNull() | (gap > 43200), 1).otherwise(0)).withColumn("session", F.sum("new").over(w)).groupBy("user_id", "session").agg(F.count("*").alias("n"))
