"""Fares, express charges, names, clusters and feed choice by the operators' own rules.

The tariff below holds published fares of some companies; expected values are those that
passengers pay, or what the rule says for the given names.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoline.functions import kana, names, scalars
from chronoline.operators import boards, feeds, geocode, platforms, spatial, tickets
from chronoline.plans.adapter import Network
from chronoline.plans.registry import op

# Published fares.  Bands are (kilometres up to, yen).
TARIFF = tickets.Tariff(
    bands={
        "JR東日本": [(3, 155), (6, 199), (10, 209), (15, 253), (20, 341), (25, 440), (30, 528), (35, 616), (40, 715), (45, 803), (50, 902)],
        "JR西日本": [(3, 150), (6, 190), (10, 200), (15, 240), (20, 330), (25, 420), (30, 510), (35, 590), (40, 680), (45, 770), (50, 860), (60, 990), (70, 1170), (80, 1340), (90, 1520), (100, 1690)],
        "JR西日本電特": [(3, 150), (6, 180), (10, 200), (15, 240), (20, 320), (25, 410), (30, 490), (35, 580), (40, 660), (45, 750), (50, 840), (60, 960)],
        "東急": [(3, 140), (7, 180), (11, 227), (13, 250), (14, 250), (15, 250), (20, 288), (21, 309), (23, 309), (25, 309), (26, 347), (30, 347), (35, 381)],
        "東京モノレール": [(2, 177), (5, 229), (8, 317), (11, 388), (14, 458), (18, 519)],
        "京成": [(3, 146), (5, 167), (10, 199), (15, 272), (20, 335), (25, 387), (30, 450), (35, 502), (40, 555), (45, 618), (50, 681), (55, 743), (60, 796), (65, 859), (70, 912)],
        "京成スカイアクセス": [(3, 188), (5, 279), (8, 330), (10, 379), (12, 427), (15, 475), (18, 546), (21, 617), (26, 720), (30, 768), (35, 811), (40, 906), (45, 936), (53, 1110), (59, 1190), (63, 1235), (76, 1300)],
        "東京メトロ": [(6, 178), (11, 209), (19, 252), (27, 293), (40, 324)],
        "都営地下鉄": [(4, 178), (9, 220), (15, 272), (21, 325), (27, 377)],
    },
    scale={"京成": 0.94},
    special={("大阪", "京都"): 580, ("大阪", "三ノ宮(ＪＲ)"): 420, ("大阪", "姫路"): 1460, ("天王寺", "和歌山"): 900},
    surcharges=[
        {"label": "京成空港加算", "company": "京成", "stations": ["成田空港", "成田空港(空港第２ビル)"], "yen": 140},
        {"label": "京急空港加算", "stations": ["羽田空港第１・第２ターミナル(京急)", "羽田空港第３ターミナル(京急)"], "yen": 50},
        {"label": "南海空港加算", "company": "南海", "stations": ["関西空港"], "yen": 190},
    ],
    discounts=[{"label": "メトロ⇄都営乗継割引", "companies": ["東京メトロ", "都営地下鉄"], "yen": -70}],
    bullet_lines=[("西九州新幹線", "nishikyushu"), ("山陽・九州", "sanyo_kyushu"), ("東海道・山陽・九州", "tokaido"), ("東海道・山陽", "tokaido"), ("東海道", "tokaido"), ("東北・北海道", "tohoku"), ("上越", "joetsu"), ("北陸", "hokuriku"), ("山形", "yamagata"), ("秋田", "akita")],
    bullet={
        "tokaido": [(60, 2460), (120, 2960), (180, 3400), (250, 3930), (300, 4270), (370, 4830), (410, 5170), (460, 5380), (520, 5700), (560, 5810), (620, 5810), (650, 6330), (740, 6860), (810, 6860), (900, 7420), (990, 8050), (1030, 8600), (9999, 9130)],
        "sanyo": [(100, 2530), (180, 3280), (280, 4500), (360, 4920), (480, 5490), (630, 5810), (9999, 6340)],
        "sanyo_kyushu": [(60, 1730), (120, 3000), (160, 3370), (200, 4000), (250, 4490), (9999, 4940)],
        "tohoku": [(81, 2570), (110, 2990), (160, 3320), (227, 4200), (273, 4200), (310, 4950), (355, 4950), (420, 5480), (450, 5480), (540, 5810), (610, 5810), (640, 6170), (680, 6170), (9999, 6690)],
        "joetsu": [(65, 2570), (110, 2990), (160, 3320), (210, 3320), (260, 4200), (300, 4200), (9999, 4950)],
        "hokuriku": [(110, 2990), (150, 3320), (225, 4200), (285, 4830), (360, 5810), (400, 6250), (460, 6780), (540, 6920), (9999, 7070)],
        "akita": [(560, 7000), (600, 7210), (640, 7520), (9999, 7970)],
    },
    premium={"はやぶさ": [(300, 320), (500, 530), (9999, 640)]},
    by_name={"スカイライナー": 1300, "ミュースカイ": 450, "京王ライナー": 410},
    conventional={"JR": [(25, 1290), (50, 1290), (100, 1730), (150, 2390), (200, 2900), (300, 3070), (400, 3490), (9999, 3930)], "近鉄": [(40, 520), (60, 920), (80, 1340), (110, 1340), (140, 1640), (180, 1930), (9999, 2030)], "小田急": [(20, 750), (40, 900), (60, 1200), (9999, 1200)]},
    seat_bullet={"tokaido": [(200, -750), (400, -760), (600, -850), (900, -920), (9999, -990)], "sanyo": [(200, -750), (400, -760), (9999, -850)], "sanyo_kyushu": [(9999, -540)], "tohoku": [(9999, -530)], "joetsu": [(9999, -530)], "hokuriku": [(9999, -530)]},
    seat_conventional={"JR": [(9999, -530)]},
    reserved_only=["はやぶさ", "はやて", "こまち", "かがやき", "つばさ", "あずさ", "かいじ", "ひたち"],
)
# Rides (journey, line, kind of train, operator, kilometres, mileposts) and the reserved and free charge.
_RIDES = [
    ("東京-新大阪", 1, "東海道新幹線", "のぞみ", "JR", 0.0, 0.0, 552.6), ("東京-名古屋", 1, "東海道新幹線", "のぞみ", "JR", 0.0, 0.0, 366.0), ("東京-広島", 1, "東海道・山陽新幹線", "のぞみ", "JR", 0.0, 0.0, 894.2),
    ("新大阪-博多", 1, "東海道・山陽新幹線", "のぞみ", "JR", 0.0, 552.6, 1174.9), ("博多-鹿児島中央", 1, "山陽・九州新幹線", "みずほ", "JR", 0.0, 1174.9, 1463.8), ("東京-仙台", 1, "東北・北海道新幹線", "はやぶさ", "JR", 0.0, 0.0, 351.8),
    ("東京-新潟", 1, "上越新幹線", "とき", "JR", 0.0, 0.0, 333.9), ("東京-金沢", 1, "北陸新幹線", "かがやき", "JR", 0.0, 0.0, 450.5), ("東京-長野", 1, "北陸新幹線", "あさま", "JR", 0.0, 0.0, 222.4), ("東京-秋田", 1, "秋田新幹線", "こまち", "JR", 0.0, 0.0, 662.6),
    ("新宿-甲府", 1, "ＪＲ中央線", "かいじ", "JR", 123.8, None, None), ("新宿-松本", 1, "ＪＲ中央線", "あずさ", "JR", 225.1, None, None), ("上野-成田空港", 1, "京成本線", "スカイライナー", "京成", 69.3, None, None),
    ("東京-名古屋-新大阪", 1, "東海道新幹線", "のぞみ", "JR", 0.0, 0.0, 366.0), ("東京-名古屋-新大阪", 2, "東海道新幹線", "ひかり", "JR", 0.0, 366.0, 552.6),
    ("名古屋-金沢", 1, "東海道新幹線", "ひかり", "JR", 0.0, 366.0, 445.9), ("名古屋-金沢", 2, "ＪＲ北陸線", "しらさぎ特急", "JR", 176.6, None, None), ("新宿-渋谷", 1, "ＪＲ山手線", "普通", "JR", 3.4, None, None),
    ("仙台-盛岡-青森", 1, "東北・北海道新幹線", "やまびこ", "JR", 0.0, 351.8, 535.3), ("仙台-盛岡-青森", 2, "東北・北海道新幹線", "はやぶさ", "JR", 0.0, 535.3, 713.7),
]
_CHARGES = [
    ("東京-新大阪", 5810, 4960), ("東京-名古屋", 4830, 4070), ("東京-広島", 7420, 6500), ("新大阪-博多", 5810, 4960), ("博多-鹿児島中央", 4940, 4400), ("東京-仙台", 5480, 5480), ("東京-新潟", 4950, 4420), ("東京-金沢", 6780, 6780),
    ("東京-長野", 4200, 3670), ("東京-秋田", 7970, 7970), ("新宿-甲府", 2390, 2390), ("新宿-松本", 3070, 3070), ("上野-成田空港", 1300, 1300), ("東京-名古屋-新大阪", 5810, 4960), ("名古屋-金沢", 2960 + 1450, 2210 + 1180), ("仙台-盛岡-青森", 5480 + 530, 5480 + 530),
]


def _values(rows, cols: str) -> str:
    cell = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({cols})"


def _rides(n: Network):
    rides = n.spark.createDataFrame(_RIDES, "journey string, ord int, line string, type string, company string, km double, a double, b double")
    paid = F.array(*map(F.lit, scalars.PAID_NAMES))
    return rides.withColumn("kind", scalars.service_class(F.col("line"), F.col("type"), paid, F.col("company")))


@op("d08_express_charges", f"SELECT journey, CAST(reserved AS BIGINT) AS reserved, CAST(free AS BIGINT) AS free FROM {_values(_CHARGES, 'journey, reserved, free')}")
def express_charges(n: Network):
    rides = _rides(n)
    sums = [tickets.express_charges(rides, TARIFF, s).groupBy("journey").agg(F.sum("yen").alias(c)) for s, c in ((tickets.RESERVED, "reserved"), (tickets.NONRESERVED, "free"))]
    return sums[0].join(sums[1], "journey")


_UNITS = [("東京-名古屋-新大阪", 552.6, "のぞみ"), ("仙台-盛岡-青森", 361.9, "はやぶさ"), ("東京-仙台", 351.8, "はやぶさ")]


@op("w08_express_units", f"SELECT journey, CAST(km AS DOUBLE) AS km, type FROM {_values(_UNITS, 'journey, km, type')}")
def express_units(n: Network):
    wanted = F.col("journey").isin([u[0] for u in _UNITS])
    return tickets.express_units(_rides(n).where(wanted), TARIFF).select("journey", F.explode("units").alias("u")).select("journey", F.round("u.km", 6).alias("km"), "u.type")


# Single rides (from, to, company, kilometres, yen).
_TICKETS = [
    ("上野", "日暮里", "JR東日本", 2.2, 155), ("柏", "東京", "JR東日本", 32.7, 616), ("東京", "横浜", "JR東日本", 28.8, 528), ("渋谷", "横浜", "東急", 24.2, 309), ("渋谷", "自由が丘", "東急", 7.0, 180),
    ("浜松町", "羽田空港第２ターミナル", "東京モノレール", 17.8, 519), ("船橋", "京成上野", "京成", 26.5, 387), ("x", "y", "unknown", 3.3, 83),
]


@op("d02_published_fares", f"SELECT a, b, CAST(yen AS INT) AS yen FROM {_values([(a, b, yen) for a, b, _, _, yen in _TICKETS], 'a, b, yen')}")
def published_fares(n: Network):
    rides = n.spark.createDataFrame([t[:4] for t in _TICKETS], "a string, b string, company string, km double")
    return rides.select("a", "b", tickets.ticket(TARIFF, F.col("company"), F.col("km")).alias("yen"))


# Stations: name, place, companies.
_STATIONS = {
    "大阪": (34.7025, 135.4959, ["JR"]), "京都": (34.9858, 135.7588, ["JR", "近鉄"]), "高槻": (34.8517, 135.6176, ["JR"]), "敦賀": (35.6447, 136.0733, ["JR"]), "押上": (35.7105, 139.8130, ["京成", "都営地下鉄", "東京メトロ"]), "浅草": (35.7119, 139.7967, ["都営地下鉄"]),
    "日本橋": (35.6820, 139.7740, ["都営地下鉄", "東京メトロ"]), "大手町": (35.6846, 139.7660, ["東京メトロ"]), "青砥": (35.7459, 139.8560, ["京成"]), "成田空港": (35.7640, 140.3864, ["京成", "京成スカイアクセス", "JR"]), "印旛日本医大": (35.7860, 140.2030, ["京成スカイアクセス"]), "X": (None, None, []),
}
_JOURNEYS = [
    ("特定", 1, 0, "ＪＲ京都線", "JR", ["大阪", "高槻", "京都"]), ("電特", 1, 0, "ＪＲ京都線", "JR", ["高槻", "京都"]), ("圏外", 1, 0, "ＪＲ湖西線", "JR", ["京都", "敦賀"]),
    ("乗継", 1, 0, "都営浅草線", "都営地下鉄", ["浅草", "日本橋"]), ("乗継", 2, 0, "東京メトロ東西線", "東京メトロ", ["日本橋", "大手町"]), ("直通", 1, 0, "都営浅草線", "都営地下鉄", ["浅草", "X", "押上", "青砥"]),
    ("空港", 1, 0, "京成本線", "京成", ["押上", "青砥", "成田空港"]), ("SA", 1, 0, "京成本線", "京成", ["押上", "青砥"]), ("SA", 2, 0, "京成成田空港線", "京成スカイアクセス", ["青砥", "印旛日本医大", "成田空港"]), ("バス", 1, 1, "系統1", "", ["大阪", "京都"]),
]


def _legs(n: Network):
    rows = [(j, o, m, None, None, line, c, 0.0, None, None, [(s, *_STATIONS[s]) for s in stops]) for j, o, m, line, c, stops in _JOURNEYS]
    return n.spark.createDataFrame(rows, "journey string, ord int, mode int, kind string, type string, line string, company string, km double, a double, b double, stops array<struct<name:string,lat:double,lon:double,companies:array<string>>>")


_TOTALS = [("特定", 580, "JR西日本(特定)"), ("電特", 410, "JR西日本電特"), ("圏外", 1520, "JR西日本"), ("乗継", 220 + 178 - 70, "メトロ⇄都営乗継割引"), ("直通", 178 + 199, "京成"), ("空港", 743 + 140, "京成"), ("SA", 1190, "京成スカイアクセス"), ("バス", 0, None)]


@op("d01_tickets", f"SELECT journey, CAST(total AS BIGINT) AS total, label FROM {_values(_TOTALS, 'journey, total, label')}")
def journey_tickets(n: Network):
    return tickets.journey_fare(_legs(n), TARIFF).select("journey", "total", F.get("breakdown", F.lit(0))["label"].alias("label"))


_PARTS = [("直通", 0, "都営地下鉄", "浅草,X,押上"), ("直通", 1, "京成", "押上,青砥"), ("乗継", 0, "都営地下鉄", "浅草,日本橋"), ("乗継", 0, "東京メトロ", "日本橋,大手町")]


@op("w15_company_parts", f"SELECT journey, CAST(part AS INT) AS part, company, stops FROM {_values(_PARTS, 'journey, part, company, stops')}")
def company_parts(n: Network):
    legs = _legs(n).where(F.col("journey").isin("直通", "乗継")).withColumn("bullet", F.lit(False))
    return tickets.leg_parts(legs).select("journey", "part", "company", F.array_join(F.transform("stops", lambda s: s["name"]), ",").alias("stops"))


# A whole table through the same rules: every trip of the fixture is a journey of one leg.
_SETS = "CASE WHEN station_id < 40 THEN 'Metro' WHEN station_id < 70 THEN 'Ridge' ELSE 'Coast' END"


@op(
    "w15_leg_parts",
    f"""WITH RECURSIVE s AS (SELECT trip_id, seq, {_SETS} AS co FROM st), h AS (SELECT a.trip_id, a.seq, a.co AS x, b.co AS y, k.company AS label FROM s a JOIN s b ON a.trip_id = b.trip_id AND b.seq = a.seq + 1 JOIN trip t ON t.trip_id = a.trip_id JOIN company k ON k.line = t.line),
    w AS (SELECT trip_id, seq, CASE WHEN x = y THEN x WHEN label IN (x, y) THEN label ELSE label END AS co FROM h WHERE seq = 1 UNION ALL SELECT h.trip_id, h.seq, CASE WHEN h.x = h.y THEN h.x WHEN h.label IN (h.x, h.y) THEN h.label ELSE w.co END FROM w JOIN h ON h.trip_id = w.trip_id AND h.seq = w.seq + 1),
    i AS (SELECT *, seq - row_number() OVER (PARTITION BY trip_id, co ORDER BY seq) AS island FROM w)
    SELECT trip_id, string_agg(co || ':' || n, ' ' ORDER BY first) AS parts FROM (SELECT trip_id, co, island, min(seq) AS first, count(*) AS n FROM i GROUP BY ALL) x GROUP BY trip_id""",
)
def leg_parts(n: Network):
    co = F.when(F.col("station_id") < 40, "Metro").when(F.col("station_id") < 70, "Ridge").otherwise("Coast")
    stop = F.struct(F.col("station_id").cast("string").alias("name"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), F.array(co).alias("companies"))
    stops = n.st.groupBy("trip_id").agg(F.sort_array(F.collect_list(F.struct("seq", stop.alias("s"))))["s"].alias("stops"))
    legs = stops.join(n.trip, "trip_id").join(n.company, "line").where(F.size("stops") > 1)
    parts = tickets.leg_parts(legs.select(F.col("trip_id").alias("journey"), F.lit(1).alias("ord"), "company", F.lit(False).alias("bullet"), F.lit(0.0).alias("km"), "stops"))
    text = F.struct("part", F.concat_ws(":", "company", F.size("stops") - 1).alias("p"))
    return parts.groupBy(F.col("journey").alias("trip_id")).agg(F.array_join(F.sort_array(F.collect_list(text))["p"], " ").alias("parts"))


# -- service classes and names -------------------------------------------------------------
_KINDS = [("ＪＲ中央線", "あずさ", "paid"), ("ＪＲ中央線", "特急", "paid"), ("京急本線", "特急", None), ("京成本線", "スカイライナー", "paid"), ("東海道新幹線", "のぞみ", "shinkansen"), ("京王線", "準特急", None), ("近鉄奈良線", "特急", "paid"), ("小田急線", "はこね", "paid"), ("ＪＲ奈良線", "みやこ路快速", None), ("ＪＲ湖西線", "サンダーバード", "paid"), ("ＪＲ中央線", "", None)]


@op("f06_paid_trains", f"SELECT line, kind, class FROM {_values(_KINDS, 'line, kind, class')}")
def paid_trains(n: Network):
    rows = n.spark.createDataFrame([k[:2] for k in _KINDS], "line string, kind string")
    company = F.when(F.col("line").startswith("近鉄"), "近鉄").otherwise("")
    return rows.select("line", "kind", scalars.service_class(F.col("line"), F.col("kind"), F.array(*map(F.lit, scalars.PAID_NAMES)), company).alias("class"))


def _named(name: str, rows: list[tuple], of, cols: str = "name, value"):
    """Register a function of one text over given texts."""

    def run(n: Network):
        given = n.spark.createDataFrame([(r[0],) for r in rows], "name string")
        return given.select("name", of(F.col("name")).alias("value"))

    op(name, f"SELECT name, value FROM {_values(rows, cols)}")(run)


_named("x09_search_key", [("羽田空港第２ターミナル", "羽田空港第2タミナル"), ("とうきょうスカイツリー", "トウキョウスカイツリ"), ("ＪＲ淡路", "jr淡路"), ("天満橋・中之島", "天満橋中之島")], names.search_key)
_named("x10_without_company", [("JR東日本新宿駅", "新宿"), ("東急電鉄・東京メトロ渋谷駅 (東京都)", "渋谷"), ("広島電鉄紙屋町停留場", "広島電鉄紙屋町"), ("・相鉄横浜", "横浜"), ("日暮里・舎人ライナー西日暮里", "西日暮里")], names.without_company)
_named("x11_stop_name", [("宇都宮駅東口停留場", "宇都宮駅東口"), ("八丁堀電停", "八丁堀"), ("霞ヶ関(東京)駅", "霞ケ関"), ("三ヵ所", "三カ所")], names.stop_name)
_named("x12_base_stop", [("阪急梅田駅", "梅田"), ("阪急", "阪急"), ("京阪祇園四条停留場", "祇園四条")], lambda c: names.base_stop(c, ["阪急", "京阪"]))
_named("x13_nfkc", [("ｱｻﾋ町", "アサヒ町"), ("鶴ヶ峰", "鶴ケ峰"), ("１２３", "123")], kana.nfkc)
_named("m27_hepburn", [("ふぁみりー", "Famiri"), ("ヴィラ", "Vira"), ("ゐのうえ", "Inoe"), ("しんばし", "Shimbashi"), ("まっちゃ", "Matcha"), ("きょうと", "Kyoto"), ("てぃーだ", "Tida"), ("おおつ", "Otsu"), ("じゅんじ", "Junji"), ("かんだ3ちょうめ", "Kanda3chome"), ("うぉーく", "Woku")], lambda c: kana.hepburn(c, capital=True))

_ROUTES = [("12", "市役所線", "r1", "12"), (None, "【45】空港線", "r2", "45"), ("", "[K-7] 急行", "r3", "K-7"), (" ", "循環線", "r4", "循環線"), (None, None, "r5", "r5")]


@op("x14_route_label", f"SELECT route, label FROM {_values([r[2:] for r in _ROUTES], 'route, label')}")
def route_label(n: Network):
    rows = n.spark.createDataFrame([r[:3] for r in _ROUTES], "short string, long string, route string")
    return rows.select("route", names.route_label(F.col("short"), F.col("long"), F.col("route")).alias("label"))


_CENTRES = [("北海道", 43.1, 141.3), ("愛知", 35.0, 137.1), ("広島", 34.5, 132.8)]


@op("x15_suffix_place", f"SELECT name, CAST(lat AS DOUBLE) AS lat FROM {_values([('中島(愛知)', 35.0), ('中島（広島県）', 34.5), ('大沼(北海道)', 43.1), ('中島', None), ('中島(京都)', None)], 'name, lat')}")
def suffix_place(n: Network):
    rows = n.spark.createDataFrame([("中島(愛知)",), ("中島（広島県）",), ("大沼(北海道)",), ("中島",), ("中島(京都)",)], "name string")
    return rows.select("name", names.suffix_place(F.col("name"), _CENTRES)["lat"].alias("lat"))


@op("x16_departure_key", "SELECT trip_id, coalesce(min_by(t, seq) FILTER (WHERE station_id % 4 <> 0), 9999) AS at FROM st GROUP BY trip_id")
def departure_key(n: Network):
    d = F.when(F.col("station_id") % 4 == 1, F.col("t"))
    a = F.when(F.col("station_id") % 4 > 1, F.col("t"))
    stops = n.st.groupBy("trip_id").agg(F.sort_array(F.collect_list(F.struct("seq", d.alias("d"), a.alias("a")))).alias("stops"))
    return stops.select("trip_id", names.departure_key(F.col("stops")).alias("at"))


_SCORES = [("", "京王電鉄（京王線）", "京王線", 1), ("", "小田急電鉄", "小田急小田原線", 1), ("", "JR東日本", "東海道新幹線", 0), ("東海道線", "JR東日本", "上野東京ライン", 1), ("京浜東北線", "JR東日本", "上野東京ライン", 0), ("中央線（快速）", "", "ＪＲ中央線", 2)]


@op("d15_entry_score", f"SELECT entry, heading, leg, CAST(score AS INT) AS score FROM {_values(_SCORES, 'entry, heading, leg, score')}")
def entry_score(n: Network):
    rows = n.spark.createDataFrame([s[:3] for s in _SCORES], "entry string, heading string, leg string")
    return rows.select("entry", "heading", "leg", platforms.entry_score(F.col("entry"), F.col("heading"), F.col("leg")).alias("score"))


# -- stop clusters and feeds ---------------------------------------------------------------
@op(
    "s24_stop_clusters",
    """WITH RECURSIVE p AS (SELECT station_id AS id, 'N' || station_id % 3 AS name, lat, lon, CASE WHEN station_id % 5 = 0 AND station_id > 0 THEN station_id - 5 END AS parent FROM stn),
    up AS (SELECT id, id AS root, 0 AS d FROM p UNION ALL SELECT up.id, p.parent, d + 1 FROM up JOIN p ON p.id = up.root AND p.parent IS NOT NULL AND p.parent IN (SELECT id FROM p) AND d < 64),
    top AS (SELECT id, max_by(root, d) AS root FROM up GROUP BY id), r AS (SELECT DISTINCT p.* FROM p JOIN top ON p.id = top.root),
    near AS (SELECT a.id AS a, b.id AS b FROM r a JOIN r b ON a.name = b.name AND a.id <> b.id AND 2 * 6371.0 * asin(sqrt(power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2))) <= 1.0),
    walk AS (SELECT id, id AS c FROM r UNION SELECT walk.id, near.b FROM walk JOIN near ON near.a = walk.c), comp AS (SELECT id, min(c) AS cluster FROM walk GROUP BY id)
    SELECT cluster, count(*) AS stops, round(avg(p.lat), 6) AS lat FROM p JOIN top ON p.id = top.id JOIN comp ON comp.id = top.root GROUP BY cluster""",
)
def stop_clusters(n: Network):
    parent = F.when((F.col("station_id") % 5 == 0) & (F.col("station_id") > 0), F.col("station_id") - 5)
    stops = n.stn.select(F.col("station_id").alias("id"), F.concat(F.lit("N"), F.col("station_id") % 3).alias("name"), "lat", "lon", parent.alias("parent"))
    _, clusters = spatial.cluster_stops(stops, F.col("name"), merge_km=1.0, depth=64)
    return clusters.select("cluster", "stops", "lat")


@op("s10_feed_selection")
def feed_selection(n: Network):
    feed = F.concat_ws("-", "line", "type_id", "cal")
    trips = n.st.join(n.trip, "trip_id").select(feed.alias("feed"), "station_id", "seq", "t")
    stops = n.st.join(n.trip, "trip_id").groupBy(feed.alias("feed"), F.col("type_id").cast("string").alias("region")).agg(F.collect_set("station_id").alias("stops"))
    return feeds.select_feeds(stops.join(feeds.signature(trips), "feed"), 100, 2)


@op("x17_wide_pairs", "SELECT count(*) AS pairs, round(max(km), 6) AS most FROM (SELECT 2 * 6371.0 * asin(sqrt(power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2))) AS km FROM stn a JOIN stn b ON a.station_id < b.station_id) x WHERE km <= 2")
def wide_pairs(n: Network):
    return spatial.within(n.stn, 2.0).agg(F.count("*").alias("pairs"), F.round(F.max("km"), 6).alias("most"))


@op(
    "m25_direction_boards",
    """WITH RECURSIVE ends AS (SELECT trip_id, max_by('S' || station_id, seq) AS dest FROM st GROUP BY trip_id), x AS (SELECT s.trip_id, s.seq, s.station_id, s.t, t.line, t.type_id, e.dest, lead(station_id) OVER w AS n1, lead(station_id, 2) OVER w AS n2 FROM st s JOIN trip t ON s.trip_id = t.trip_id JOIN ends e ON e.trip_id = s.trip_id WINDOW w AS (PARTITION BY s.trip_id ORDER BY seq)),
    r AS (SELECT * FROM x WHERE n1 IS NOT NULL), p AS (SELECT DISTINCT station_id, line, n1, o FROM (SELECT station_id, line, n1, n1 AS o FROM r UNION ALL SELECT station_id, line, n1, n2 FROM r WHERE n2 IS NOT NULL) y),
    near AS (SELECT DISTINCT a.station_id, a.line, a.n1 AS a, b.n1 AS b FROM p a JOIN p b ON a.station_id = b.station_id AND a.line = b.line AND a.o = b.o), walk AS (SELECT DISTINCT station_id, line, n1, n1 AS c FROM p UNION SELECT w.station_id, w.line, w.n1, near.b FROM walk w JOIN near ON near.station_id = w.station_id AND near.line = w.line AND near.a = w.c),
    d AS (SELECT station_id, line, n1, min(c) AS direction FROM walk GROUP BY ALL), e AS (SELECT r.*, d.direction FROM r JOIN d ON d.station_id = r.station_id AND d.line = r.line AND d.n1 = r.n1),
    b AS (SELECT *, row_number() OVER (PARTITION BY station_id, line, direction ORDER BY n DESC, dest) AS k, sum(n) OVER (PARTITION BY station_id, line, direction) AS total FROM (SELECT station_id, line, direction, dest, count(*) AS n FROM e GROUP BY ALL) z)
    SELECT f.station_id AS station, f.line, f.direction, CASE WHEN f.n < f.total * 0.5 AND g.dest IS NOT NULL THEN f.dest || '・' || g.dest ELSE f.dest END AS label, v.via, CAST(m.departures AS BIGINT) AS departures
    FROM b f LEFT JOIN b g ON g.station_id = f.station_id AND g.line = f.line AND g.direction = f.direction AND g.k = 2 JOIN (SELECT station_id, line, direction, string_agg(CAST(o AS VARCHAR), ',' ORDER BY o) AS via FROM (SELECT DISTINCT p.station_id, p.line, d.direction, p.o FROM p JOIN d ON d.station_id = p.station_id AND d.line = p.line AND d.n1 = p.n1) q GROUP BY ALL) v ON v.station_id = f.station_id AND v.line = f.line AND v.direction = f.direction
    JOIN (SELECT station_id, line, direction, count(DISTINCT type_id * 10000 + t) AS departures FROM e GROUP BY ALL) m ON m.station_id = f.station_id AND m.line = f.line AND m.direction = f.direction WHERE f.k = 1""",
)
def direction_boards(n: Network):
    ends = n.st.groupBy("trip_id").agg(F.max_by(F.concat(F.lit("S"), "station_id"), "seq").alias("dest"))
    stops = n.st.join(n.trip, "trip_id").join(ends, "trip_id").select(F.col("trip_id").alias("trip"), "line", F.col("type_id").cast("string").alias("type"), "dest", "seq", F.col("station_id").alias("station"), F.col("t").alias("dep"))
    found = boards.direction_boards(stops, window=2)
    minutes = F.aggregate("departures", F.lit(0).cast("long"), lambda a, d: a + F.size(d["minutes"]))
    return found.select("station", "line", "direction", "label", F.array_join(F.col("via").cast("array<string>"), ",").alias("via"), minutes.alias("departures"))


# -- places by name ------------------------------------------------------------------------
_PLACES = [(1, "札幌", "北海道", 43.07, 141.35, ["函館線"]), (2, "河原町", "宮城県", 38.24, 140.88, ["南北線"]), (3, "河原町", "京都府", 35.00, 135.77, ["京都線"]), (4, "中島", "愛知県", 35.10, 136.87, ["あおなみ線"]), (5, "中島", "広島県", 34.53, 132.50, ["可部線"]), (6, "霞ヶ関", "東京都", 35.67, 139.75, ["丸ノ内線"]), (7, "霞ヶ関", "埼玉県", 35.92, 139.43, ["東上線"]), (8, "三ノ宮", "兵庫県", 34.69, 135.19, ["神戸線"])]


def _places(n: Network):
    return n.spark.createDataFrame(_PLACES, "id int, name string, pref string, lat double, lon double, lines array<string>")


_ASKED = [(1, "札幌(ＪＲ)", []), (2, "河原町(宮城)", []), (3, "河原町", ["阪急京都線"]), (4, "河原町", ["x"]), (5, "霞ケ関駅", ["東上線"]), (6, "nowhere", []), (7, "中島(愛知)", [])]
_FOUND = [(1, 1), (2, 2), (3, 3), (4, None), (5, 7), (6, None), (7, 4)]


@op("j15_resolved_names", f"SELECT q, CAST(id AS INT) AS id FROM {_values(_FOUND, 'q, id')}")
def resolved_names(n: Network):
    return geocode.resolve_names(n.spark.createDataFrame(_ASKED, "q int, name string, lines array<string>"), _places(n))


_MOVED = [(1, "filled", 43.07), (2, "moved", 34.53), (3, "kept", 38.24), (4, "kept", 1.0), (5, "moved", 35.92)]


@op("j17_places_by_name", f"SELECT station_id, state, CAST(lat AS DOUBLE) AS lat FROM {_values(_MOVED, 'station_id, state, lat')}")
def places_by_name(n: Network):
    rows = [(1, "札幌駅", ["函館線"], None, None), (2, "中島(広島)", [], 35.10, 136.87), (3, "河原町", ["南北線"], 38.24, 140.88), (4, "nowhere", [], 1.0, 1.0), (5, "霞ヶ関", ["東上線"], 35.67, 139.75)]
    stations = n.spark.createDataFrame(rows, "station_id int, name string, lines array<string>, lat double, lon double")
    centres = [("愛知", 35.0, 137.1), ("広島", 34.5, 132.8)]
    found = geocode.place_by_name(stations.select(F.col("station_id").alias("q"), "name", "lines"), _places(n), names.stop_name, centres)
    return geocode.overwrite_far(stations, found.withColumnRenamed("q", "station_id"), "station_id").select("station_id", "state", "lat")


@op("j20_namesakes", f"SELECT q, CAST(id AS INT) AS id FROM {_values([(1, 1), (2, 2), (3, 8)], 'q, id')}")
def namesakes(n: Network):
    asked = n.spark.createDataFrame([(1, "札幌", None, None), (2, "河原町", 38.25, 140.86), (3, "三ノ宮", 0.0, 0.0), (4, "中島", 36.0, 136.0), (5, "中島", None, None)], "q int, key string, lat double, lon double")
    return geocode.nearest_namesake(asked, _places(n).select("id", F.col("name").alias("key"), "lat", "lon"))


_STOPS = [(1, "大曲", 1, 35.70, 139.75), (2, "大曲(秋田)", 0, 39.46, 140.48), (3, "高松(東京)", 0, 35.71, 139.41), (4, "高松(石川)", 0, 36.75, 136.72), (5, "鶴ケ峰", 0, 35.4740, 139.5500), (6, "鶴ヶ峰駅北口", 1, 35.4750, 139.5510), (7, "鶴ヶ峰駅", 1, 35.50, 139.60), (8, "市役所", 1, 35.4741, 139.5501)]


def _stops(n: Network):
    return n.spark.createDataFrame(_STOPS, "station_id int, name string, mode int, lat double, lon double")


@op("q10_named_candidates", f"SELECT q, CAST(id AS INT) AS id FROM {_values([(1, 2), (2, 3), (2, 4), (3, 2), (4, 8), (5, 7)], 'q, id')}")
def named_candidates(n: Network):
    asked = n.spark.createDataFrame([(1, "大曲"), (2, "高松"), (3, "大曲(秋田)"), (4, "市役所(x)"), (5, "鶴ヶ峰駅"), (6, "none")], "q int, name string")
    return geocode.name_candidates(asked, _stops(n).withColumnRenamed("station_id", "id"))


@op("j07_bus_stops_by_name", "SELECT 6 AS a, 5 AS b")
def bus_stops_by_name(n: Network):
    return geocode.bus_to_rail(_stops(n)).select("a", "b")


@op("j28_namesake_lists", f"SELECT key, ids FROM {_values([('大曲', '1,2'), ('高松', '3,4'), ('鶴ケ峰', '5,7'), ('鶴ケ峰駅北口', '6'), ('市役所', '8')], 'key, ids')}")
def namesake_lists(n: Network):
    return _stops(n).groupBy(names.stop_name(F.col("name")).alias("key")).agg(F.array_join(F.sort_array(F.collect_list("station_id")).cast("array<string>"), ",").alias("ids"))


# -- streams -------------------------------------------------------------------------------
def _streamed(n: Network, of):
    """The event table as a stream of files, run to its end."""
    import uuid

    from chronoline.operators.graph import own_folder
    from chronoline.streaming import sessions

    source = sessions.event_stream(n.spark, f"{n.sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    return sessions.drained(of(source), f"{own_folder(n.spark)}/stream-{uuid.uuid4().hex}")


@op(
    "st01_hourly_events",
    "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events) GROUP BY ALL",
)
def hourly_events(n: Network):
    from chronoline.streaming import sessions

    return _streamed(n, sessions.departures_by_hour).select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


@op(
    "st02_user_sessions",
    "SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS began, count(*) AS n FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 43200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT *, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) AS gap FROM events) x) y GROUP BY user_id, s HAVING max(ts) + INTERVAL 12 HOUR <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)",
)
def user_sessions(n: Network):
    from chronoline.streaming import sessions

    return _streamed(n, sessions.user_sessions).select("user_id", F.date_format("session.start", "yyyy-MM-dd HH:mm:ss").alias("began"), "n")
