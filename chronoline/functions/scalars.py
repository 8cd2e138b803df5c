"""Scalar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: Straight line to rail kilometres.
RAIL_FACTOR = 1.06
# Full operator names and their short forms in line names, in the order of replacement.
LINE_NAMES = [
    ("ＪＲ", ""), ("JR", ""), ("東京メトロ", ""), ("都営地下鉄", "都営"), ("京浜急行電鉄", "京急"), ("東武鉄道", "東武"), ("西武鉄道", "西武"),
    ("京成電鉄", "京成"), ("京王電鉄", "京王"), ("小田急電鉄", "小田急"), ("東急電鉄", "東急"), ("相模鉄道", "相鉄"), ("北総鉄道北総線", "北総鉄道"), (" ", ""), ("　", ""),
]
# Operators in front of station names.
OPERATOR_PREFIX = "^(ＪＲ|京成|京王|京急|京阪|阪急|阪神|近鉄|南海|西鉄|東武|西武|名鉄|東急|小田急|相鉄|東京メトロ|都営)"
# Kinds of trains that stop everywhere.
LOCAL_TYPES = ["各停", "各駅停車", "普通", "普通車", ""]
# Expresses without a charge.
FREE_EXPRESS = "(準特急|通勤特急|快速特急|直通特急|アクセス特急|区間特急|川越特急)"
# Trains with a charge, by a name that their kind holds; JR lines first, then private ones.
PAID_NAMES = [
    "あずさ", "かいじ", "富士回遊", "はちおうじ", "おうめ", "ひたち", "ときわ", "踊り子", "湘南", "サフィール", "成田エクスプレス", "しおさい", "わかしお", "さざなみ", "しなの", "ひだ", "南紀",
    "伊那路", "ふじかわ", "サンダーバード", "しらさぎ", "びわこエクスプレス", "らくラク", "はるか", "くろしお", "こうのとり", "きのさき", "まいづる", "はしだて", "スーパーはくと", "はまかぜ",
    "スーパーいなば", "やくも", "スーパーおき", "スーパーまつかぜ", "北斗", "おおぞら", "とかち", "オホーツク", "大雪", "宗谷", "サロベツ", "カムイ", "ライラック", "すずらん", "ソニック", "にちりん",
    "ひゅうが", "きりしま", "かもめ", "みどり", "ハウステンボス", "かささぎ", "きらめき", "ゆふ", "九州横断特急", "かわせみ", "やませみ", "海幸山幸", "指宿のたまて箱", "南風", "しまんと", "あしずり",
    "うずしお", "剣山", "むろと", "しおかぜ", "いしづち", "宇和海", "いなほ", "つがる", "草津", "四万", "あかぎ", "日光", "きぬがわ", "スペーシア",
    "スカイライナー", "イブニングライナー", "モーニングライナー", "ロマンスカー", "はこね", "さがみ", "えのしま", "ホームウェイ", "モーニングウェイ", "メトロはこね", "ふじさん", "フジサン特急",
    "富士山ビュー", "ミュースカイ", "りょうもう", "リバティ", "けごん", "きぬ", "ちちぶ", "むさし", "小江戸", "京王ライナー", "拝島ライナー", "泉北ライナー", "ラピート", "りんかん", "こうや", "天空",
    "スノーモンキー", "ゆけむり", "しまかぜ", "ひのとり", "あをによし",
]
# Kinds that only run on weekdays.
WEEKDAY_ONLY = "^通勤|^Ｒ通勤|^ホームライナー|ウィング|^らくラク|^臨時|^ライナー$"
WIDE = "".join(chr(c) for c in (*range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B), *range(0xFF10, 0xFF1A)))
NARROW = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(a))


def planar2(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Squared distance in degrees, longitudes shortened as at 35 degrees north."""
    return F.pow(lat1 - lat2, 2) + F.pow((lon1 - lon2) * 0.82, 2)


def walk_minutes(km: Column) -> Column:
    """15 minutes a kilometre, rounded half to even, and three more."""
    return (F.bround(km * 15) + 3).cast("int")


def minutes(text: Column) -> Column:
    """HH:MM or HH:MM:SS to minutes; hours may exceed 23; null where it is neither."""
    part = F.split(F.trim(text), ":")
    fits = F.trim(text).rlike("^[0-9]{1,3}:[0-9]{2}(:[0-9]{2})?$")
    return F.when(fits, F.try_element_at(part, F.lit(1)).cast("int") * 60 + F.try_element_at(part, F.lit(2)).cast("int"))


def clock(minute: Column) -> Column:
    """Minutes to HH:MM of the day."""
    m = F.pmod(minute, F.lit(1440))
    return F.concat(F.lpad(F.floor(m / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((m % 60).cast("string"), 2, "0"))


def period(minute: Column) -> Column:
    """Part of the day that a minute lies in."""
    hour = F.floor(F.pmod(minute, F.lit(1440)) / 60)
    return F.when((hour >= 7) & (hour < 10), "morning").when((hour >= 17) & (hour < 20), "evening").when((hour < 7) | (hour >= 22), "off").otherwise("day")


def canonical_line(name: Column) -> Column:
    out = F.coalesce(name, F.lit(""))
    for long, short in LINE_NAMES:
        out = F.replace(out, F.lit(long), F.lit(short))
    return out


def narrow(text: Column) -> Column:
    """Full-width letters and digits to ASCII."""
    return F.translate(text, WIDE, NARROW)


def without_brackets(name: Column) -> Column:
    return F.regexp_replace(name, "[（(].*?[)）]", "")


def base_name(name: Column) -> Column:
    """Station name without brackets, the word station and the operator in front."""
    return F.regexp_replace(F.regexp_replace(without_brackets(name), "駅$", ""), OPERATOR_PREFIX, "")


def line_key(name: Column) -> Column:
    """Line name for comparison: narrow, without spaces, brackets, JR in front and 線 at the end."""
    out = F.regexp_replace(narrow(F.coalesce(name, F.lit(""))), r"\s+", "")
    return F.regexp_replace(F.regexp_replace(without_brackets(out), "(?i)^JR", ""), "線$", "")


def is_jr(line: Column) -> Column:
    return line.rlike("^(ＪＲ|JR)")


def service_class(line: Column, kind: Column, paid_names: Column, company: Column) -> Column:
    """'shinkansen', 'paid' or null.  paid_names: array of names of charged trains."""
    return (
        F.when(F.coalesce(kind, F.lit("")) == "", None)
        .when(line.contains("新幹線"), "shinkansen")
        .when(kind.rlike(FREE_EXPRESS), None)
        .when(F.exists(paid_names, lambda n: kind.contains(n)), "paid")
        .when(kind.contains("特急") & (is_jr(line) | (company == "近鉄")), "paid")
    )


def operator_of(line: Column, company: Column) -> Column:
    """Operator that a line counts to: JR as one, a known company, else the operator part of the name."""
    bare = F.regexp_replace(line, "＜.+＞$", "")
    cut = F.regexp_extract(bare, "^(.+?(?:鐵道|鉄道|電鉄|電気軌道|軌道|急行|交通|地下鉄|モノレール)).", 1)
    return F.when(F.coalesce(line, F.lit("")) == "", "").when(is_jr(line), "JR").when(company.startswith("JR"), "JR").when(company != "", company).when(cut != "", cut).otherwise(bare)


def core_number(tail: Column) -> Column:
    """Digits of a train number, its duplicate suffix left out; the whole where there are none."""
    digits = F.regexp_extract(F.regexp_replace(tail, r"_\d+$", ""), r"\d+", 0)
    return F.when(digits != "", digits).otherwise(F.regexp_replace(tail, r"_\d+$", ""))
