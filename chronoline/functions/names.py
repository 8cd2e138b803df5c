"""Names of stations and routes, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronoline.functions.scalars import narrow, without_brackets

# Companies in front of station names, the longer first.
COMPANY_PREFIXES = [
    "相模鉄道・東急電鉄", "東急電鉄・東京メトロ・都営地下鉄", "東急電鉄・東京メトロ", "東急電鉄・横浜高速鉄道", "日暮里・舎人ライナー",
    "JR東日本", "JR西日本", "JR東海", "JR北海道", "JR四国", "JR九州", "東京メトロ", "都営地下鉄", "東急電鉄", "小田急電鉄", "京王電鉄",
    "西武鉄道", "東武鉄道", "京急電鉄", "京成電鉄", "相模鉄道", "相鉄", "南海電気鉄道", "近畿日本鉄道", "阪急電鉄", "阪神電気鉄道",
    "名古屋鉄道", "西日本鉄道", "大阪メトロ", "京阪電気鉄道",
]
#: Words that end a stop's name.
STOP_WORDS = "(駅|停留場|停留所|電停)$"
_HIRAGANA = "".join(chr(c) for c in range(0x3041, 0x3094))
_KATAKANA = "".join(chr(c) for c in range(0x30A1, 0x30F4))
#: Sort key of a trip without any time.
NO_TIME = 9999


def search_key(name: Column) -> Column:
    """Narrow letters and digits, katakana, no punctuation, long marks or spaces, lower case."""
    folded = F.translate(narrow(name), _HIRAGANA, _KATAKANA)
    return F.lower(F.regexp_replace(folded, "[・･\\s'’ｰー―‐-]", ""))


def without_company(name: Column) -> Column:
    """Station name without companies in front, however many and however joined, and without what follows the name itself."""
    front = "^(?:・|" + "|".join(COMPANY_PREFIXES) + ")+"
    out = F.regexp_replace(name, front, "")
    out = F.regexp_replace(out, r"\s*[\(（][^\)）]*[\)）]\s*$", "")
    out = F.regexp_replace(out, "駅$", "")
    return F.trim(F.regexp_replace(out, r"\s*(信号場|停留場)\s*$", ""))


def stop_name(name: Column) -> Column:
    """Name without brackets and the word for station or stop; small ke and ka made large."""
    return F.translate(F.regexp_replace(without_brackets(F.coalesce(name, F.lit(""))), STOP_WORDS, ""), "ヶヵ", "ケカ")


def base_stop(name: Column, prefixes: list[str]) -> Column:
    """``stop_name`` without the first of the prefixes that it begins with, unless nothing would be left."""
    bare = stop_name(name)
    out = bare
    for p in reversed(prefixes):
        out = F.when(bare.startswith(p) & (F.length(bare) > len(p)), F.substr(bare, F.lit(len(p) + 1))).otherwise(out)
    return out


def route_label(short: Column, long: Column, route: Column) -> Column:
    """Short name; else the number in brackets that begins the long name; else the long name, else the id."""
    s, t = F.trim(F.coalesce(short, F.lit(""))), F.trim(F.coalesce(long, F.lit("")))
    number = F.trim(F.regexp_extract(t, "^[【\\[［](.+?)[】\\]］]", 1))
    return F.when(s != "", s).when(number != "", number).when(t != "", t).otherwise(F.coalesce(route, F.lit("")))


def suffix_place(name: Column, centres: list[tuple[str, float, float]]) -> Column:
    """Struct (lat, lon) of the first centre whose name begins what stands in the name's brackets; null without one."""
    inside = F.regexp_extract(name, "[（(](.+?)[)）]", 1)
    out = F.lit(None).cast("struct<lat:double,lon:double>")
    for centre, lat, lon in reversed(centres):
        out = F.when(inside.startswith(centre), F.struct(F.lit(float(lat)).alias("lat"), F.lit(float(lon)).alias("lon"))).otherwise(out)
    return F.when(inside != "", out)


def departure_key(stops: Column) -> Column:
    """First time of a trip: the first stop's departure or, lacking that, arrival that is known; NO_TIME without any."""
    times = F.filter(F.transform(stops, lambda s: F.coalesce(s["d"], s["a"])), lambda t: t.isNotNull())
    return F.coalesce(F.get(times, F.lit(0)), F.lit(NO_TIME))


def suggest_rank(query: Column, name: Column, kana: Column, romaji: Column, mode: Column, bus_first: bool = False) -> Column:
    """Struct that sorts suggestions, null where a station does not match: by mode, exact before beginning before inside, short names first.

    The query is folded as ``search_key`` does, and compared with the name, its reading and, by its beginning, its romaji.
    """
    q, keys = search_key(query), F.array(search_key(name), search_key(F.coalesce(kana, F.lit(""))))
    latin = F.lower(F.coalesce(romaji, F.lit("")))
    exact = F.array_contains(keys, q) | (latin == q)
    begins = F.exists(keys, lambda k: k.startswith(q)) | latin.startswith(q)
    inside = F.exists(keys, lambda k: k.contains(q))
    how = F.when(q == "", None).when(exact, 0).when(begins, 1).when(inside, 2)
    order = -mode if bus_first else mode
    return F.when(how.isNotNull(), F.struct(order.alias("mode"), how.alias("how"), F.length(name).alias("size"), name.alias("name")))
