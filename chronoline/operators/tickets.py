"""Ticket and express fares of journeys under a tariff.

A tariff is a small set of rules that the caller gives: bands by company, special pairs,
surcharges, discounts, regions and express charges.  Rules become literals of expressions,
so a fare never costs a join; legs of one journey, a handful, are folded as an array.
All of it runs on the JVM.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chronoline.functions.scalars import without_brackets

RESERVED, NONRESERVED = "reserved", "nonreserved"
Bands = list[tuple[float, int]]

# Cities that stand for the railway companies' regions (company, latitude, longitude).
REGIONS = [
    ("JR北海道", 43.07, 141.35), ("JR北海道", 41.77, 140.73), ("JR東日本", 39.70, 141.14), ("JR東日本", 38.26, 140.88), ("JR東日本", 37.91, 139.06),
    ("JR東日本", 35.68, 139.77), ("JR東日本", 36.65, 138.19), ("JR東日本", 34.97, 139.09), ("JR東日本", 35.67, 138.57), ("JR東海", 35.17, 136.88),
    ("JR東海", 34.97, 138.39), ("JR東海", 36.14, 137.25), ("JR東海", 35.16, 138.68), ("JR西日本", 36.56, 136.66), ("JR西日本", 35.31, 136.29),
    ("JR西日本", 34.70, 135.50), ("JR西日本", 35.49, 134.22), ("JR西日本", 34.66, 133.92), ("JR西日本", 34.40, 132.47), ("JR西日本", 33.95, 130.94),
    ("JR四国", 34.35, 134.05), ("JR四国", 33.84, 132.77), ("JR四国", 33.57, 133.54), ("JR四国", 34.07, 134.55), ("JR九州", 33.89, 130.88),
    ("JR九州", 33.59, 130.42), ("JR九州", 32.79, 130.69), ("JR九州", 31.59, 130.54), ("JR九州", 33.24, 131.61),
]
#: Company, table and corners (south, north, west, east) of the city zone with its own bands.
CITY_ZONE = ("JR西日本", "JR西日本電特", 34.2, 35.1, 134.5, 136.05)
#: Companies whose kilometres count together, and which one's bands hold if it takes part.
JOINT = {"京成": "京成G", "京成スカイアクセス": "京成G"}
JOINT_LEADER = "京成スカイアクセス"


@dataclass
class Tariff:
    """Rules by name; every part may be left out."""

    bands: dict[str, Bands] = field(default_factory=dict)
    scale: dict[str, float] = field(default_factory=dict)
    per_km: float = 25
    special: dict[tuple[str, str], int] = field(default_factory=dict)
    surcharges: list[dict[str, Any]] = field(default_factory=list)
    discounts: list[dict[str, Any]] = field(default_factory=list)
    bullet_lines: list[tuple[str, str]] = field(default_factory=list)
    bullet: dict[str, Bands] = field(default_factory=dict)
    premium: dict[str, Bands] = field(default_factory=dict)
    by_name: dict[str, int] = field(default_factory=dict)
    conventional: dict[str, Bands] = field(default_factory=dict)
    seat_bullet: dict[str, Bands] = field(default_factory=dict)
    seat_conventional: dict[str, Bands] = field(default_factory=dict)
    reserved_only: list[str] = field(default_factory=list)

    @classmethod
    def load(cls, path: str) -> Tariff:
        """Rules from a fare file in JSON: companies, special pairs, surcharges, discounts and express charges."""
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        express = raw.get("express", {})
        seat = express.get("seat", {})
        own = {k: v for k, v in raw.get("companies", {}).items() if "ic_fare" in v}
        return cls(
            bands={k: v["ic_fare"] for k, v in own.items()},
            scale={k: v["km_scale"] for k, v in own.items() if "km_scale" in v},
            per_km=raw.get("default_fare_per_km", 25),
            special={tuple(k.split("|")): v for k, v in raw.get("jr_special", {}).items()},
            surcharges=raw.get("surcharges", []),
            discounts=raw.get("transfer_discounts", []),
            bullet_lines=[tuple(x) for x in express.get("shinkansen_groups", [])],
            bullet=express.get("groups", {}),
            premium=express.get("premium", {}),
            by_name=express.get("conv_by_name", {}),
            conventional=express.get("conventional", {}),
            seat_bullet=seat.get("shinkansen", {}),
            seat_conventional=seat.get("conventional", {}),
            reserved_only=seat.get("reserved_only", []),
        )


def _literal(bands: Bands) -> Column:
    return F.array(*[F.struct(F.lit(float(km)).alias("km"), F.lit(int(yen)).alias("yen")) for km, yen in bands])


def banded(bands: Bands, km: Column) -> Column:
    """Fare of the first band that reaches the kilometres, rounded up; the last band's beyond all."""
    out = F.lit(int(bands[-1][1]))
    for reach, yen in reversed(bands[:-1]):
        out = F.when(F.ceil(km) <= reach, F.lit(int(yen))).otherwise(out)
    return out


def _by(key: Column, tables: dict[str, Bands], km: Column) -> Column:
    """Band fare from the table that ``key`` names; null where there is none."""
    if not tables:
        return F.lit(None).cast("int")
    table = F.create_map(*[x for k, v in tables.items() for x in (F.lit(k), _literal(v))])
    found = F.try_element_at(table, key)
    fits = F.filter(found, lambda b: F.ceil(km) <= b["km"])
    return F.coalesce(F.try_element_at(fits, F.lit(1))["yen"], F.try_element_at(found, F.lit(-1))["yen"])


def ticket(tariff: Tariff, company: Column, km: Column) -> Column:
    """Fare of one company's kilometres; a company without bands takes the fare a kilometre."""
    factor = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in tariff.scale.items() for x in (F.lit(k), F.lit(float(v)))]), company), F.lit(1.0)) if tariff.scale else F.lit(1.0)
    return F.coalesce(_by(company, tariff.bands, km * factor), F.floor(km * tariff.per_km + 0.5).cast("int"))


def region(lat: Column, lon: Column) -> Column:
    """Railway company of the nearest city; the first one's where there is no place."""
    near = [F.struct((F.pow(lat - a, 2) + F.pow((lon - o) * 0.82, 2)).alias("d"), F.lit(k).alias("k"), F.lit(c).alias("company")) for k, (c, a, o) in enumerate(REGIONS)]
    return F.when(lat.isNull() | lon.isNull(), "JR東日本").otherwise(F.array_min(F.array(*near))["company"])


def special(tariff: Tariff, a: Column, b: Column) -> Column:
    """Special fare of an unordered pair of station names; null where there is none."""
    if not tariff.special:
        return F.lit(None).cast("int")
    pairs = F.create_map(*[x for (p, q), yen in tariff.special.items() for x in (F.lit(f"{p}|{q}"), F.lit(yen))])
    return F.coalesce(F.try_element_at(pairs, F.concat_ws("|", a, b)), F.try_element_at(pairs, F.concat_ws("|", b, a)))


def leg_parts(legs: DataFrame) -> DataFrame:
    """Cut rides at company borders: (journey, ord, part, company, km, stops).

    legs: (journey, ord, company, bullet boolean, km of a bullet ride, stops
    array<struct<name, lat, lon, companies array>>); company is that of the train's label.
    A hop belongs to the label's company if both stations know it; else to the one company both
    know (the present one, else the one that lasts longest ahead, if several); else to the label's
    if one station knows it; else to the present company if both stations are known, or the only
    company of the one that is.  Hops over stations without a place are bridged.
    """
    from chronoline.functions.scalars import RAIL_FACTOR, haversine_km

    stops, label = F.col("stops"), F.col("company")

    def chosen(i: Column, now: Column) -> Column:
        a, b = F.get(stops, i - 1)["companies"], F.get(stops, i)["companies"]
        both = F.array_intersect(a, b)

        def run(c: Column) -> Column:
            ahead = F.transform(F.slice(stops, i + 1, F.size(stops) - i), lambda s: F.array_contains(s["companies"], c))
            first = F.array_position(ahead, F.lit(False))
            return F.when(first == 0, F.size(ahead)).otherwise(first - 1)

        lasting = F.array_max(F.transform(both, lambda c, k: F.struct(run(c).cast("long").alias("run"), (-k).alias("k"), c.alias("c"))))["c"]
        one = F.when(F.size(a) > 0, a).otherwise(b)
        return (
            F.when(F.array_contains(both, label), label)
            .when(F.size(both) == 1, F.get(both, F.lit(0)))
            .when(F.size(both) > 1, F.when(F.array_contains(both, now), now).otherwise(lasting))
            .when(F.array_contains(a, label) | F.array_contains(b, label), label)
            .when((F.size(a) > 0) & (F.size(b) > 0), F.coalesce(now, label))
            .otherwise(F.when(F.size(one) == 1, F.get(one, F.lit(0))).otherwise(label))
        )

    def place(i: Column) -> Column:
        """The last known place before stop i."""
        known = F.filter(F.slice(stops, 1, i), lambda s: s["lat"].isNotNull())
        return F.try_element_at(known, F.lit(-1))

    def km(i: Column) -> Column:
        here, was = F.get(stops, i), place(i)
        return F.coalesce(haversine_km(was["lat"], was["lon"], here["lat"], here["lon"]) * RAIL_FACTOR, F.lit(0.0))

    empty = F.array().cast("array<struct<company:string,km:double,from:int,to:int>>")

    def hop(parts: Column, i: Column) -> Column:
        last = F.try_element_at(parts, F.lit(-1))
        return F.transform(F.array(chosen(i, last["company"])), lambda c: F.when(
            c == last["company"],
            F.concat(F.slice(parts, 1, F.size(parts) - 1), F.array(F.struct(c.alias("company"), (last["km"] + km(i)).alias("km"), last["from"].alias("from"), i.alias("to")))),
        ).otherwise(F.concat(parts, F.array(F.struct(c.alias("company"), km(i).alias("km"), (i - 1).alias("from"), i.alias("to"))))))[0]

    hops = F.when(F.size(stops) > 1, F.sequence(F.lit(1), F.size(stops) - 1)).otherwise(F.array().cast("array<int>"))
    whole = F.array(F.struct(label.alias("company"), F.coalesce("km", F.lit(0.0)).alias("km"), F.lit(0).alias("from"), (F.size(stops) - 1).alias("to")))
    folded = F.when(F.col("bullet") | (F.size(stops) < 2), whole).otherwise(F.aggregate(hops, empty, hop))
    cut = legs.select("journey", "ord", "stops", F.posexplode(folded).alias("part", "p"))
    return cut.select("journey", "ord", "part", "p.company", "p.km", F.slice("stops", F.col("p.from") + 1, F.col("p.to") - F.col("p.from") + 1).alias("stops"))


def segments(parts: DataFrame) -> DataFrame:
    """Neighbouring parts of one fare group as one: (journey, seg, company, km, stops)."""
    w = W.partitionBy("journey").orderBy("ord", "part")
    group = F.col("company")
    for name, joint in JOINT.items():
        group = F.when(F.col("company") == name, joint).otherwise(group)
    marked = parts.withColumn("grp", group)
    new = F.coalesce((F.lag("grp").over(w) != F.col("grp")).cast("int"), F.lit(1))
    numbered = marked.withColumn("seg", F.sum(new).over(w))
    gathered = numbered.groupBy("journey", "seg").agg(F.sort_array(F.collect_list(F.struct("ord", "part", "company", "km", "stops"))).alias("x"))
    leads = F.exists("x", lambda p: p["company"] == JOINT_LEADER)
    km = F.aggregate("x", F.lit(0.0), lambda a, p: a + p["km"])
    return gathered.select("journey", "seg", F.when(leads, JOINT_LEADER).otherwise(F.col("x")[0]["company"]).alias("company"), km.alias("km"), F.flatten(F.transform("x", lambda p: p["stops"])).alias("stops"))


def priced(segs: DataFrame, tariff: Tariff) -> DataFrame:
    """Add label and yen to segments; JR ones by region, special pair and city zone."""
    known = F.filter("stops", lambda s: s["lat"].isNotNull())
    mean = lambda c: F.aggregate(known, F.lit(0.0), lambda a, s: a + s[c]) / F.nullif(F.size(known), F.lit(0))
    home = region(mean("lat"), mean("lon"))
    home = F.when(home.isin(list(tariff.bands)), home).otherwise("JR東日本")
    owner, table, south, north, west, east = CITY_ZONE
    inside = (F.size(known) > 0) & F.forall(known, lambda s: s["lat"].between(south, north) & s["lon"].between(west, east))
    pair = F.when((F.col("company") == "JR") & (F.size("stops") > 1), special(tariff, F.col("stops")[0]["name"], F.element_at("stops", -1)["name"]))
    held = segs.where("km > 0").withColumn("home", home).withColumn("pair", pair)
    by = F.when(F.col("company") != "JR", F.col("company")).when((F.col("home") == owner) & inside, table).otherwise(F.col("home"))
    label = F.when(F.col("pair").isNotNull(), F.concat("home", F.lit("(特定)"))).otherwise(F.col("by"))
    out = held.withColumn("by", by)
    return out.withColumn("label", label).withColumn("yen", F.coalesce("pair", ticket(tariff, F.col("by"), F.col("km")))).drop("home", "pair", "by")


def surcharges(ends: DataFrame, tariff: Tariff) -> DataFrame:
    """(journey, label, yen) of the rules whose station begins or ends a journey, with the rule's company there if it names one.

    ends: (journey, origin, destination, first_company, last_company).
    """
    rules = []
    for r in tariff.surcharges:
        hits = [F.col(s).isin(r["stations"]) & (F.col(c) == r["company"] if r.get("company") else F.lit(True)) for s, c in (("origin", "first_company"), ("destination", "last_company"))]
        rules.append(F.when(hits[0] | hits[1], F.struct(F.lit(r.get("label") or f"{r['company']}(加算)").alias("label"), F.lit(r["yen"]).alias("yen"))))
    if not rules:
        return ends.select("journey", F.lit("").alias("label"), F.lit(0).alias("yen")).where("false")
    return ends.select("journey", F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("r")).select("journey", "r.label", "r.yen")


def discounts(segs: DataFrame, tariff: Tariff) -> DataFrame:
    """(journey, label, yen) of the rules all of whose companies a journey uses; each counts once."""
    used = segs.groupBy("journey").agg(F.collect_set("company").alias("used"))
    rules = [F.when(F.size(F.array_except(F.array(*map(F.lit, r["companies"])), F.col("used"))) == 0, F.struct(F.lit(r["label"]).alias("label"), F.lit(r["yen"]).alias("yen"))) for r in tariff.discounts]
    if not rules:
        return used.select("journey", F.lit("").alias("label"), F.lit(0).alias("yen")).where("false")
    return used.select("journey", F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("r")).select("journey", "r.label", "r.yen")


def bullet_group(tariff: Tariff, line: Column, kind: Column, a: Column, b: Column) -> Column:
    """Charge group of a bullet ride between mileposts a and b (null where unknown)."""
    far, near = F.greatest(a, b), F.least(a, b)
    known = a.isNotNull() & b.isNotNull()
    base = F.lit("tokaido")
    for part, group in reversed(tariff.bullet_lines):
        base = F.when(line.contains(part), group).otherwise(base)
    base = F.when((base == "tokaido") & known & (near >= 550), "sanyo").otherwise(base)
    return F.when(kind.contains("こまち") & known & (far > 535), "akita").when(kind.contains("つばさ") & known & (far > 273), "yamagata").otherwise(base)


def premium(tariff: Tariff, kind: Column, km: Column) -> Column:
    """Charge of the faster kind of train, by the first name that its kind holds; else 0."""
    out = F.lit(0)
    for name, bands in reversed(tariff.premium.items()):
        out = F.when(kind.contains(name), banded(bands, km)).otherwise(out)
    return F.when(kind.isNull(), 0).otherwise(out)


def _named(kind: Column, names) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | kind.contains(n)
    return F.coalesce(out, F.lit(False))


def conventional(tariff: Tariff, kind: Column, company: Column, km: Column) -> Column:
    """Charge of a paid train on ordinary lines: by its name, else by its company; 0 where nothing is known."""
    out = F.coalesce(_by(company, tariff.conventional, km), F.lit(0))
    for name, yen in reversed(tariff.by_name.items()):
        out = F.when(kind.contains(name), F.lit(yen)).otherwise(out)
    return out


def seat_delta(tariff: Tariff, unit: Column) -> Column:
    """What a free seat costs more (less: negative) than a reserved one; null where the train has none."""
    bullet = _by(unit["grp"], tariff.seat_bullet, unit["km"])
    other = F.when(~_named(unit["type"], tariff.by_name), _by(unit["company"], tariff.seat_conventional, unit["km"]))
    return F.when(~_named(unit["type"], tariff.reserved_only), F.when(unit["kind"] == "shinkansen", bullet).otherwise(other))


def express_units(rides: DataFrame, tariff: Tariff) -> DataFrame:
    """(journey, units): what is charged, in order.  Bullet rides in a row within one group count together,
    under the kind with the larger premium over all their kilometres.

    rides: (journey, ord, kind 'shinkansen' | 'paid' | null, type, line, company ('JR' for its lines), km, a, b mileposts).
    """
    km = F.when((F.col("kind") == "shinkansen") & F.col("a").isNotNull() & F.col("b").isNotNull(), F.abs(F.col("a") - F.col("b"))).otherwise(F.col("km"))
    group = F.when(F.col("kind") == "shinkansen", bullet_group(tariff, F.col("line"), F.coalesce("type", F.lit("")), F.col("a"), F.col("b")))
    number = F.row_number().over(W.partitionBy("journey").orderBy("ord"))
    each = rides.select("journey", F.struct(number.alias("j"), "kind", group.alias("grp"), km.cast("double").alias("km"), "type", "line", "company").alias("u"))
    held = each.groupBy("journey").agg(F.filter(F.sort_array(F.collect_list("u")), lambda u: u["kind"].isNotNull()).alias("all"))
    empty = F.array().cast("array<struct<j:int,kind:string,grp:string,km:double,type:string,line:string,company:string>>")

    def take(units: Column, u: Column) -> Column:
        last = F.try_element_at(units, F.lit(-1))
        joins = (last["kind"] == "shinkansen") & (u["kind"] == "shinkansen") & (last["grp"] == u["grp"]) & (last["j"] == u["j"] - 1)
        total = last["km"] + u["km"]
        kind = F.when(premium(tariff, u["type"], total) > premium(tariff, last["type"], total), u["type"]).otherwise(last["type"])
        one = F.struct(u["j"].alias("j"), u["kind"].alias("kind"), u["grp"].alias("grp"), total.alias("km"), kind.alias("type"), u["line"].alias("line"), u["company"].alias("company"))
        return F.when(joins, F.concat(F.slice(units, 1, F.size(units) - 1), F.array(one))).otherwise(F.concat(units, F.array(u)))

    return held.select("journey", F.aggregate("all", empty, take).alias("units"))


def express_charges(rides: DataFrame, tariff: Tariff, seat: str = RESERVED) -> DataFrame:
    """(journey, k, label, yen, seat, optional): charges of a journey's units.

    A paid JR train next to a bullet ride costs half, down to ten yen.  Trains without free
    seats cost the reserved charge whatever ``seat`` says; units without any charge are left out.
    """
    units = express_units(rides, tariff).select("journey", "units", F.posexplode("units").alias("k", "u"))
    u, k = F.col("u"), F.col("k")
    delta = seat_delta(tariff, u)
    free = delta.isNotNull() & F.lit(seat == NONRESERVED)
    bullet = _by(u["grp"], tariff.bullet, u["km"]) + F.when(free, delta).otherwise(premium(tariff, u["type"], u["km"]))
    full = conventional(tariff, u["type"], u["company"], u["km"])
    plain = F.when(free, F.greatest(F.lit(0), full + delta)).otherwise(full)
    kind_at = lambda i: F.get(F.col("units"), i)["kind"]
    beside = F.coalesce(F.when(k > 0, kind_at(k - 1)) == "shinkansen", F.lit(False)) | F.coalesce(kind_at(k + 1) == "shinkansen", F.lit(False))
    halved = F.when(beside & (u["company"] == "JR"), F.floor(plain / 20) * 10).otherwise(plain)
    suffix = F.when(delta.isNull(), "").when(free, "(自由席)").otherwise("(指定席)")
    is_bullet = u["kind"] == "shinkansen"
    label = F.concat(F.coalesce(F.nullif(u["type"], F.lit("")), F.when(is_bullet, "新幹線").otherwise("特急")), F.when(is_bullet, "特急料金").otherwise("料金"), suffix)
    out = units.where(is_bullet | (full != 0))
    return out.select("journey", "k", label.alias("label"), F.when(is_bullet, bullet).otherwise(halved).cast("int").alias("yen"), F.when(free, NONRESERVED).otherwise(RESERVED).alias("seat"), delta.isNotNull().alias("optional"))


def journey_fare(legs: DataFrame, tariff: Tariff, seat: str = RESERVED) -> DataFrame:
    """(journey, total, ticket, express, reserved, nonreserved, bus_legs, breakdown) of every journey.

    legs: (journey, ord, mode, kind, type, line, company, km, a, b, stops as in ``leg_parts``).  Bus
    rides (mode 1) are only counted.  reserved and nonreserved are null where no train lets one choose.
    """
    rides = legs.where("mode = 0")
    segs = segments(leg_parts(rides.withColumn("bullet", F.col("line").contains("新幹線")).withColumn("km", F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.abs(F.col("a") - F.col("b"))).otherwise(F.col("km")))))
    tickets = priced(segs, tariff).select("journey", F.col("label"), F.col("yen"))
    ends = rides.groupBy("journey").agg(F.min_by(F.col("stops")[0]["name"], "ord").alias("origin"), F.max_by(F.element_at("stops", -1)["name"], "ord").alias("destination"))
    firms = segs.groupBy("journey").agg(F.min_by("company", "seg").alias("first_company"), F.max_by("company", "seg").alias("last_company"))
    extra = surcharges(ends.join(firms, "journey"), tariff)
    less = discounts(priced(segs, tariff).select("journey", F.col("label").alias("company")), tariff)
    items = tickets.unionByName(extra).unionByName(less).groupBy("journey").agg(F.sum("yen").cast("long").alias("ticket"), F.sort_array(F.collect_list(F.struct("label", "yen"))).alias("breakdown"))
    sums = express_charges(rides, tariff, RESERVED).groupBy("journey").agg(F.sum("yen").alias("reserved"), F.bool_or("optional").alias("optional"))
    free = express_charges(rides, tariff, NONRESERVED).groupBy("journey").agg(F.sum("yen").alias("nonreserved"))
    all_ = legs.groupBy("journey").agg(F.count_if(F.col("mode") == 1).alias("bus_legs"))
    out = all_.join(items, "journey", "left").join(sums, "journey", "left").join(free, "journey", "left")
    base, charge = F.coalesce("ticket", F.lit(0)), F.coalesce(F.col(seat), F.lit(0))
    choice = lambda c: F.when(F.col("optional"), base + F.col(c))
    return out.select("journey", (base + charge).alias("total"), base.alias("ticket"), charge.alias("express"), choice("reserved").alias("reserved"), choice("nonreserved").alias("nonreserved"), "bus_legs", "breakdown")


def bare(name: Column) -> Column:
    """Station name as in the milepost table."""
    return without_brackets(name)


# JR lines whose names stand without the company, and bare names that belong to subways.
JR_OTHER_NAMES = ["赤羽線", "品鶴線", "山手貨物線", "高島線", "梅田貨物線", "美濃赤坂線", "和田岬線", "海峡線", "利府線", "琵琶湖線", "大和路線", "瀬戸大橋線", "福北ゆたか線", "中央・総武緩行線", "ガーラ湯沢線"]
JR_AMBIGUOUS = ["東西線", "中央線"]


def jr_bare_names(lines: DataFrame) -> DataFrame:
    """(name): names of JR lines (line) without the company; of joint names, the parts too.  Ambiguous ones are left out."""
    whole = F.regexp_replace(F.regexp_extract("line", "^(?:ＪＲ|JR)(.+)$", 1), "[ 　]", "")
    part = F.transform(F.filter(F.split("name", "・"), lambda p: p != ""), lambda p: F.when(p.endswith("線"), p).otherwise(F.concat(p, F.lit("線"))))
    parts = F.when(F.col("name").contains("・"), F.filter(part, lambda p: F.length(p) >= 3)).otherwise(F.array().cast("array<string>"))
    named = lines.select(whole.alias("name")).where("name <> ''")
    found = named.select(F.explode(F.concat(F.array("name"), parts)).alias("name"))
    other = lines.sparkSession.createDataFrame([(x,) for x in JR_OTHER_NAMES], "name string")
    return found.unionByName(other).distinct().where(~F.col("name").isin(JR_AMBIGUOUS))


def station_companies(stations: DataFrame, rules: DataFrame, jr: DataFrame) -> DataFrame:
    """(station, companies): companies that serve a station (station, line), from curated names of lines.

    The rules' company (see ``fares.longest_prefix``), JR's companies as one; without one, JR if the name, up to a
    colon or bracket, is a bullet line or a bare JR name, or a branch of one.  A metro's name that does not hold the
    metro's is nobody's: other cities have lines of that name.
    """
    from chronoline.operators.fares import longest_prefix

    line = F.col("line")
    key = F.regexp_replace(F.split(line, "[:：（(]")[0], "[ 　]", "")
    trunk = F.nullif(F.regexp_extract(key, "^(.+線).+支線$", 1), F.lit(""))
    named = longest_prefix(stations, rules, "line").withColumn("key", key).withColumn("trunk", F.coalesce(trunk, key))
    known = F.broadcast(jr.select(F.col("name").alias("__name")))  # names of a country's lines: some hundreds
    bare = named.join(known.withColumnRenamed("__name", "key").withColumn("a", F.lit(True)), "key", "left").join(known.withColumnRenamed("__name", "trunk").withColumn("b", F.lit(True)), "trunk", "left")
    is_jr = line.rlike("^(ＪＲ|JR)")
    unnamed = F.when(is_jr | key.endswith("新幹線") | F.col("a") | F.col("b"), "JR")
    company = F.when(F.col("company") == "", unnamed).when(F.col("company").startswith("JR") | is_jr, "JR").when((F.col("company") == "東京メトロ") & ~line.contains("東京メトロ"), None).otherwise(F.col("company"))
    return bare.withColumn("c", company).groupBy("station").agg(F.array_sort(F.collect_set("c")).alias("companies"))
