"""Places of stations: by name, from neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoline.functions.names import stop_name, suffix_place
from chronoline.functions.scalars import haversine_km, planar2, without_brackets
from chronoline.operators.graph import settled


def fill_from_neighbours(points: DataFrame, edges: DataFrame, passes: int = 5, digits: int = 6) -> DataFrame:
    """(station_id, lat, lon, filled): missing places as the mean of their neighbours', in at most ``passes`` passes.

    Each pass uses the places of the pass before, so its result does not depend on any order.
    """
    both = settled(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    now = settled(points.select("station_id", "lat", "lon", F.lit(0).alias("filled")), "places")
    for k in range(1, passes + 1):
        known = now.where("lat is not null").select(F.col("station_id").alias("b"), F.col("lat").alias("nla"), F.col("lon").alias("nlo"))
        mean = both.join(known, "b").groupBy(F.col("a").alias("station_id")).agg(F.round(F.avg("nla"), digits).alias("mla"), F.round(F.avg("nlo"), digits).alias("mlo"))
        new = now.join(mean, "station_id", "left").select(
            "station_id", F.coalesce("lat", "mla").alias("lat"), F.coalesce("lon", "mlo").alias("lon"), F.when(F.col("lat").isNull() & F.col("mla").isNotNull(), k).otherwise(F.col("filled")).alias("filled")
        )
        now = settled(new, "places")
        if now.where(F.col("filled") == k).isEmpty():
            break
    return now


def _overlap(a: Column, b: Column, exact: bool) -> Column:
    """How many pairs of line names agree; unless ``exact``, one may hold the other."""
    same = lambda x, y: x == y if exact else (x == y) | ((x != "") & (y != "") & (x.contains(y) | y.contains(x)))
    each = F.transform(a, lambda x: F.size(F.filter(b, lambda y: same(x, y))))
    return F.aggregate(each, F.lit(0), lambda s, n: s + n)


def resolve_names(asked: DataFrame, places: DataFrame) -> DataFrame:
    """(q, id): the place that each name means, null where none or several do.

    asked: (q, name, lines array); places: (id, name, pref, lines array).  Names agree as they are, else without
    brackets, else in normal form; the first way that finds any decides.  Of several, those whose prefecture holds
    what stands in the name's brackets come first; then the one with most common lines (the smallest id on ties).
    """
    a = asked.select("q", "name", F.col("lines").alias("a_lines"), F.nullif(F.regexp_extract("name", "[（(](.+?)[)）]$", 1), F.lit("")).alias("hint"))
    keys = lambda c: F.array(F.col(c), F.regexp_replace(c, "[（(].*?[)）]$", ""), stop_name(F.col(c)))
    left = a.select("q", "a_lines", "hint", F.posexplode(keys("name")).alias("way", "key"))
    # A place is known by its own name and by its normal form.
    p = places.select("id", "pref", "lines", F.posexplode(F.array("name", "name", stop_name(F.col("name")))).alias("way", "key"))
    met = left.join(p, ["way", "key"]).withColumn("first", F.min("way").over(W.partitionBy("q"))).where("way = first")
    hinted = met.withColumn("fits", F.coalesce(F.col("pref").contains(F.col("hint")), F.lit(False)))
    kept = hinted.withColumn("any", F.max("fits").over(W.partitionBy("q"))).where("fits or not any").withColumn("score", _overlap(F.col("a_lines"), F.col("lines"), False))
    best = kept.groupBy("q").agg(F.count("*").alias("n"), F.max_by("id", F.struct("score", -F.col("id"))).alias("id"), F.max("score").alias("score"))
    return asked.select("q").join(best.where("n = 1 or score > 0").select("q", "id"), "q", "left")


def place_by_name(asked: DataFrame, places: DataFrame, base, centres: list[tuple[str, float, float]], near_km: float = 120.0) -> DataFrame:
    """(q, lat, lon) of names that a place is found for.

    asked: (q, name, lines array of canonical names); places: (name, lat, lon, lines array); base: a Column function
    that gives the name by which both are compared.  Of several candidates the nearest to the centre that the name's
    brackets give, if within ``near_km``; else the one with most lines in common, at least one.
    """
    a = asked.select("q", "name", F.col("lines").alias("a_lines"), base(F.col("name")).alias("key"))
    p = places.select(F.col("lat"), F.col("lon"), "lines", base(F.col("name")).alias("key"))
    met = a.join(p, "key").withColumn("n", F.count("*").over(W.partitionBy("q"))).withColumn("centre", suffix_place(F.col("name"), centres))
    away = haversine_km(F.col("lat"), F.col("lon"), F.col("centre.lat"), F.col("centre.lon"))
    met = met.withColumn("away", F.when((F.col("n") > 1) & (away < near_km), away)).withColumn("score", _overlap(F.col("a_lines"), F.col("lines"), True))
    spot = F.struct("lat", "lon")
    best = met.groupBy("q").agg(F.min_by(spot, F.when(F.col("away").isNotNull(), F.struct("away", "lat", "lon"))).alias("near"), F.max_by(spot, F.when(F.col("score") > 0, F.struct(F.col("score"), -F.col("lat"), -F.col("lon")))).alias("shared"))
    return best.withColumn("x", F.coalesce("near", "shared")).where("x is not null").select("q", "x.lat", "x.lon")


def overwrite_far(points: DataFrame, better: DataFrame, key: str, far_km: float = 2.0) -> DataFrame:
    """``points`` with the better place where its own is missing or more than ``far_km`` from it; state says which."""
    b = better.select(key, F.col("lat").alias("__la"), F.col("lon").alias("__lo"))
    gone = haversine_km(F.col("lat"), F.col("lon"), F.col("__la"), F.col("__lo")) > far_km
    state = F.when(F.col("__la").isNull(), "kept").when(F.col("lat").isNull(), "filled").when(gone, "moved").otherwise("kept")
    out = points.join(b, key, "left").withColumn("state", state)
    take = F.col("state") != "kept"
    return out.withColumn("lat", F.when(take, F.col("__la")).otherwise(F.col("lat"))).withColumn("lon", F.when(take, F.col("__lo")).otherwise(F.col("lon"))).drop("__la", "__lo")


def nearest_namesake(asked: DataFrame, places: DataFrame, most: float = 0.0025) -> DataFrame:
    """(q, id): the only place of a name, else the nearest within ``most`` squared degrees (longitudes shortened).

    asked: (q, key, lat, lon); places: (id, key, lat, lon).
    """
    p = places.select("key", "id", F.col("lat").alias("pla"), F.col("lon").alias("plo"))
    met = asked.join(p, "key").withColumn("n", F.count("*").over(W.partitionBy("q"))).withColumn("d", planar2(F.col("lat"), F.col("lon"), F.col("pla"), F.col("plo")))
    return met.where((F.col("n") == 1) | (F.col("d") < most)).groupBy("q").agg(F.min_by("id", F.struct(F.round("d", 12), "id")).alias("id"))


def name_candidates(asked: DataFrame, stations: DataFrame) -> DataFrame:
    """(q, id): rail stations of exactly the name, else rail by the name without brackets, else any of the name, else any without brackets.

    asked: (q, name); stations: (id, name, mode), mode 0 being rail.
    """
    a = asked.select("q", F.col("name").alias("asked"), without_brackets(F.col("name")).alias("key"))
    met = a.join(stations.withColumn("key", without_brackets(F.col("name"))), "key")
    exact, rail = F.col("name") == F.col("asked"), F.col("mode") == 0
    stage = F.when(exact & rail, 0).when(~exact & rail, 1).when(exact, 2).otherwise(3)
    return met.withColumn("stage", stage).withColumn("best", F.min("stage").over(W.partitionBy("q"))).where("stage = best").select("q", "id")


def bus_to_rail(stops: DataFrame, most_km: float = 0.6) -> DataFrame:
    """(a, b, km): bus stops named after a station, 'X駅...', with the rail stations X at most ``most_km`` away.

    stops: (station_id, name, lat, lon, mode).
    """
    key = F.nullif(F.regexp_extract("name", "^(.+?)駅", 1), F.lit(""))
    bus = stops.where("mode = 1").select(F.col("station_id").alias("a"), F.col("lat").alias("la"), F.col("lon").alias("lo"), key.alias("key"))
    rail = stops.where("mode = 0").select(F.col("station_id").alias("b"), F.col("lat").alias("lb"), F.col("lon").alias("lob"), stop_name(F.col("name")).alias("key"))
    met = bus.withColumn("key", stop_name(F.col("key"))).join(rail, "key").withColumn("km", haversine_km(F.col("la"), F.col("lo"), F.col("lb"), F.col("lob")))
    return met.where(F.col("km") <= most_km).select("a", "b", "km")


def patch(points: DataFrame, manual: DataFrame, most_km: float = 8.0) -> DataFrame:
    """``points`` with the places of ``manual`` (name, lat, lon) and why one was not taken, in ``patched``.

    'yes'; 'ambiguous' if several points have the name; 'far' if the new place is more than ``most_km`` from a known
    one; null for points without a patch.
    """
    m = manual.select("name", F.col("lat").alias("__la"), F.col("lon").alias("__lo"))
    n = F.count("*").over(W.partitionBy("name"))
    out = points.withColumn("__n", n).join(m, "name", "left")
    far = haversine_km(F.col("lat"), F.col("lon"), F.col("__la"), F.col("__lo")) > most_km
    state = F.when(F.col("__la").isNull(), None).when(F.col("__n") > 1, "ambiguous").when(far, "far").otherwise("yes")
    out = out.withColumn("patched", state)
    take = F.coalesce(F.col("patched") == "yes", F.lit(False))
    return out.withColumn("lat", F.when(take, F.col("__la")).otherwise(F.col("lat"))).withColumn("lon", F.when(take, F.col("__lo")).otherwise(F.col("lon"))).drop("__n", "__la", "__lo")
