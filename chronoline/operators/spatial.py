"""Joins by distance: cells first, so that only neighbours meet."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoline.functions.scalars import haversine_km, planar2, walk_minutes
from chronoline.operators.graph import components, settled

NEAR_KM = 0.4


def cell_for(km: float, farthest: float = 60.0) -> float:
    """Degrees of a cell whose neighbours hold all that is at most ``km`` away, up to ``farthest`` degrees north or south."""
    return km * 1.001 / (111.19 * math.cos(math.radians(farthest)))


def within(points: DataFrame, km: float = NEAR_KM, cell: float | None = None, key: str = "station_id") -> DataFrame:
    """(a, b, km, mode_a, mode_b): pairs a < b at most ``km`` apart, by an equi-join of cells with their neighbours.

    The cell follows from ``km`` for places up to 60 degrees north or south; give a larger one beyond.
    """
    cell = cell_for(km) if cell is None else cell
    floor = lambda c: F.floor(F.col(c) / cell).cast("long")
    placed = points.where("lat is not null and lon is not null").withColumn("cy", floor("lat")).withColumn("cx", floor("lon"))
    near = placed.withColumn("dy", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn("dx", F.explode(F.array(*map(F.lit, (-1, 0, 1)))))
    a = near.select(F.col(key).alias("a"), F.col("lat").alias("la"), F.col("lon").alias("lo"), F.col("mode").alias("mode_a"), (F.col("cy") + F.col("dy")).alias("cy"), (F.col("cx") + F.col("dx")).alias("cx"))
    b = placed.select(F.col(key).alias("b"), F.col("lat").alias("lb"), F.col("lon").alias("lob"), F.col("mode").alias("mode_b"), "cy", "cx")
    pairs = a.join(b, ["cy", "cx"]).where("a < b").withColumn("km", haversine_km(F.col("la"), F.col("lo"), F.col("lb"), F.col("lob")))
    return pairs.where(F.col("km") <= km).select("a", "b", "km", "mode_a", "mode_b")


def footpaths(points: DataFrame, km: float = NEAR_KM) -> DataFrame:
    """(a, b, walk): walks between near stations, unless both are bus stops."""
    return within(points, km).where("not (mode_a = 1 and mode_b = 1)").select("a", "b", walk_minutes(F.col("km")).alias("walk"))


def same_name_walks(points: DataFrame, name: str, most: int = 8, km: float = 1.2) -> DataFrame:
    """(a, b, km): pairs of one base name, in groups of 2 to ``most``, at most ``km`` apart."""
    sized = points.join(points.groupBy(name).agg(F.count("*").alias("__n")).where(F.col("__n").between(2, most)), name)
    a, b = sized.alias("a"), sized.alias("b")
    d = haversine_km(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    return a.join(b, [name]).where("a.station_id < b.station_id").select(F.col("a.station_id").alias("a"), F.col("b.station_id").alias("b"), d.alias("km")).where(F.col("km") <= km)


def nearest(points: DataFrame, anchors: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name): the nearest anchor of each point in the plane, the first by ``ord`` on ties.

    anchors: a fixed list (name, ord, lat, lon), broadcast.
    """
    small = F.broadcast(anchors.select(F.col(name).alias("__name"), F.col("ord").alias("__ord"), F.col("lat").alias("__la"), F.col("lon").alias("__lo")))
    d = planar2(F.col("lat"), F.col("lon"), F.col("__la"), F.col("__lo"))
    return points.join(small, F.lit(True)).groupBy(key).agg(F.min(F.struct(F.round(d, 12).alias("d"), "__ord", "__name"))["__name"].alias(name))


def cluster_stops(stops: DataFrame, name: Column, merge_km: float = 0.1, depth: int = 8) -> tuple[DataFrame, DataFrame]:
    """((id, cluster), (cluster, name, lat, lon, stops)): stops of one place.

    stops: (id, name, lat, lon, parent).  A stop stands for its outermost parent (up to ``depth``
    above it; a parent that is no stop counts for none); those of one normal ``name`` at most ``merge_km``
    apart are one.  A cluster is known by its smallest root; its place is the mean of its stops', its
    name the most frequent (the smallest on ties).
    """
    up = stops.select(F.col("id").alias("child"), F.col("parent").alias("above"))
    known = stops.select(F.col("id").alias("above"))
    up = settled(up.join(known, "above").where("child != above"), "parents")
    root = stops.select("id", F.col("id").alias("root"))
    for _ in range(depth):
        above = up.select(F.col("child").alias("root"), "above")
        root = root.join(above, "root", "left").select("id", F.coalesce("above", "root").alias("root"))
    root = settled(root, "roots")
    tops = stops.join(root.select("root").distinct().withColumnRenamed("root", "id"), "id").select("id", "lat", "lon", F.lit(0).alias("mode"), name.alias("key"))
    near = within(tops, merge_km, key="id").select("a", "b")
    names = tops.select("id", "key")
    same = near.join(names.select(F.col("id").alias("a"), F.col("key").alias("ka")), "a").join(names.select(F.col("id").alias("b"), F.col("key").alias("kb")), "b").where("ka = kb")
    joined = components(same.select("a", "b"))
    member = settled(root.join(joined.select(F.col("node").alias("root"), F.col("component").alias("c")), "root", "left").select("id", F.coalesce("c", "root").alias("cluster")), "members")
    each = stops.join(member, "id")
    often = each.groupBy("cluster", "name").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.min_by("name", F.struct(-F.col("n"), "name")).alias("name"))
    place = each.groupBy("cluster").agg(F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lon"), 6).alias("lon"), F.count("*").alias("stops"))
    return member, place.join(often, "cluster").select("cluster", "name", "lat", "lon", "stops")


def all_footpaths(stops: DataFrame, names: DataFrame, km: float = NEAR_KM) -> DataFrame:
    """(a, b, walk), a < b: the least walk of each pair among near stops, stations of one base name and bus stops named after a station.

    stops: (station_id, name, lat, lon, mode); names: the stops with their base name, as ``same_name_walks`` takes them.
    """
    from chronoline.operators.geocode import bus_to_rail

    walk = walk_minutes(F.col("km")).alias("walk")
    named = same_name_walks(names, "base").select("a", "b", walk)
    by_bus = bus_to_rail(stops).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), walk)
    return footpaths(stops, km).unionByName(named).unionByName(by_bus).groupBy("a", "b").agg(F.min("walk").alias("walk"))
