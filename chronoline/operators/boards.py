"""Departure boards by direction, from the stops of trips."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoline.functions.scalars import without_brackets
from chronoline.operators.graph import components, settled
from chronoline.operators.timetable import DAY


def direction_boards(stops: DataFrame, window: int = 8) -> DataFrame:
    """(station, line, direction, label, via, departures array<struct<type,minutes>>).

    stops: (trip, line, type, dest, seq, station, dep).  Departures of a station and line whose next
    ``window`` stops overlap, directly or through others, have one direction, named by its smallest next
    stop.  label: the most frequent destination and, where that is under half, the second.
    """
    ahead = F.collect_list("station").over(W.partitionBy("trip").orderBy("seq").rowsBetween(1, W.unboundedFollowing))
    rows = stops.withColumn("ahead", ahead).where((F.size("ahead") > 0) & F.col("dep").isNotNull())
    rows = rows.select("station", "line", F.coalesce("type", F.lit("")).alias("type"), F.coalesce("dest", F.lit("")).alias("dest"), (F.col("dep") % DAY).alias("minute"), F.col("ahead")[0].alias("next"), F.slice("ahead", 1, window).alias("win"))
    keys = ["station", "line", "next"]
    pieces = rows.select(*keys, F.explode("win").alias("over")).distinct()
    # Pieces that share a stop hang on the smallest of them.
    name = F.concat_ws("|", *keys)
    hub = pieces.groupBy("station", "line", "over").agg(F.min(name).alias("hub"))
    edges = pieces.join(hub, ["station", "line", "over"]).select(name.alias("a"), F.col("hub").alias("b")).distinct()
    found = components(edges).select(F.col("node").alias("name"), F.col("component").alias("c"))
    of = pieces.select(*keys).distinct().withColumn("name", name).join(found, "name").drop("name")
    least = of.groupBy("c").agg(F.min("next").alias("direction"))
    of = settled(of.join(least, "c").drop("c"), "directions")
    each = rows.join(of, keys)
    group = ["station", "line", "direction"]
    via = each.select(*group, F.explode("win").alias("over")).groupBy(*group).agg(F.sort_array(F.collect_set("over")).alias("via"))
    times = each.groupBy(*group, "type").agg(F.sort_array(F.collect_set("minute")).alias("minutes")).groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("type", "minutes"))).alias("departures"))
    bound = each.groupBy(*group, "dest").agg(F.count("*").alias("n")).groupBy(*group).agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "dest"))), 1, 2).alias("top"), F.sum("n").alias("total"))
    first, second = without_brackets(F.col("top")[0]["dest"]), without_brackets(F.get("top", F.lit(1))["dest"])
    both = (-F.col("top")[0]["n"] < F.col("total") * 0.5) & F.coalesce(second != first, F.lit(False))
    labelled = bound.select(*group, F.when(both, F.concat(first, F.lit("・"), second)).otherwise(first).alias("label"))
    return labelled.join(via, group).join(times, group)
