"""Platform inference: line, type and direction scores, then staged choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chronoline.functions.scalars import line_key


# Through services and the lines under which stations list them.
THROUGH = {"上野東京ライン": ["東海道", "宇都宮", "高崎", "常磐"]}


def line_score(entry: Column, leg: Column) -> Column:
    """2: the same line; 1: one name holds the other, or parts of compound names do; 0: else.

    A bullet line and another never match.
    """
    a, b = line_key(entry), line_key(leg)
    parts = lambda c: F.filter(F.split(c, "・"), lambda x: F.length(x) >= 2)
    compound = a.contains("・") | b.contains("・")
    meet = F.exists(parts(a), lambda x: F.exists(parts(b), lambda y: x.contains(y) | y.contains(x)))
    bullet = F.coalesce(entry, F.lit("")).contains("新幹線") != F.coalesce(leg, F.lit("")).contains("新幹線")
    return F.when((a == "") | (b == "") | bullet, 0).when(a == b, 2).when(a.contains(b) | b.contains(a), 1).when(compound & meet, 1).otherwise(0)


def entry_score(entry: Column, heading: Column, leg: Column) -> Column:
    """``line_score``; else 1 where an entry without a line stands under a heading that names the line or its
    operator, or where the line is a through service that the table lists under a line it runs on."""
    score, op, line = line_score(entry, leg), line_key(heading), line_key(leg)
    no_line = F.coalesce(entry, F.lit("")) == ""
    bullet = F.coalesce(leg, F.lit("")).contains("新幹線") & ~F.coalesce(heading, F.lit("")).contains("新幹線")
    bare = F.regexp_replace(op, "電鉄|鉄道", "")
    headed = (op != "") & (line != "") & ~bullet & (op.contains(line) | line.contains(bare))
    through = F.lit(False)
    for name, runs_on in THROUGH.items():
        through = through | ((line == name) & F.exists(F.array(*map(F.lit, runs_on)), lambda x: line_key(entry).contains(x)))
    return F.when(score > 0, score).when(no_line & headed, 1).when(~no_line & through, 1).otherwise(0)


def hints_in(text: Column, stations: Column) -> Column:
    """How many of the stations (two characters or more) the text names."""
    return F.size(F.filter(F.coalesce(stations, F.array().cast("array<string>")), lambda s: (F.length(s) >= 2) & text.contains(s)))


def type_matches(cell: Column, kind: Column) -> Column:
    """A type cell names the kind, a synonym of it, or begins with it."""
    words = F.filter(F.split(cell, "[・、/\\s]+"), lambda x: x != "")
    same = F.when(kind == "普通", "各駅停車").when(kind.isin("各駅停車", "各停"), F.when(kind == "各停", "各駅停車").otherwise("普通"))
    return F.coalesce(F.exists(words, lambda x: (x == kind) | F.coalesce(x == same, F.lit(False)) | x.startswith(kind)), F.lit(False)) & (F.coalesce(kind, F.lit("")) != "")


def match(legs: DataFrame, entries: DataFrame) -> DataFrame:
    """(leg, track): the track of each leg, where line, type and direction decide one.

    legs: (leg, station, line, kind, ahead, behind); entries: (station, ord, track, line, type, dest).
    Candidates are staged: by type where an entry names one, by the best direction score if any is
    positive, else by no contrary direction, then by line; one track left decides, and two or three
    numeric tracks of one direction are joined.
    """
    e = entries.select("station", "ord", "track", F.col("line").alias("e_line"), F.col("type").alias("e_type"), F.coalesce("dest", F.lit("")).alias("dest"))
    c = legs.join(e, "station").withColumn("ls", line_score(F.col("e_line"), F.col("line"))).where("ls > 0")
    by_leg = W.partitionBy("leg")
    c = c.withColumn("fits", type_matches(F.col("e_type"), F.col("kind")))
    c = c.withColumn("any_fit", F.max("fits").over(by_leg)).where("fits or not any_fit")
    c = c.withColumn("n", F.count("*").over(by_leg)).withColumn("ds", hints_in(F.col("dest"), F.col("ahead")) - hints_in(F.col("dest"), F.col("behind")))
    c = c.withColumn("top", F.max("ds").over(by_leg)).withColumn("level", F.count_if(F.col("ds") == 0).over(by_leg) > 0)
    c = c.withColumn("directed", F.col("top") > 0)
    c = c.where(F.when(F.col("directed"), F.col("ds") == F.col("top")).when(F.col("level"), F.col("ds") == 0).otherwise(True))
    c = c.withColumn("best", F.max("ls").over(by_leg)).where("ls = best")
    found = c.groupBy("leg").agg(
        F.array_sort(F.collect_set("track")).alias("tracks"), F.count("*").alias("left"), F.first("n").alias("n"), F.first("directed").alias("directed"), F.collect_set("dest").alias("dests"), F.min_by("dest", "ord").alias("dest")
    )
    numeric = F.forall("tracks", lambda t: t.rlike("^[0-9]+$"))
    ordered = F.array_join(F.transform(F.array_sort(F.transform("tracks", lambda t: F.lpad(t, 6, "0"))), lambda t: F.regexp_replace(t, "^0+", "")), "・")
    one = (F.size("tracks") == 1) & (F.col("directed") | (F.col("left") < F.col("n")) | (F.col("left") == 1))
    several = F.size("tracks").between(2, 3) & numeric & (F.col("directed") | ((F.size("dests") == 1) & (F.col("dest") != "")))
    return found.select("leg", F.when(one, F.element_at("tracks", 1)).when(several, ordered).alias("track")).where("track is not null")


def format_track(track: Column) -> Column:
    return F.when(F.coalesce(track, F.lit("")) == "", "").otherwise(F.concat(F.regexp_replace(F.regexp_replace(track, r"\s*-\s*", "-"), r"\s+", ""), F.lit("番線")))


def attach(legs: DataFrame, entries: DataFrame) -> DataFrame:
    """Add the track to legs (leg, station, shown, line, kind, stops, at, dest): that of the displayed line, else of the raw one.

    stops: names of the train's stops; at: the number of the station among them, from 0.  Ahead are the later stops
    and the destination, behind the earlier ones.
    """
    ahead = F.array_union(F.slice("stops", F.col("at") + 2, F.greatest(F.size("stops") - F.col("at") - 1, F.lit(0))), F.when(F.col("dest").isNotNull(), F.array("dest")).otherwise(F.array().cast("array<string>")))
    asked = legs.select("leg", "station", "shown", "line", "kind", ahead.alias("ahead"), F.slice("stops", 1, F.col("at")).alias("behind"))
    shown = match(asked.withColumn("line", F.col("shown")).drop("shown"), entries).withColumnRenamed("track", "t1")
    raw = match(asked.drop("shown"), entries).withColumnRenamed("track", "t2")
    return legs.join(shown, "leg", "left").join(raw, "leg", "left").withColumn("track", F.coalesce("t1", "t2")).drop("t1", "t2")
