"""Calendars and feed selection."""

from __future__ import annotations

import math
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoline.operators.timetable import stride_pick


def day_selection(trips: DataFrame, group: str, matched: str, order: str, rho: float) -> DataFrame:
    """All matched trips and, up to round-half-even(rho * n) in all, others at equal distances of rank."""
    w = W.partitionBy(group)
    need = F.greatest(F.lit(0), F.least(F.count("*").over(w), F.bround(F.lit(rho) * F.count("*").over(w))) - F.count_if(matched).over(w)).cast("long")
    sized = trips.withColumn("__need", need)
    return sized.where(matched).drop("__need").unionByName(stride_pick(sized.where(~F.col(matched)), [group], [order], F.col("__need")).drop("__need"))


def budgeted_cover(feeds: DataFrame, budget: int) -> DataFrame:
    """(feed, place, used): feeds by falling trips, taken while the union of their stops stays in the budget.

    A feed that would exceed it is left out and smaller ones may follow.  The choice is sequential
    by nature; feeds are few (hundreds), so one group is bounded.
    """

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for r in pdf.sort_values(["trips", "feed"], ascending=[False, True]).itertuples(index=False):
            if len(union := used | set(r.stops)) <= budget:
                used = union
                out.append((r.feed, len(out) + 1, len(used)))
        return pd.DataFrame(out, columns=["feed", "place", "used"])

    return feeds.withColumn("__all", F.lit(1)).groupBy("__all").applyInPandas(choose, "feed string, place long, used long")


def signature(trips: DataFrame, feed: str = "feed") -> DataFrame:
    """(feed, trips, sig): number of trips and a hash of them that does not depend on their order."""
    cols = [c for c in trips.columns if c != feed]
    return trips.groupBy(feed).agg(F.count("*").alias("trips"), F.sum(F.xxhash64(*cols).cast("decimal(38,0)")).alias("sig"))


def feed_order(feeds: DataFrame, rounds: int) -> DataFrame:
    """Add turn: each region's feeds by falling trips, the regions in turn for ``rounds`` rounds; then all others by falling trips."""
    ranked = feeds.withColumn("rank", F.row_number().over(W.partitionBy("region").orderBy(F.desc("trips"), "feed")))
    first = F.col("rank") <= rounds
    key = F.struct(F.when(first, F.col("rank")).otherwise(rounds + 1), F.when(first, F.col("region")).otherwise(""), -F.col("trips"), "feed")
    return ranked.withColumn("turn", F.row_number().over(W.orderBy(key))).drop("rank")


def select_feeds(feeds: DataFrame, budget: int, rounds: int) -> DataFrame:
    """(feed, turn, place, used, reason): feeds taken in ``feed_order`` while their stops stay within the budget.

    feeds: (feed, region, trips, sig, stops array).  Left out, with the reason: 'empty' without trips,
    'same as X' with a taken feed's trips, 'budget' where the union of stops would grow beyond it.
    The choice is sequential by nature; a country's feeds are some hundreds, with tens of thousands of stops.
    """

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        used, seen, out = set(), {}, []
        place = 0
        for r in pdf.sort_values("turn").itertuples(index=False):
            reason, now = None, None
            if not r.trips:
                reason = "empty"
            elif r.sig in seen:
                reason = f"same as {seen[r.sig]}"
            elif len(union := used | set(r.stops)) > budget:
                reason = "budget"
            else:
                used, place = union, place + 1
                seen[r.sig], now = r.feed, place
            out.append((r.feed, r.turn, now, len(used), reason))
        return pd.DataFrame(out, columns=["feed", "turn", "place", "used", "reason"]).astype({"place": "Int64"})

    ordered = feed_order(feeds, rounds).withColumn("sig", F.col("sig").cast("string")).withColumn("__all", F.lit(1))
    return ordered.groupBy("__all").applyInPandas(choose, "feed string, turn int, place long, used long, reason string")


def stable_key(tx: Column) -> Column:
    """What stays of a train's number over its day types: the first and the last of its parts."""
    parts = F.split(tx, "-")
    return F.when(F.size(parts) >= 2, F.concat_ws("|", parts[0], F.element_at(parts, -1))).otherwise(tx)


def new_trains(found: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of ``found`` (tx, first, last, dep) that ``existing`` has neither by tx nor by stable key, ends and departure; each once."""
    sign = lambda df: df.withColumn("key", stable_key(F.col("tx")))
    keys = ["key", "first", "last", "dep"]
    fresh = sign(found).join(existing.select("tx").distinct(), "tx", "left_anti").join(sign(existing).select(*keys).distinct(), keys, "left_anti")
    one = fresh.groupBy(*keys).agg(F.min("tx").alias("tx"))
    return one.select(found.columns)


def inherited_calendar(trains: DataFrame, existing: DataFrame, saturday: DataFrame, sunday: DataFrame) -> DataFrame:
    """``trains`` (tx) with cal: that of the first known train of its stable key, else weekdays and the days whose key sets hold it, else 7.

    existing: (tx, cal, ord); saturday, sunday: (key).
    """
    known = existing.where("cal is not null").groupBy(stable_key(F.col("tx")).alias("key")).agg(F.min_by("cal", "ord").alias("known"))
    days = saturday.select("key", F.lit(2).alias("bit")).unionByName(sunday.select("key", F.lit(4).alias("bit"))).groupBy("key").agg(F.bit_or("bit").alias("days"))
    out = trains.withColumn("key", stable_key(F.col("tx"))).join(known, "key", "left").join(days, "key", "left")
    return out.withColumn("cal", F.coalesce("known", F.col("days").bitwiseOR(F.lit(1)), F.lit(7)).cast("int")).drop("key", "known", "days")


def until_empties(pages: DataFrame, key: str, order: str, empty: Column, most: int = 4) -> DataFrame:
    """Rows of an ordered enumeration up to its end, the first ``most`` empty ones in a row; the others are not looked at."""
    w = W.partitionBy(key).orderBy(order)
    run = F.sum(empty.cast("int")).over(w.rowsBetween(1 - most, 0))
    full = F.count("*").over(w.rowsBetween(1 - most, 0)) == most
    ended = F.max(((run == most) & full).cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1))
    return pages.withColumn("__ended", ended).where(F.coalesce("__ended", F.lit(0)) == 0).drop("__ended")


def fetch_status(code: Column, error: Column) -> Column:
    """'done', 'final' for a page that is not there, 'retry' for whatever may pass."""
    return F.when(code.between(200, 299) & error.isNull(), "done").when(code == 404, "final").otherwise("retry")


def representative_day(trips: DataFrame, day: Column) -> DataFrame:
    """(day, trips): the day with most trips, the earliest on ties."""
    return trips.groupBy(day.alias("day")).agg(F.count("*").alias("trips")).orderBy(F.desc("trips"), "day").limit(1)


def holiday_dates(year: int) -> list[tuple[date, str]]:
    """Public holidays of Japan by the present law, with substitutes and the days between two."""
    nth = lambda month, n: next(d for d in (date(year, month, 1) + timedelta(i) for i in range(7)) if d.weekday() == 0) + timedelta(7 * (n - 1))
    spring = math.floor(20.8431 + 0.242194 * (year - 1980) - (year - 1980) // 4)
    autumn = math.floor(23.2488 + 0.242194 * (year - 1980) - (year - 1980) // 4)
    days = {
        date(year, 1, 1): "fixed", nth(1, 2): "monday", date(year, 2, 11): "fixed", date(year, 2, 23): "fixed", date(year, 3, spring): "equinox", date(year, 4, 29): "fixed",
        date(year, 5, 3): "fixed", date(year, 5, 4): "fixed", date(year, 5, 5): "fixed", nth(7, 3): "monday", date(year, 8, 11): "fixed", nth(9, 3): "monday",
        date(year, 9, autumn): "equinox", nth(10, 2): "monday", date(year, 11, 3): "fixed", date(year, 11, 23): "fixed",
    }
    for d in sorted(days):
        if d.weekday() == 6:
            while d in days:
                d += timedelta(1)
            days[d] = "substitute"
    for d in sorted(days):
        if d + timedelta(2) in days and d + timedelta(1) not in days and (d + timedelta(1)).weekday() not in (6,):
            days[d + timedelta(1)] = "between"
    return sorted(days.items())


def holidays(spark: SparkSession, year: int) -> DataFrame:
    return spark.createDataFrame(holiday_dates(year), "day date, kind string")
