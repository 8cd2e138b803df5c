"""Fares: bands, special pairs, surcharges, transfers, charges and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def band_fare(legs: DataFrame, bands: DataFrame, km: Column, keys: list[str], name: str = "fare", whole: bool = True) -> DataFrame:
    """Add the fare of the first band that reaches the distance (rounded up if ``whole``), the last band's beyond all.

    bands: (keys, ord, max_km, yen), a rule table of at most some thousand rows: gathered per
    key into an array, so that the lookup is one equi-join and a filter, not a range join.
    """
    table = bands.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", "max_km", "yen"))).alias("__bands"))
    reach = F.ceil(km) if whole else km
    fits = F.filter("__bands", lambda b: reach <= b["max_km"])
    found = F.coalesce(F.try_element_at(fits, F.lit(1))["yen"], F.try_element_at("__bands", F.lit(-1))["yen"])
    return legs.join(F.broadcast(table), keys, "left").withColumn(name, F.coalesce(found, F.round(km * 25).cast("int"))).drop("__bands")


def special_pair(legs: DataFrame, special: DataFrame, a: str, b: str, name: str = "special") -> DataFrame:
    """Add the special fare of an unordered pair of stations; null where there is none."""
    table = special.select(F.least("a", "b").alias("__a"), F.greatest("a", "b").alias("__b"), F.col("yen").alias(name))
    return legs.join(F.broadcast(table), (F.least(a, b) == F.col("__a")) & (F.greatest(a, b) == F.col("__b")), "left").drop("__a", "__b")


def longest_prefix(names: DataFrame, rules: DataFrame, name: str) -> DataFrame:
    """Add the company whose rule fits: an exact match first, then the longest prefix, then ''.

    rules: (kind 'match' or 'prefix', text, company), a small rule table.
    """
    r = F.broadcast(rules.select(F.col("kind").alias("__kind"), F.col("text").alias("__text"), F.col("company").alias("__company")))
    fits = ((F.col("__kind") == "match") & (F.col(name) == F.col("__text"))) | ((F.col("__kind") == "prefix") & F.col(name).startswith(F.col("__text")))
    best = names.select(name).distinct().join(r, fits).groupBy(name).agg(F.max_by("__company", F.struct(F.col("__kind") == "match", F.length("__text"))).alias("company"))
    return names.join(best, name, "left").withColumn("company", F.coalesce("company", F.lit("")))


def first_substring(text: Column, rules: list[tuple[str, object]]) -> Column:
    """Value of the first rule, in order, whose name the text contains; null if none does."""
    out = F.lit(None)
    for name, value in reversed(rules):
        out = F.when(text.contains(name), F.lit(value)).otherwise(out)
    return out


def charges(units: DataFrame, journey: str, order: str) -> DataFrame:
    """Halve the charge of a paid train next to a bullet train in its journey, down to ten yen."""
    w = W.partitionBy(journey).orderBy(order)
    beside = (F.lag("kind").over(w) == "shinkansen") | (F.lead("kind").over(w) == "shinkansen")
    return units.withColumn("charge", F.when((F.col("kind") == "paid") & F.coalesce(beside, F.lit(False)), F.floor(F.col("yen") / 20) * 10).otherwise(F.col("yen")).cast("long"))


def budget_limit(text: Column) -> Column:
    """A positive number, or null for no limit."""
    n = F.try_to_number(text, F.lit("999999999")).cast("double")
    return F.when(n > 0, n)


def with_budget(journeys: DataFrame, limit: Column, total: str = "fare", least: str = "min_fare") -> DataFrame:
    """Add unknown, over, over_by and seat_hint; a null fare is unknown and never over."""
    over = F.coalesce(F.col(least) > limit, F.lit(False))
    return (
        journeys.withColumn("unknown", F.col(total).isNull())
        .withColumn("over", over)
        .withColumn("over_by", F.when(over, F.col(least) - limit).otherwise(0))
        .withColumn("seat_hint", F.when((F.col(total) > limit) & (F.col(least) <= limit), "nonreserved"))
    )


def within_budget_or_cheapest(journeys: DataFrame, group: str) -> DataFrame:
    """Drop what is over budget wherever something is within it; else keep all."""
    any_within = F.count_if(~F.col("over") & ~F.col("unknown")).over(W.partitionBy(group)) > 0
    return journeys.withColumn("__any", any_within).where("not __any or not over").drop("__any")


def score(arr: Column, transfers: Column, fare: Column, least: Column, paid: Column) -> Column:
    """Arrival, four minutes a transfer, a minute for each 40 yen above the least fare (120 at most, 18 at least if paid)."""
    extra = F.least((fare - least) / 40, F.lit(120.0))
    known = F.when(paid, F.greatest(extra, F.lit(18.0))).otherwise(extra)
    return arr + 4 * transfers + F.when(fare.isNull(), F.when(paid, 18.0).otherwise(0.0)).otherwise(known)
