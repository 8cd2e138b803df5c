"""Stop times, connections, boards: windows and aggregates over trips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chronoline.operators.graph import settled

DAY = 1440


def most_frequent(df: DataFrame, keys: list[str], value: str, name: str, tie: str | None = None) -> DataFrame:
    """The most frequent value for each key; ties go to the smallest ``tie`` (the value itself if none)."""
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("__n"), F.min(tie or value).alias("__tie"))
    return counted.groupBy(*keys).agg(F.min(F.struct((-F.col("__n")).alias("n"), F.col("__tie").alias("t"), F.col(value).alias("v")))["v"].alias(name))


def connections(stop_times: DataFrame, trip: str = "trip_id", seq: str = "seq", station: str = "station_id", t: str = "t") -> DataFrame:
    """Each stop with the trip's next; pairs of one station are left out.  No join: one window a trip."""
    w = W.partitionBy(trip).orderBy(seq)
    pairs = stop_times.select(trip, seq, F.col(station).alias("dep_s"), F.col(t).alias("dep_t"), F.lead(station).over(w).alias("arr_s"), F.lead(t).over(w).alias("arr_t"))
    return pairs.where("arr_s is not null and arr_s <> dep_s")


def unwrap_midnight(stop_times: DataFrame, trip: str, order: str, t: str, name: str) -> DataFrame:
    """Minutes that never fall within a trip: a day is added whenever a known time is below the one before."""
    w = W.partitionBy(trip).orderBy(order)
    known = stop_times.where(F.col(t).isNotNull())
    wraps = F.sum(F.when(F.col(t) < F.col("__before"), DAY).otherwise(0)).over(w)
    return known.withColumn("__before", F.lag(t).over(w)).withColumn(name, (F.col(t) + wraps).cast("long")).drop("__before")


def with_late_night(conn: DataFrame, before: int = 360) -> DataFrame:
    """Connections that leave before ``before`` once more on the next day; ``copy`` tells them apart."""
    late = conn.where(F.col("dep_t") < before).withColumn("dep_t", F.col("dep_t") + DAY).withColumn("arr_t", F.col("arr_t") + DAY)
    return conn.withColumn("copy", F.lit(0)).unionByName(late.withColumn("copy", F.lit(1)))


def islands(df: DataFrame, keys: list[str], order: str, value: Column, name: str = "island") -> DataFrame:
    """Number of the run of equal values that a row belongs to, from 1 within its keys."""
    w = W.partitionBy(*keys).orderBy(order)
    return df.withColumn("__v", value).withColumn(name, F.sum(F.when(F.col("__v").eqNullSafe(F.lag("__v").over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)).over(w)).drop("__v")


def collapse_repeats(stop_times: DataFrame, trip: str, seq: str, place: Column) -> DataFrame:
    """One stop for each run at one place: the first arrival, the last departure."""
    run = islands(stop_times, [trip], seq, place).withColumn("place", place)
    return run.groupBy(trip, "island", "place").agg(F.min_by("t", seq).alias("arr"), F.max_by("t", seq).alias("dep"))


def board_times(stops: DataFrame, trip: str, order: str) -> DataFrame:
    """Null out what the ends of a trip do not have, and arrivals that equal the departure."""
    w = W.partitionBy(trip)
    n, k = F.count("*").over(w), F.row_number().over(w.orderBy(order))
    return stops.withColumn("__n", n).withColumn("__k", k).withColumn("dep2", F.when(F.col("__k") < F.col("__n"), F.col("dep"))).withColumn(
        "arr2", F.when((F.col("__k") > 1) & ((F.col("__k") == F.col("__n")) | (F.col("arr") != F.col("dep"))), F.col("arr"))
    ).drop("__n", "__k")


def timetable(conn: DataFrame, station: int, edge_line: DataFrame | None = None) -> DataFrame:
    """Departures of a station by time: line by the pair's majority, terminal stops left out, visible repeats once."""
    lines = edge_line if edge_line is not None else edge_majority(conn)
    here = conn.where(F.col("dep_s") == station).drop("line").join(lines, ["dep_s", "arr_s"])
    seen = W.partitionBy("dep_t", "line", "type_id", "arr_s").orderBy("trip_id", "seq")
    return here.withColumn("__r", F.row_number().over(seen)).where("__r = 1").select("dep_t", "line", "type_id", "arr_s", "trip_id")


def edge_majority(conn: DataFrame, seen: Column | None = None) -> DataFrame:
    """(dep_s, arr_s, line): the line of most connections between two stations; on ties the one with the
    smallest ``seen``, or the smallest name."""
    if seen is None:
        return most_frequent(conn, ["dep_s", "arr_s"], "line", "line")
    return most_frequent(conn.withColumn("__seen", seen), ["dep_s", "arr_s"], "line", "line", "__seen")


def placed(df: DataFrame, order: list, name: str, ties: bool = False) -> DataFrame:
    """Add each row's place, from 1, in a total order; with ``ties``, equal rows share the first's (a rank).

    Rows are dealt by ranges of the order and written down, so no task holds them all: places within a range, plus
    the rows of the ranges before, whose numbers are one row a range.
    """
    ranged = settled(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).drop("__n")
    within = W.partitionBy("__part").orderBy(*order)
    mine = F.rank() if ties else F.row_number()
    return ranged.withColumn("__mine", mine.over(within)).join(F.broadcast(before), "__part").withColumn(name, (F.col("__mine") + F.col("__before")).cast("long")).drop("__part", "__mine", "__before")


def stride_pick(df: DataFrame, keys: list[str], order: list[str], k: int | Column) -> DataFrame:
    """``k`` rows of each group at equal distances of rank: row floor(i * n / k) for i < k."""
    w = W.partitionBy(*keys)
    want = F.lit(k) if isinstance(k, int) else k
    ranked = df.withColumn("__n", F.count("*").over(w)).withColumn("__r", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__k", F.least(want, F.col("__n")))
    i = F.ceil(F.col("__r") * F.col("__k") / F.col("__n"))
    return ranked.where((F.col("__k") > 0) & (i < F.col("__k")) & (F.floor(i * F.col("__n") / F.col("__k")) == F.col("__r"))).drop("__n", "__r", "__k")


def train_table(records: DataFrame) -> DataFrame:
    """(tx, line, first_dep, stops array<struct<s,a,d>>) of fetched trains (tx, line, error, stops of clock times).

    Trains with an error or fewer than two stops are left out; clock times become minutes.
    """
    from chronoline.functions.names import departure_key
    from chronoline.functions.scalars import minutes

    rows = records.where(F.col("error").isNull() & (F.size("stops") >= 2))
    stops = F.transform("stops", lambda s: F.struct(s["s"].alias("s"), minutes(s["a"]).alias("a"), minutes(s["d"]).alias("d")))
    return rows.select("tx", "line", stops.alias("stops")).withColumn("first_dep", departure_key(F.col("stops")))


def running_best(conn: DataFrame) -> DataFrame:
    """Add best: the earliest arrival that a scan in order of departure has seen at the connection's target so far."""
    w = W.partitionBy("arr_s").orderBy("dep_t", "trip_id", "seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    return conn.withColumn("best", F.min("arr_t").over(w))


def threshold_order(routes: DataFrame, group: str, slack: int = 5) -> DataFrame:
    """Add place within each group: by arrival, unless two are ``slack`` minutes apart or less; then by later departure, likewise; then by transfers.

    The rule is no order of a set (it is not transitive), so a group's few routes are sorted as they come, by ``ord``.
    """
    import functools

    import pandas as pd

    def compare(x, y) -> int:
        for gap in (x.arr - y.arr, y.dep - x.dep):
            if abs(gap) > slack:
                return gap
        return x.transfers - y.transfers

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(pdf.sort_values("ord").itertuples(), key=functools.cmp_to_key(compare))
        return pdf.assign(place=pd.Series({r.Index: k for k, r in enumerate(rows, 1)}))

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in routes.schema)
    return routes.groupBy(group).applyInPandas(place, f"{kind}, place long")


def headway(line: Column, hour: Column, table: dict[str, dict[str, int]], default: dict[str, int]) -> Column:
    """Minutes between trains of a line in the period of an hour, the default's where the line is not in the table."""
    period = F.when(((hour >= 7) & (hour < 9)) | ((hour >= 17) & (hour < 19)), "rush").when((hour >= 9) & (hour < 17), "day").when((hour >= 19) & (hour < 23), "night").otherwise("early")
    of = lambda t: F.create_map(*[x for k, v in t.items() for x in (F.lit(k), F.lit(v))])
    out = F.try_element_at(of(default), period)
    for name, entry in table.items():
        out = F.when(line == name, F.try_element_at(of(entry), period)).otherwise(out)
    return out
