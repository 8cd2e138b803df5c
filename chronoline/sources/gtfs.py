"""GTFS feeds: zipped CSV tables, catalogues, manifests."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoline.functions.scalars import minutes


def members(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(feed, line, fields map<string,string>, short boolean): rows of one member of all zips under a path.

    A byte-order mark is dropped, a missing member gives no rows, and a row with too few
    fields is marked short, so that it can be counted and left out.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for where, content in zip(part["path"], part["content"]):
                feed, out = where.rsplit("/", 1)[-1].removesuffix(".zip"), []
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    if name in z.namelist():
                        reader = csv.reader(io.StringIO(z.read(name).decode("utf-8-sig")))
                        head = [h.strip() for h in next(reader, [])]
                        out = [(feed, i, dict(zip(head, r)), len(r) < len(head)) for i, r in enumerate(reader) if r]
                yield pd.DataFrame(out, columns=["feed", "line", "fields", "short"])

    return files.mapInPandas(rows, "feed string, line long, fields map<string,string>, short boolean")


def stops(raw: DataFrame) -> DataFrame:
    """(stop, name, lat, lon): ids qualified by their feed; places that are no numbers are null."""
    f = F.col("fields")
    return raw.where("not short").select(F.concat_ws(":", "feed", f["stop_id"]).alias("stop"), f["stop_name"].alias("name"), f["stop_lat"].try_cast("double").alias("lat"), f["stop_lon"].try_cast("double").alias("lon"))


def stop_times(raw: DataFrame) -> DataFrame:
    f = F.col("fields")
    return raw.where("not short").select(
        F.concat_ws(":", "feed", f["trip_id"]).alias("trip"), f["stop_sequence"].try_cast("int").alias("seq"), F.concat_ws(":", "feed", f["stop_id"]).alias("stop"), minutes(f["arrival_time"]).alias("arr"), minutes(f["departure_time"]).alias("dep")
    )


def service_days(calendar: DataFrame, exceptions: DataFrame, first: Column, days: int) -> DataFrame:
    """(service, day): the weekly pattern over ``days`` days, then exceptions in file order (1 adds, 2 removes).

    calendar: (service, week array<int> from Monday, start, stop); exceptions: (service, day, kind, line).
    """
    span = F.explode(F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda i: F.date_add(first, i)))
    weekly = calendar.withColumn("day", span).where((F.col("day") >= F.col("start")) & (F.col("day") <= F.col("stop")) & (F.element_at("week", F.weekday("day") + 1) == 1)).select("service", "day")
    last = exceptions.groupBy("service", "day").agg(F.max_by("kind", "line").alias("kind"))
    return weekly.join(last.where("kind = 2"), ["service", "day"], "left_anti").unionByName(last.where("kind = 1").select("service", "day")).distinct()


def allowed(catalogue: DataFrame, licences: list[str], skip: list[str], today: Column) -> DataFrame:
    """Feeds with an allowed licence that have not ended and are not on the skip list; ``key`` is a slug of operator and feed."""
    slug = F.regexp_replace(F.lower(F.concat_ws("-", "operator", "feed")), "[^a-z0-9]+", "-")
    return catalogue.where(F.col("license").isin(licences) & (F.col("until").isNull() | (F.col("until") >= today)) & ~F.col("feed").isin(skip)).withColumn("key", slug)


def as_of(versions: DataFrame, key: str, since: str, today: Column) -> DataFrame:
    """The latest version up to today for each key, else the earliest one."""
    past = F.col(since) <= today
    best = F.max_by(F.struct("*"), F.struct(past, F.when(past, F.unix_date(since)).otherwise(-F.unix_date(since))))
    return versions.groupBy(F.col(key).alias("__key")).agg(best.alias("r")).select("r.*")


def changed(files: DataFrame, manifest: DataFrame, least: int = 200) -> DataFrame:
    """(key, content, sha256, status): 'new', 'same' or 'error' (under ``least`` bytes) against the manifest's hashes."""
    hashed = files.withColumn("sha256", F.sha2("content", 256)).join(manifest.select("key", F.col("sha256").alias("__old")), "key", "left")
    return hashed.withColumn("status", F.when(F.length("content") < least, "error").when(F.col("sha256") == F.col("__old"), "same").otherwise("new")).drop("__old")


def upsert(manifest: DataFrame, new: DataFrame, catalogue: DataFrame | None = None) -> DataFrame:
    """Rows of ``new`` replace those of the manifest; with a catalogue, keys that it lacks go."""
    merged = manifest.join(new.select("key"), "key", "left_anti").unionByName(new.select(manifest.columns))
    return merged if catalogue is None else merged.join(catalogue.select("key"), "key", "left_semi")


def feed_info(raw: DataFrame) -> DataFrame:
    """(feed, publisher, url, since, until): the first row of each feed's feed_info member."""
    f = F.col("fields")
    day = lambda c: F.try_to_timestamp(f[c], F.lit("yyyyMMdd")).cast("date")
    first = raw.groupBy("feed").agg(F.min_by("fields", "line").alias("fields"))
    return first.select("feed", f["feed_publisher_name"].alias("publisher"), f["feed_publisher_url"].alias("url"), day("feed_start_date").alias("since"), day("feed_end_date").alias("until"))
