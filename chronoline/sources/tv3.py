"""The packed timetable format: read and write.

Little-endian: magic ``TV3`` and a zero byte, u32 trips, u32 stops, u32[trips + 1] offsets,
then u16[stops] station, arrival and departure, each section padded to four bytes; 65535 is
null.  Gzip is recognised by its magic bytes.
"""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC, NULL, MOST_STATIONS = b"TV3\0", 65535, 65535


def _pad(n: int) -> int:
    return -n % 4


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, stations, arrivals, departures.  Raises on markup, a wrong magic or a short file."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    if data[:1] == b"<":
        raise ValueError("markup instead of a timetable")
    if data[:4] != MAGIC:
        raise ValueError("not a packed timetable")
    trips, stops = struct.unpack_from("<II", data, 4)
    at, parts = 12, []
    for kind, n in (("<u4", trips + 1), ("<u2", stops), ("<u2", stops), ("<u2", stops)):
        size = n * int(kind[-1])
        if at + size > len(data):
            raise ValueError("the packed timetable is cut off")
        parts.append(np.frombuffer(data, kind, n, at))
        at += size + _pad(size)
    return tuple(parts)


def pack(trips: list[list[tuple[int, int | None, int | None]]], compress: bool = True) -> bytes:
    """Bytes of trips of (station, arrival, departure); equal input gives equal bytes."""
    flat = [s for t in trips for s in t]
    if any(not 0 <= s[0] < MOST_STATIONS for s in flat):
        raise ValueError("a station number is out of range")
    out = [MAGIC, struct.pack("<II", len(trips), len(flat))]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in trips])]) if trips else np.zeros(1)
    for section in (offsets.astype("<u4"), *[np.array([NULL if s[k] is None else s[k] for s in flat], "<u2") for k in range(3)]):
        raw = section.tobytes()
        out += [raw, b"\0" * _pad(len(raw))]
    body = b"".join(out)
    return gzip.compress(body, 9, mtime=0) if compress else body


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, trip, seq, station_id, arr, dep) of all packed files under a path, one task a file."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part["path"], part["content"]):
                offsets, station, arr, dep = unpack(content)
                sizes = np.diff(offsets.astype(np.int64))
                trip = np.repeat(np.arange(len(sizes)), sizes)
                known = lambda x: pd.array(x.astype("int64"), "Int64").copy()
                a, d = known(arr), known(dep)
                a[arr == NULL], d[dep == NULL] = pd.NA, pd.NA
                yield pd.DataFrame({"file": name.rsplit("/", 1)[-1], "trip": trip, "seq": np.arange(len(trip)) - np.repeat(offsets[:-1].astype(np.int64), sizes), "station_id": station.astype("int64"), "arr": a, "dep": d})

    return files.mapInPandas(rows, "file string, trip long, seq long, station_id long, arr long, dep long")


def guarded(spark: SparkSession, path: str) -> DataFrame:
    """(file, trips, error) of all files under a path, judged by the tasks that read them: error says why one is no timetable."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def judge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for name, content in zip(part["path"], part["content"]):
                try:
                    out.append((name.rsplit("/", 1)[-1], len(unpack(content)[0]) - 1, None))
                except (ValueError, EOFError, OSError, struct.error) as error:
                    out.append((name.rsplit("/", 1)[-1], None, str(error)))
            yield pd.DataFrame(out, columns=["file", "trips", "error"]).astype({"trips": "Int64"})

    return files.mapInPandas(judge, "file string, trips long, error string")


def packed(stop_times: DataFrame, trip: str = "trip_id", seq: str = "seq", station: str = "station_id", arr: str = "arr", dep: str = "dep", by: str | None = None) -> DataFrame:
    """(by, content binary): one packed file for each value of ``by``, trips in their order.

    The format numbers a whole network's trips in one file, so a group must fit in a task.
    """
    keyed = stop_times.withColumn("__by", F.col(by) if by else F.lit(0))

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        none = lambda x: None if pd.isna(x) else int(x)
        trips = [[(int(s), none(a), none(d)) for s, a, d in g[[station, arr, dep]].itertuples(index=False, name=None)] for _, g in pdf.sort_values([trip, seq]).groupby(trip, sort=True)]
        return pd.DataFrame({"by": [str(pdf["__by"].iloc[0])], "content": [pack(trips)]})

    return keyed.groupBy("__by").applyInPandas(write, "by string, content binary")


def nested(stop_times: DataFrame, trip: str = "trip") -> DataFrame:
    """(trip, stops array<struct<seq,station_id,arr,dep>>): the rows of a trip gathered in order."""
    return stop_times.groupBy(trip).agg(F.array_sort(F.collect_list(F.struct("seq", "station_id", "arr", "dep"))).alias("stops"))
