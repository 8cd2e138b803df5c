"""Helpers that the operators of this folder share.

Texts reach Python as Arrow batches only.  The helpers here work on the raw
UTF-8 bytes of a batch: a word is a run of bytes that a 256-entry table allows,
and its identity is a 64-bit hash of its (lower-cased) bytes.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z; every other byte stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words that end at ASCII white space only.
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Bytes of words made of ASCII letters, digits and everything outside ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A local session without one gets a private folder; a cluster without one is an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="chronoline-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def stage_folder(spark: SparkSession) -> str:
    """This application's own folder below the shared one; it goes when the driver ends."""
    sc = spark.sparkContext
    folder = f"{shared_dir(spark)}/chronoline/{sc.applicationId}"
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if not files.exists(path):
        files.mkdirs(path)
        files.deleteOnExit(path)
    return folder


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{stage_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucket_table(df: DataFrame, key: str, name: str) -> DataFrame:
    """Write ``df`` to the shared folder, dealt into buckets by ``key``: later joins and groups on it shuffle the other side only.

    A lost task reads the written rows again, so rows that are numbered while they are written keep their numbers.
    """
    spark = df.sparkSession
    table = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    # Not fewer than the shuffle's partitions, or Spark would deal the rows anew.
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("path", f"{stage_folder(spark)}/{table}").bucketBy(buckets, key).saveAsTable(table)
    out = spark.table(table).select("*")
    out.schema  # resolved: the files outlive the catalogue's entry
    spark.sql(f"DROP TABLE {table}")
    return out


def drop_stage_tables(spark: SparkSession) -> None:
    """Delete the tables that ``stage_table`` wrote in this application; other applications' stay."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(stage_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Shipped:
    """A value that tasks read through ``.value``: broadcast as bytes that need no package to load.

    Spark pickles a broadcast value's classes by reference, which would ask executors for a copy
    of this package; cloudpickle takes classes of registered packages by value.
    """

    def __init__(self, spark: SparkSession, value):
        self._bytes = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        # A worker keeps one broadcast object from task to task, and on it what was loaded.
        if not hasattr(self._bytes, "loaded"):
            self._bytes.loaded = cloudpickle.loads(self._bytes.value)
        return self._bytes.loaded


def packed(x: np.ndarray) -> bytes:
    """Whole numbers as bytes: the bytes of all values apart, compressed; the bytes a value in front."""
    size = x.dtype.itemsize
    planes = np.ascontiguousarray(x.astype(x.dtype.newbyteorder("<"))).view(np.uint8).reshape(-1, size).T.tobytes()
    return bytes([size]) + len(planes).to_bytes(8, "little") + squeezed(planes)


def unpacked(b: bytes) -> np.ndarray:
    size, n = b[0], int.from_bytes(b[1:9], "little")
    raw = np.frombuffer(loosened(b[9:], n), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(raw.T).view(f"<u{size}").ravel()


def squeezed(raw: bytes) -> bytes:
    return pa.compress(raw, codec="zstd", asbytes=True) if raw else b""


def loosened(raw: bytes, size: int) -> bytes:
    return pa.decompress(raw, size, codec="zstd", asbytes=True) if size else b""


def boxed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under helper names ``_0, _1, ...`` and the helper name of each column (of namesakes the first).

    Names with dots or those that an operator uses itself can then not clash with anything.
    """
    helper = [f"_{i}" for i in range(len(docs.columns))]
    return docs.toDF(*helper), dict(zip(docs.columns[::-1], helper[::-1]))


def unboxed(rest: Column, docs: DataFrame) -> list[Column]:
    """The columns of ``docs`` out of a struct of its helper names."""
    return [rest[f"_{i}"].alias(c) for i, c in enumerate(docs.columns)]


def trim() -> None:
    """Give freed memory back to the system; Python workers live on between tasks and stages."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps its memory
        pass


def thrifty(run):
    """A batch function that trims once its partition has ended."""

    def trimmed(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return trimmed


def crc_mod(key: Column, mod: int) -> Column:
    """crc32 of the key as text, modulo ``mod``; a null key counts as the empty string."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def sliced(batch: pa.RecordBatch, name: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that ``name`` holds about ``most`` bytes a piece (one row at least)."""
    _, at = text_bytes(batch.column(name))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def word_spans(raw: np.ndarray, at: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word.

    Words never cross rows.  The third array has one entry more than there are rows.
    """
    inside = allowed[raw]
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cut = at[1:-1]
    cut = cut[(cut > 0) & (cut < len(raw))]
    begins[cut] |= inside[cut]
    ends[cut - 1] |= inside[cut - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, at)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * _K1
        x = (x ^ (x >> np.uint64(29))) * _K2
        return x ^ (x >> np.uint64(32))


def hash_spans(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range ``raw[start:stop]``."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    left = stops - starts
    with np.errstate(over="ignore"):
        out = mix(left.astype(np.uint64) * _K2)
        todo, where, left = None, starts, left
        while True:
            if not len(where):
                return out
            short = np.minimum(left, 8).astype(np.uint64)
            lane = lanes[where]
            keep = np.where(short == 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (short * np.uint64(8))) - np.uint64(1))
            value = mix((out if todo is None else out[todo]) ^ ((lane & keep) + _K1))
            if todo is None:
                out = value
            else:
                out[todo] = value
            more = np.flatnonzero(left > 8)
            todo = more if todo is None else todo[more]
            where, left = where[more] + 8, left[more] - 8


def hash_word(word: bytes) -> int:
    """The hash that ``hash_spans`` gives one word."""
    raw = np.frombuffer(word, np.uint8)
    return int(hash_spans(raw, np.array([0]), np.array([len(raw)]))[0])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges ``start .. start+length``."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
