"""Document fingerprints by Order MinHash.

A text's k-mers (of bytes) are numbered by occurrence.  One hash deals the numbered
k-mers to BINS bins; each bin selects its DEPTH smallest, puts them back into text
order and hashes that tuple.  A changed order of the same k-mers thus changes the
signature, as it changes the edit distance.  The likeness of two fingerprints is the
share of bins, among those that either fills, whose tuples agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from chronoline.llm.common import mix, sliced, stage_table

K, BINS, DEPTH = 8, 64, 2
_C = np.uint64(0xD6E8FEB86659FD93)


def signature(text: str) -> np.ndarray:
    """BINS numbers of 16 bits; 0 marks an empty bin."""
    raw = np.frombuffer(text.encode(), np.uint8)
    out = np.zeros(BINS, np.uint16)
    if not len(raw):
        return out
    n = max(1, len(raw) - K + 1)
    padded = np.concatenate([raw, np.zeros(K, np.uint8)])
    lanes = np.ndarray((n,), "<u8", padded, strides=(1,))
    low = np.uint64(max(20, int(n).bit_length()))
    place = np.arange(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        first = (mix(lanes + _C) >> low << low) | place
        first.sort()
        name, place = first >> low, first & ((np.uint64(1) << low) - np.uint64(1))
        new = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
        seen = np.arange(n) - np.repeat(new, np.diff(np.append(new, n)))
        second = (mix(name * _C + seen.astype(np.uint64)) >> low << low) | place
        second.sort()
        cut = np.searchsorted(second, np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1))
        size = np.diff(np.append(cut, n))
        total = np.zeros(BINS, np.uint64)
        chosen = np.zeros((DEPTH, BINS), np.uint64)
        where = np.full((DEPTH, BINS), np.iinfo(np.int64).max)
        for k in range(DEPTH):
            full = size > k
            at = second[cut[full] + k]
            chosen[k, full] = (at >> low) + np.uint64(1)
            where[k, full] = (at & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
        chosen = np.take_along_axis(chosen, np.argsort(where, axis=0, kind="stable"), 0)
        for k in range(DEPTH):
            total = mix(total * _C + chosen[k])
    return np.where(size > 0, (total % np.uint64(65535)).astype(np.uint16) + np.uint16(1), out)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of agreeing bins among those that are not empty in both; 1 for two empty texts."""
    full = (a != 0) | (b != 0)
    return float(((a == b) & full).sum() / full.sum()) if full.any() else 1.0


def as_text(s: np.ndarray) -> str:
    return s.astype(">u2").tobytes().hex()


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint string of 4 * BINS hex digits) of every row; a null text is empty."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def take(batches):
        for batch in batches:
            yield pa.record_batch([batch.column("key"), pa.array([as_text(signature(t or "")) for t in batch.column("text").to_pylist()], pa.string())], ["key", "fingerprint"])

    return rows.mapInArrow(take, f"key {rows.schema['key'].dataType.simpleString()}, fingerprint string").withColumnRenamed("key", key)


def _part(key: Column, cuts: list) -> Column:
    """Number of the range of a key: 0 holds the largest keys, null keys come last."""
    if not cuts:
        return F.lit(0)
    at = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c > key)) if len(cuts) < 64 else _tree(key, cuts, 0, len(cuts))
    return F.when(key.isNull(), F.lit(len(cuts))).otherwise(at).cast("int")


def _tree(key: Column, cuts: list, lo: int, hi: int) -> Column:
    """Binary search by nested conditions: how many of the falling cuts exceed the key."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(F.lit(cuts[mid]) > key, _tree(key, cuts, mid + 1, hi)).otherwise(_tree(key, cuts, lo, mid))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (part, tail, key, text), to be dealt out by part: each part holds a range of keys in falling
    order and, as its last row (tail 1), a copy of the row that follows its range.

    Order: falling keys, null keys last, ties by text; the row after the last is the first.
    Ranges are cut at quantiles of the keys, if they are numbers, else by a range shuffle that is
    written down; only the first keys of the ranges are gathered, one for each range.
    """
    spark = docs.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if isinstance(rows.schema["key"].dataType, NumericType):
        marks = rows.agg(F.percentile_approx("key", F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(20 * parts))).first()[0]
        cuts = sorted({m for m in marks or []}, reverse=True)
        rows = rows.withColumn("part", _part(F.col("key"), cuts))
    else:
        rows = stage_table(rows.repartitionByRange(parts, F.desc_nulls_last("key")).withColumn("part", F.spark_partition_id()), "ranges")
    heads = rows.groupBy("part").agg(F.max("key").alias("key")).orderBy("part").collect()  # one row a range
    if not heads:
        return rows.select("part", F.lit(0).alias("tail"), "key", "text")
    after = [(heads[i].part, heads[(i + 1) % len(heads)].key) for i in range(len(heads))]
    kind = rows.schema["key"].dataType.simpleString()
    wanted = F.broadcast(spark.createDataFrame(after, f"to int, head {kind}"))
    tails = rows.join(wanted, F.col("key").eqNullSafe(F.col("head"))).groupBy("to", "key").agg(F.min("text").alias("text"))
    return rows.select("part", F.lit(0).alias("tail"), "key", "text").unionByName(tails.select(F.col("to").alias("part"), F.lit(1).alias("tail"), "key", "text"))


def edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's fingerprint, its edited text's, and their likeness to each other and to the next row's.

    The edited text replaces the last floor(n_chars / 3) code points by the first as many (or
    all) of the next row; see ``with_next`` for the order and for ties, nulls and repeated rows.
    A single row is its own next.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = with_next(docs, key, text)
    kind = rows.schema["key"].dataType.simpleString()

    def walk(batches) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for piece in sliced(batch, "text", 1 << 20):
                out = []
                for part, tail, k, t in zip(*(piece.column(c).to_pylist() for c in ("part", "tail", "key", "text"))):
                    mine = signature(t)
                    if held is not None and held[0] == part:
                        _, k0, t0, s0 = held
                        cut = len(t0) // 3
                        edited = t0[: len(t0) - cut] + t[:cut]
                        s1 = signature(edited)
                        out.append((k0, len(t0), edited, hashlib.sha256(edited.encode()).hexdigest(), as_text(s0), as_text(s1), likeness(s0, s1), likeness(s0, mine)))
                    held = None if tail else (part, k, t, mine)
                c = list(zip(*out)) or [()] * 8
                yield pa.record_batch(
                    [pa.array(c[0], piece.column("key").type), pa.array(c[1], pa.int64()), *[pa.array(c[i], pa.string()) for i in (3, 4, 5)], *[pa.array(c[i], pa.float64()) for i in (6, 7)]],
                    ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part").sortWithinPartitions("part", "tail", F.desc_nulls_last("key"), "text")
    return dealt.mapInArrow(walk, f"key {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").withColumnRenamed("key", key)
