"""Removal of repeated passages by external induced suffix sorting in shards.

Strings of DEPTH bytes that are equal must meet in one shard.  Each window of DEPTH
bytes is dealt by the least hash among its K-byte pieces, so a run of neighbouring
windows with one least hash (a segment) travels as one string, and equal windows
always share their least hash.  Segments whose least hash occurs once cannot hold a
repeat and stay behind.  A shard's distinct segments, weighted by how often they
occur, are suffix-sorted, and every DEPTH bytes that weigh two or more are reported
to the places of their segments.  A shard is a run of whole groups of one least hash; one
that grows large, because a single group is, is spooled and sorted over files.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoline.llm.common import boxed, mix, ragged, sliced, stage_table, text_bytes, thrifty, trim
from chronoline.llm.external import repeated_starts as starts_over_files
from chronoline.llm.induced import repeated_starts

DEPTH, K = 200, 32
#: Bytes of segments that one suffix sort takes: whole groups of one least hash, a single larger group alone.
SHARD_BYTES = 5 << 18
#: A least hash with more segments than this deals them further by a second least hash.
HOT = 2000
#: Bytes of a shard from which it is sorted over files, and of what its scans queue in memory.
EXTERNAL, QUEUED = 8 << 20, 16 << 20
#: Places of a shard that wait in memory for the sort; more wait in the task's scratch folder.
PLACES = 1_000_000
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)]


def _pieces(raw: np.ndarray, seed: int) -> np.ndarray:
    """Hash of the K bytes from each place; the last K - 1 places see zeros."""
    padded = np.concatenate([raw, np.zeros(K + 8, np.uint8)])
    lanes = np.ndarray((len(raw) + K,), "<u8", padded, strides=(1,))
    with np.errstate(over="ignore"):
        a = mix(lanes + np.uint64(seed) * _C[2])
        n = len(raw)
        return mix(a[:n] + (a[8 : n + 8] * _C[0]) + (a[16 : n + 16] * _C[1]) + (a[24 : n + 24] * _C[2]))


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, by doubling; shorter than h by width - 1."""
    out, have = h, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if width > have else out


def segments(raw: np.ndarray, at: np.ndarray, depth: int = DEPTH, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first window, number of windows, least hash, whether the hash stands at several places in it) of all segments."""
    width = depth - K + 1
    empty = np.zeros(0, np.int64)
    if len(raw) < depth:
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(bool)
    h = _pieces(raw, seed)
    m = _least(h, width)[: len(raw) - depth + 1]
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(m)]
    valid = np.arange(len(m)) + depth <= at[row + 1]
    new = np.ones(len(m), bool)
    new[1:] = (m[1:] != m[:-1]) | (row[1:] != row[:-1]) | ~valid[:-1]
    start = np.flatnonzero(new & valid)
    stop = np.append(np.flatnonzero(new | ~valid), len(m))
    stop = stop[np.searchsorted(stop, start, "right")]
    first, last = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    views = np.lib.stride_tricks.sliding_window_view(h, width)
    for i in range(0, len(start), 5_000):
        a, b = start[i : i + 5_000], stop[i : i + 5_000] - 1
        first[i : i + 5_000] = a + np.argmin(views[a], 1)
        last[i : i + 5_000] = b + width - 1 - np.argmin(views[b][:, ::-1], 1)
    return row[start], start - at[row[start]], stop - start, m[start], first != last


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    """(h1, h2, text, rest): two hashes that tell rows apart (equal rows share them), the text, and the other columns in a struct."""
    rows, named = boxed(docs)
    others = [F.col(c) for c in rows.columns if c != named[text]]
    rest = F.struct(*others) if others else F.struct(F.lit(0).alias("_"))
    body = F.col(named[text])
    plain = [F.col(f.name) for f in rows.schema if f.name != named[text] and "map<" not in f.dataType.simpleString()]
    return rows.select(F.xxhash64(body, body.isNull(), *plain).alias("h1"), F.hash(F.lit(7), body, *plain).alias("h2"), body.alias("text"), rest.alias("rest"))


def repeated_ranges(keyed: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(h1, h2, spans array<struct<lo,hi>>): byte ranges of each text that a repeated string covers.

    keyed: (h1, h2, text, rest), where h1 and h2 name a text's row.
    """
    spark = keyed.sparkSession

    def found(batches):
        for batch in batches:
            for piece in sliced(batch, "text", 1 << 20):
                raw, at = text_bytes(piece.column("text"))
                row, start, n, least, twice = segments(raw, at, depth)
                rows = pa.array(row)
                yield pa.record_batch([pa.array(least.view(np.int64)), piece.column("h1").take(rows), piece.column("h2").take(rows), pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(twice)], ["least", "h1", "h2", "start", "n", "twice"])

    keys = stage_table(keyed.select("h1", "h2", "text").mapInArrow(thrifty(found), "least long, h1 long, h2 int, start int, n int, twice boolean"), "segments")
    many = keys.groupBy("least").agg((F.count("*") + F.max(F.col("twice").cast("int"))).alias("times")).where("times > 1")
    spans = (
        keys.join(many, "least")
        .groupBy("h1", "h2")
        .agg(F.collect_set(F.struct("start", "n", "least", (F.col("times") > HOT).alias("hot"))).alias("segments"))
    )

    def cut(batches):
        for batch in batches:
            for piece in sliced(batch, "text", 1 << 20):
                local: dict[tuple[int, bytes], list] = {}
                for h1, h2, text, segs in zip(*(piece.column(c).to_pylist() for c in ("h1", "h2", "text", "segments"))):
                    body = text.encode()
                    for s in segs:
                        lo, hi = s["start"], s["start"] + s["n"] + depth - 1
                        if not s["hot"]:
                            local.setdefault((s["least"], body[lo:hi]), []).append((h1, h2, lo))
                            continue
                        part = np.frombuffer(body[lo:hi], np.uint8)
                        _, start, n, again, _ = segments(part, np.array([0, len(part)]), depth, seed=2)
                        with np.errstate(over="ignore"):
                            names = mix(again + np.uint64(s["least"] % (1 << 64)) * _C[1]).view(np.int64)
                        for a, b, name in zip(start.tolist(), n.tolist(), names.tolist()):
                            local.setdefault((name, body[lo + a : lo + a + b + depth - 1]), []).append((h1, h2, lo + a))
                if local:
                    yield _batch(list(local), list(local.values()))

    places = "array<struct<h1:long,h2:int,start:int>>"
    # The spans are hashed, a few for each text, and the texts stream past them, unsorted.
    pairs = keyed.join(spans.hint("shuffle_hash"), ["h1", "h2"]).select("h1", "h2", "text", "rest", "segments")
    dealt = pairs.mapInArrow(thrifty(cut), f"least long, body binary, places {places}").repartition(_shards(spark), "least").sortWithinPartitions("least")

    def shard(batches) -> Iterator[pa.RecordBatch]:
        held, places, last = _Segments(), _Places(), None
        for batch in batches:
            where = batch.column("places")
            at = where.offsets.to_numpy().astype(np.int64)
            count = np.diff(at).tolist()
            index, lo = np.zeros(batch.num_rows, np.int64), 0
            for i, (least, body) in enumerate(zip(batch.column("least").to_pylist(), batch.column("body").to_pylist())):
                if least != last and held.size > SHARD_BYTES:
                    places.add(index[lo:i], at[lo : i + 1], where.values)
                    yield from _sorted(held, places, depth)
                    held, places, lo = _Segments(), _Places(), i
                last = least
                index[i] = held.add(body, count[i])
            places.add(index[lo:], at[lo:], where.values)
        yield from _sorted(held, places, depth)

    ranges = dealt.mapInArrow(thrifty(shard), "h1 long, h2 int, lo int, hi int")
    return ranges.groupBy("h1", "h2").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def _shards(spark) -> int:
    return 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


_RUNS = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))


def _batch(keys: list, places: list) -> pa.RecordBatch:
    flat = [p for x in places for p in x]
    columns = list(zip(*flat))
    struct = pa.StructArray.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32())], ["h1", "h2", "start"])
    ends = np.concatenate([[0], np.cumsum([len(x) for x in places])]).astype(np.int32)
    return pa.record_batch([pa.array([k for k, _ in keys], pa.int64()), pa.array([b for _, b in keys], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), struct)], ["least", "body", "places"])


class _Segments:
    """Distinct segments of a shard and how often they occur; beyond EXTERNAL bytes in the task's scratch folder, and known by 128 bits of hash."""

    def __init__(self):
        self.index: dict[bytes, int] = {}
        self.weights, self.sizes, self.size, self.file = [], [], 0, None

    def add(self, body: bytes, times: int) -> int:
        k = self.index.setdefault(body if self.file is None else _name(body), len(self.weights))
        if k == len(self.weights):
            self.weights.append(0)
            self.sizes.append(len(body))
            self.size += len(body)
            if self.file is not None:
                self.file.write(body)
            elif self.size > EXTERNAL:
                self.file = tempfile.TemporaryFile(prefix="segments-")
                for x in self.index:
                    self.file.write(x)
                self.index = {_name(x): j for x, j in self.index.items()}
        self.weights[k] += times
        return k

    def _read(self) -> Iterator[bytes]:
        self.file.seek(0)
        for n in self.sizes:
            yield self.file.read(n)

    def repeated(self, depth: int) -> Iterator[np.ndarray]:
        """For each segment the offsets of windows that weigh two or more."""
        weights = np.array(self.weights, np.int64)
        if self.file is None:
            yield from repeated_starts(list(self.index), weights, depth)
        else:
            yield from starts_over_files(self._read(), np.array(self.sizes, np.int64), weights, depth, QUEUED)
            self.file.close()


def _name(body: bytes) -> bytes:
    return hashlib.blake2b(body, digest_size=16).digest()


class _Places:
    """(segment, h1, h2, start) of a shard's segments, in the task's scratch folder beyond a bound."""

    KIND = np.dtype([("segment", np.int32), ("h1", np.int64), ("h2", np.int32), ("start", np.int32)])

    def __init__(self):
        self.held, self.rows, self.file = [], 0, None

    def add(self, segment: np.ndarray, at: np.ndarray, flat: pa.StructArray) -> None:
        lo, hi = int(at[0]), int(at[-1])
        out = np.zeros(hi - lo, self.KIND)
        out["segment"] = np.repeat(segment, np.diff(at))
        for name in ("h1", "h2", "start"):
            out[name] = flat.field(name).to_numpy()[lo:hi]
        self.held.append(out)
        self.rows += len(out)
        if self.rows > PLACES:
            if self.file is None:
                self.file = tempfile.TemporaryFile(prefix="places-")
            for x in self.held:
                self.file.write(x.tobytes())
            self.held, self.rows = [], 0

    def __iter__(self) -> Iterator[np.ndarray]:
        if self.file is not None:
            self.file.seek(0)
            while raw := self.file.read(20_000 * self.KIND.itemsize):
                yield np.frombuffer(raw, self.KIND)
            self.file.close()
        if self.held:
            whole = np.concatenate(self.held)
            for i in range(0, len(whole), 20_000):
                yield whole[i : i + 20_000]


def _sorted(held: _Segments, places: _Places, depth: int) -> Iterator[pa.RecordBatch]:
    """Ranges that repeats cover, at every place of every segment of one shard."""
    trim()
    runs, lo, hi = np.zeros(len(held.weights), np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k, hit in enumerate(held.repeated(depth)):
        if len(hit):
            cut = np.flatnonzero(np.concatenate([[True], np.diff(hit) > depth, [True]]))
            runs[k] = len(cut) - 1
            lo.append(hit[cut[:-1]])
            hi.append(hit[cut[1:] - 1] + depth)
    begin, lo, hi = np.cumsum(runs) - runs, np.concatenate(lo), np.concatenate(hi)
    for some in places:
        n = runs[some["segment"]]
        if n.any():
            at, p = ragged(begin[some["segment"]], n), np.repeat(some, n)
            columns = [p["h1"], p["h2"], (p["start"] + lo[at]).astype(np.int32), (p["start"] + hi[at]).astype(np.int32)]
            yield pa.record_batch([pa.array(np.ascontiguousarray(c)) for c in columns], ["h1", "h2", "lo", "hi"])


def _union(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or ()):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def without_repeats(docs: DataFrame, depth: int = DEPTH, text: str = "text") -> DataFrame:
    """Every row, its ``text`` column replaced by n_bytes, spans array<struct<lo,hi>> and kept binary.

    A byte goes if a string of ``depth`` bytes that covers it starts at another place too,
    in the same text or another; all is judged on the input.  spans: the maximal removed runs.
    A null text is empty; texts shorter than ``depth`` stay whole.  Rows that repeat as a whole
    are places of their own, so their long passages all go.  An empty table gives no rows.
    Columns of the input that have the name of a new one give way to it.
    """
    keyed = _keyed(docs, text)
    joined = keyed.join(repeated_ranges(keyed, depth).hint("shuffle_hash"), ["h1", "h2"], "left").select("rest", "text", "spans")

    def strip(batches):
        for batch in batches:
            for piece in sliced(batch, "text"):
                kept, runs, sizes = [], [], []
                for t, s in zip(piece.column("text").to_pylist(), piece.column("spans").to_pylist()):
                    body, u = (t or "").encode(), _union(s)
                    edges = [0, *[x for r in u for x in r], len(body)]
                    kept.append(b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2])))
                    runs.append([{"lo": a, "hi": b} for a, b in u])
                    sizes.append(len(body))
                yield pa.record_batch([piece.column("rest"), pa.array(sizes, pa.int64()), pa.array(runs, _RUNS), pa.array(kept, pa.binary())], ["rest", "n_bytes", "spans", "kept"])

    span = T.ArrayType(T.StructType([T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())]))
    schema = T.StructType([joined.schema["rest"], T.StructField("n_bytes", T.LongType()), T.StructField("spans", span), T.StructField("kept", T.BinaryType())])
    out = joined.mapInArrow(thrifty(strip), schema)
    new = ("n_bytes", "spans", "kept")
    at = docs.columns.index(text)
    rest = [F.col("rest")[f"_{i}"].alias(c) for i, c in enumerate(docs.columns) if i != at and c not in new]
    return out.select(*rest, *new)


def cut_repeats(docs: DataFrame, depth: int = DEPTH, text: str = "text") -> DataFrame:
    """``docs`` with the repeated passages cut from ``text``; all rows and columns stay.

    A character that a passage covers only in part stays, so the text stays valid.  A null text stays null.
    """
    keyed = _keyed(docs, text)
    joined = keyed.join(repeated_ranges(keyed, depth).hint("shuffle_hash"), ["h1", "h2"], "left").select("rest", "text", "spans")

    def strip(batches):
        for batch in batches:
            for piece in sliced(batch, "text"):
                kept = []
                for t, s in zip(piece.column("text").to_pylist(), piece.column("spans").to_pylist()):
                    if s:
                        body = t.encode()
                        edges = [0]
                        for lo, hi in _union(s):
                            while lo < len(body) and body[lo] & 0xC0 == 0x80:
                                lo += 1
                            while hi < len(body) and body[hi] & 0xC0 == 0x80:
                                hi -= 1
                            edges += [lo, max(lo, hi)]
                        edges.append(len(body))
                        t = b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2])).decode()
                    kept.append(t)
                yield pa.record_batch([piece.column("rest"), pa.array(kept, pa.string())], ["rest", "text"])

    schema = T.StructType([joined.schema["rest"], T.StructField("text", T.StringType())])
    out = joined.mapInArrow(thrifty(strip), schema)
    at = docs.columns.index(text)
    return out.select(*[F.col("text").alias(c) if i == at else F.col("rest")[f"_{i}"].alias(c) for i, c in enumerate(docs.columns)])


def digests(stripped: DataFrame, key: str = "doc_id") -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["hi"] - s["lo"])
    return stripped.select(key, "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute(texts: list[str | None], depth: int = DEPTH) -> list[tuple[int, int, int, str]]:
    """The contract by plain counting, for tests."""
    from collections import Counter

    raw = [(t or "").encode() for t in texts]
    times = Counter(b[i : i + depth] for b in raw for i in range(len(b) - depth + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - depth + 1):
            if times[b[i : i + depth]] > 1:
                gone[i : i + depth] = True
        gone[len(b)] = False
        out.append((len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out
