"""Byte-level BPE encoding and decoding.

``encode`` splits every text into pre-tokens with their positions, once, and writes
them block by block to a table in the shared folder.  It sends each block's distinct
words to the task that owns the word, merges each distinct word there once, sends the
ids back to the block and reassembles them by position.
``decode`` joins ids with the token-byte table.  Rows of one block travel packed:
a block's words for one owner are one row, so a frequent word costs one entry a
block however often it occurs, and no key can grow hot.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoline.llm.common import bucket_table, loosened, packed, ragged, sliced, squeezed, thrifty, trim, unpacked

#: Bytes of text in a block; bounds the memory of a task, not the result.
BLOCK_BYTES = 12 << 20
#: Words that an owner remembers before it starts afresh.
MEMO_WORDS = 600_000


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by id, from a file of base64 tokens and ranks (ids from 0, none missing)."""
    with open(path, "rb") as f:
        pairs = sorted((int(b), base64.b64decode(a)) for a, b in (x.split() for x in f if x.strip()))
    if [k for k, _ in pairs] != list(range(len(pairs))):
        raise ValueError(f"{path}: ranks are not 0..{len(pairs) - 1}")
    return [v for _, v in pairs]


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of lowest rank merges first, leftmost on ties."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    if len(word) <= 48:
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]
    n = len(word)  # long runs: linked list and heap, n log n
    right, left, size = list(range(1, n + 1)), list(range(-1, n - 1)), [1] * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = right[i]
        if j < n and (r := ranks.get(word[i : j + size[j]])) is not None:
            heapq.heappush(heap, (r, i, j + size[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, end = heapq.heappop(heap)
        if not size[i] or (j := right[i]) >= n or j + size[j] != end:
            continue
        size[i], size[j], right[i] = end - i, 0, right[j]
        if right[j] < n:
            left[right[j]] = i
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : i + size[i]]])
        i = right[i]
    return out


class _Codes(dict):
    def __missing__(self, word):
        self[word] = code = len(self)
        return code


def _blocks(batches: Iterator[pa.RecordBatch], pattern: str) -> Iterator[tuple[int, list, list, list[list[int]]]]:
    """Block id, keys, distinct words in order of first occurrence, and each text's words by number."""
    find, first, number = regex.compile(pattern).findall, 0, 0
    keys, codes, known, room = [], [], _Codes(), BLOCK_BYTES
    for batch in batches:
        first = batch.column("part")[0].as_py() << 32 if batch.num_rows else first
        for piece in sliced(batch, "text"):
            for key, text in zip(piece.column("key").to_pylist(), piece.column("text").to_pylist()):
                if room < 0:
                    yield first + number, keys, list(known), codes
                    keys, codes, known, room, number = [], [], _Codes(), BLOCK_BYTES, number + 1
                keys.append(key)
                codes.append(np.fromiter(map(known.__getitem__, find(text or "")), np.uint32))
                room -= len(text or "") + 64
    if keys:
        yield first + number, keys, list(known), codes


def encode(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of every row of ``docs``.

    A null or empty text has no ids.  Rows are taken one by one, so repeated rows and
    repeated or null keys come out as often as they went in.  Other columns are ignored.
    Raises if the vocabulary lacks one of the 256 single bytes.
    """
    spark = docs.sparkSession
    tokens = read_ranks(ranks_path)
    ranks = {v: k for k, v in enumerate(tokens)}
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("the vocabulary must hold every single byte")
    given = spark.sparkContext.broadcast(ranks)  # one vocabulary file: fixed size
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    parts = rows.withColumn("part", F.spark_partition_id())
    kind = rows.schema["key"].dataType.simpleString()
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())

    def cut(batches):
        for block, keys, words, codes in _blocks(batches, pattern):
            raw = [w.encode() for w in words]
            body = b"".join(raw)
            sizes = np.fromiter(map(len, raw), np.uint32, len(raw))
            counts = np.fromiter(map(len, codes), np.uint32, len(codes))
            columns = [pa.array([block], pa.int64()), pa.array([keys], pa.list_(kinds))]
            columns += [pa.array([x], pa.binary()) for x in (packed(counts), packed(np.concatenate(codes)), squeezed(body), packed(sizes))]
            yield pa.record_batch(columns, ["block", "keys", "counts", "codes", "body", "sizes"])

    def words_out(batches):
        for batch in batches:
            for block, body, sizes in zip(*(batch.column(c).to_pylist() for c in ("block", "body", "sizes"))):
                stops = np.cumsum(unpacked(sizes), dtype=np.int64)
                body = loosened(body, int(stops[-1]) if len(stops) else 0)
                raw = [body[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist())]
                owner = np.fromiter((zlib.crc32(w) % owners for w in raw), np.int64, len(raw))
                order = np.argsort(owner, kind="stable")
                cuts = np.flatnonzero(np.diff(owner[order], prepend=-1)).tolist() + [len(raw)]
                for lo, hi in zip(cuts, cuts[1:]):
                    words = [raw[i] for i in order[lo:hi]]
                    sent = packed(order[lo:hi].astype(np.uint32)), squeezed(b"".join(words)), packed(np.fromiter(map(len, words), np.uint32, len(words)))
                    yield pa.record_batch([pa.array([int(owner[order[lo]])], pa.int32()), pa.array([block], pa.int64()), *[pa.array([x], pa.binary()) for x in sent]], ["owner", "block", "numbers", "body", "sizes"])

    def merged(batches):
        memo: dict[bytes, list[int]] = {}
        for batch in batches:
            for block, numbers, body, sizes in zip(*(batch.column(c).to_pylist() for c in ("block", "numbers", "body", "sizes"))):
                sizes = unpacked(sizes)
                body = loosened(body, int(sizes.sum()))
                found, at = [], 0
                for n in sizes.tolist():
                    word = body[at : at + n]
                    at += n
                    if (ids := memo.get(word)) is None:
                        if len(memo) >= MEMO_WORDS:
                            memo.clear()
                        memo[word] = ids = merge(word, given.value)
                    found.append(ids)
                flat = np.fromiter((i for ids in found for i in ids), np.uint32)
                count = np.fromiter(map(len, found), np.uint32, len(found))
                yield pa.record_batch([pa.array([block], pa.int64()), *[pa.array([x], pa.binary()) for x in (numbers, packed(flat), packed(count))]], ["block", "numbers", "flat", "count"])

    def reassembled(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        out_keys, out_ids, ends = [], [], [np.zeros(1, np.int64)]
        which, sizes, ids = (np.concatenate([np.zeros(0, np.uint32), *map(unpacked, theirs.column(c).to_pylist())]).astype(np.int64) for c in ("numbers", "count", "flat"))
        begin, size = np.zeros(len(which), np.int64), np.zeros(len(which), np.int64)
        begin[which], size[which] = np.cumsum(sizes) - sizes, sizes
        for keys, counts, codes in zip(*(mine.column(c).to_pylist() for c in ("keys", "counts", "codes"))):
            words = unpacked(codes).astype(np.int64)
            n = size[words]
            out_ids.append(ids[ragged(begin[words], n)].astype(np.int32))
            stops = np.concatenate([[0], np.cumsum(n)])[np.cumsum(unpacked(counts), dtype=np.int64)]
            out_keys += keys
            ends.append(stops + ends[-1][-1])
        trim()
        flat = pa.array(np.concatenate([np.zeros(0, np.int32), *out_ids]))
        return pa.table({"key": pa.array(out_keys, kinds), "ids": pa.ListArray.from_arrays(pa.array(np.concatenate(ends).astype(np.int32)), flat)})

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = to_arrow_type(rows.schema["key"].dataType)
    cuts = parts.mapInArrow(thrifty(cut), f"block long, keys array<{kind}>, counts binary, codes binary, body binary, sizes binary")
    blocks = bucket_table(cuts, "block", "bpe-blocks")
    sent = blocks.select("block", "body", "sizes").mapInArrow(thrifty(words_out), "owner int, block long, numbers binary, body binary, sizes binary")
    ids = sent.repartition(owners, "owner").mapInArrow(thrifty(merged), "block long, numbers binary, flat binary, count binary")
    places = blocks.select("block", "keys", "counts", "codes")
    return places.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(reassembled, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode(encoded: DataFrame, ranks_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, ids, bytes binary): each row's token bytes joined in order.

    Null or empty ids give empty bytes; an id outside the vocabulary raises.
    """
    spark = encoded.sparkSession
    given = spark.sparkContext.broadcast(read_ranks(ranks_path))  # one vocabulary file: fixed size
    rows = encoded.select(F.col(key), F.col(ids).alias("ids"))

    def joined(batches):
        table = pa.array(given.value, pa.binary())
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(1)
            at = np.concatenate([[0], np.cumsum(np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))])
            hit = table.take(column.flatten())
            raw = hit.buffers()[2]
            ends = np.frombuffer(hit.buffers()[1], np.int32)[hit.offset : hit.offset + len(hit) + 1] if len(hit) else np.zeros(1, np.int32)
            out = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends[at].astype(np.int32)), raw if raw is not None else pa.py_buffer(b"")])
            yield pa.record_batch([batch.column(0), column, out], [key, "ids", "bytes"])

    return rows.mapInArrow(thrifty(joined), f"`{key}` {rows.schema[key].dataType.simpleString()}, ids array<int>, bytes binary")
