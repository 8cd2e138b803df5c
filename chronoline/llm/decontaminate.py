"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a run of item words (a window).  Patterns of one length share a
table of shifts, indexed by the hash of a block of two words: how far a search
position may move when that block ends there.  Where the shift is zero, a bucket
keyed by the pattern's last block selects the test strings, and the words
themselves are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoline.llm.common import ALNUM, LOWER, Shipped, boxed, hash_spans, sliced, text_bytes, thrifty, word_spans

WINDOW = 13
#: Words of items that one scan searches for; more items are searched in further scans.
PATTERN_WORDS = 2_000_000
_BITS = 20
_LANE = 256
_B = np.uint64(0x9FB21C651E98DF25)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words of one text, as the search sees them."""
    raw, at = text_bytes(pa.array([text], pa.string()))
    low = LOWER[raw]
    starts, stops, _ = word_spans(low, at, ALNUM)
    body = low.tobytes()
    return [body[a:b] for a, b in zip(starts.tolist(), stops.tolist())]


def _blocks(hashes: np.ndarray) -> np.ndarray:
    """Table index of the block that ends at each word; index 0 holds a one-word block."""
    with np.errstate(over="ignore"):
        out = hashes * _B
        out[1:] += hashes[:-1]
    return (out * _B >> np.uint64(64 - _BITS)).astype(np.int64)


class WuManber:
    """Finds all occurrences of word sequences of one length."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], set[int]]):
        self.length, self.block = length, min(2, length)
        self.names = list(patterns)
        flat = [w for p in self.names for w in p]
        body = np.frombuffer(b"".join(flat), np.uint8)
        stops = np.cumsum([len(w) for w in flat])
        hashes = hash_spans(body, stops - [len(w) for w in flat], stops).reshape(-1, length)
        self.items = [np.array(sorted(patterns[p])) for p in self.names]
        self.shift = np.full(1 << _BITS, length - self.block + 1, np.int16)
        bucket: dict[int, list[int]] = {}
        for k, row in enumerate(hashes):
            at = _blocks(row) if self.block == 2 else self._single(row)
            for j in range(self.block - 1, length):
                self.shift[at[j]] = min(self.shift[at[j]], length - 1 - j)
            bucket.setdefault(int(at[-1]) << _BITS | int(at[self.block - 1]), []).append(k)
        self.bucket = bucket
        self.keys = np.array(sorted(bucket), np.int64)

    @staticmethod
    def _single(hashes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (hashes * _B >> np.uint64(64 - _BITS)).astype(np.int64)

    def search(self, hashes: np.ndarray, first: np.ndarray, body: bytes, starts: np.ndarray, stops: np.ndarray) -> Iterator[tuple[int, int]]:
        """(word index of the occurrence's start, pattern number) of every occurrence.

        first: each row's first word and, at the end, the number of words.
        """
        m = self.length
        at = _blocks(hashes) if self.block == 2 else self._single(hashes)
        lo, hi = first[:-1] + m - 1, first[1:]
        lanes = np.maximum(0, -(-(hi - lo) // _LANE))
        row = np.repeat(np.arange(len(lo)), lanes)
        begin = lo[row] + (np.arange(len(row)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * _LANE
        end = np.minimum(begin + _LANE, hi[row])
        while len(begin):  # all lanes step together; each skips by its own shift
            step = self.shift[at[begin]]
            here = begin[step == 0]
            key = at[here] << _BITS | at[here - m + self.block]  # last block, then first block: the prefix test
            known = self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] == key
            for p, q in zip(here[known].tolist(), key[known].tolist()):
                for k in self.bucket[q]:
                    a = p - m + 1
                    if all(body[starts[a + j] : stops[a + j]] == w for j, w in enumerate(self.names[k])):
                        yield a, k
            begin = begin + np.maximum(step, 1)
            left = begin < end
            begin, end = begin[left], end[left]


def build(items: list[tuple[int, str | None]], window: int = WINDOW) -> list[WuManber]:
    """One searcher for each length of window; items without words have none."""
    found: dict[int, dict[tuple[bytes, ...], set[int]]] = {}
    for item, text in items:
        words = words_of(text)
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if words else 0):
            found.setdefault(n, {}).setdefault(tuple(words[i : i + n]), set()).add(item)
    return [WuManber(n, p) for n, p in sorted(found.items())]


def _item_blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list]:
    """Items in pieces of PATTERN_WORDS words or so, one piece in memory at a time."""
    rows = benchmark.select(F.col(item).alias("i"), F.col(text).alias("t"))
    block, size = [], 0
    for r in rows.toLocalIterator():
        block.append((r.i, r.t))
        size += len(r.t or "") // 6
        if size > PATTERN_WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, n_words, spans array<struct<start,stop>>, items array<item>) of every row.

    spans: maximal runs of hit words, as word numbers; items: distinct, sorted as strings.
    A null or empty text has no words; an empty benchmark hits nothing.  Repeated rows are
    judged one by one.  The items are searched in blocks of a fixed size: the first scan
    takes one block, and where there are more, their hits are united by row.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("hash"))
    kind = rows.schema["key"].dataType.simpleString()
    item_kind = benchmark.schema[item].dataType.simpleString()
    out = f"key {kind}, hash long, n_words long, spans array<struct<start:long,stop:long>>, items array<{item_kind}>"
    scans = [_scan(rows, Shipped(spark, build(b, window)), window, out, item_kind) for b in _item_blocks(benchmark, item, item_text)]
    if not scans:
        scans = [_scan(rows, Shipped(spark, []), window, out, item_kind)]
    if len(scans) == 1:
        return scans[0].drop("hash").withColumnRenamed("key", key)
    from pyspark.sql import Window

    united = scans[0].withColumn("copy", F.lit(0))
    for k, p in enumerate(scans[1:], 1):
        united = united.unionByName(p.withColumn("copy", F.lit(k)))
    same = ["key", "hash", "n_words"]  # repeated rows have the same hits, in whatever order
    rank = F.row_number().over(Window.partitionBy("copy", *same).orderBy(F.lit(0)))
    merged = united.withColumn("rank", rank).groupBy(*same, "rank").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return merged.mapInArrow(_unite(key, item_kind), out.replace("key ", f"`{key}` ", 1).replace("hash long, ", ""))


def _by_text(items: list) -> list:
    return sorted(set(items), key=str)


def _runs(pairs: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for a, b in sorted(pairs):
        if out and a <= out[-1]["stop"]:
            out[-1]["stop"] = max(out[-1]["stop"], b)
        else:
            out.append({"start": a, "stop": b})
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _unite(key: str, item_kind: str):
    def unite(batches):
        for b in batches:
            spans = [_runs([(s["start"], s["stop"]) for s in x]) for x in b.column("spans").to_pylist()]
            items = [_by_text(x) for x in b.column("items").to_pylist()]
            yield pa.record_batch([b.column("key"), b.column("n_words"), pa.array(spans, _SPANS), pa.array(items, b.column("items").type)], [key, "n_words", "spans", "items"])

    return unite


def _scan(rows: DataFrame, searchers, window: int, out: str, item_kind: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    items_type = to_arrow_type(_parse_datatype_string(out)["items"].dataType)

    def scan(batches):
        for batch in batches:
            for piece in sliced(batch, "text"):
                raw, at = text_bytes(piece.column("text"))
                low = LOWER[raw]
                starts, stops, first = word_spans(low, at, ALNUM)
                hashes, body = hash_spans(low, starts, stops), low.tobytes()
                n = piece.num_rows
                spans: dict[int, list] = {}
                items: dict[int, set] = {}
                for s in searchers.value:
                    for a, k in s.search(hashes, first, body, starts, stops):
                        d = int(np.searchsorted(first, a, "right")) - 1
                        base = int(first[d])
                        spans.setdefault(d, []).append((a - base, a - base + s.length))
                        items.setdefault(d, set()).update(s.items[k].tolist())
                yield pa.record_batch(
                    [
                        piece.column("key"),
                        piece.column("hash"),
                        pa.array(np.diff(first), pa.int64()),
                        pa.array([_runs(spans.get(d, [])) for d in range(n)], _SPANS),
                        pa.array([_by_text(items.get(d, ())) for d in range(n)], items_type),
                    ],
                    ["key", "hash", "n_words", "spans", "items"],
                )

    return rows.mapInArrow(thrifty(scan), out)


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """n_hit, n_items, items_sha256 and contaminated of what ``contamination`` returns."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return found.select(
        key,
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.col("items").cast("array<string>"), ",").cast("binary"), 256).alias("items_sha256"),
    ).withColumn("contaminated", flagged(F.col("n_hit"), F.col("n_words")))


def flagged(n_hit, n_words):
    """The rule: any hit word, and at least a twentieth of the words hit."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, all columns, that the rule does not flag.

    With one block of items rows are judged where they are read; with more, the hits of all
    blocks are united by text first and joined back by two hashes of it.
    """
    spark = docs.sparkSession
    rows, named = boxed(docs)
    body = named[text]
    blocks = _item_blocks(benchmark, item, item_text)
    first = next(blocks, [])
    second = next(blocks, None)
    if second is not None:
        # Rows with one text share their hits, so they are told apart by two hashes of it only.
        blocks.close()
        marked = rows.withColumn("h1", F.xxhash64(body, F.col(body).isNull())).withColumn("h2", F.hash(F.lit(7), body))
        texts = marked.groupBy("h1", "h2").agg(F.any_value(body).alias("text"))
        found = contamination(texts.select(F.struct("h1", "h2").alias("key"), "text"), benchmark, "key", "text", item, item_text, window)
        bad = digests(found, "key").where("contaminated").select("key.h1", "key.h2")
        return marked.join(bad, ["h1", "h2"], "left_anti").select(*rows.columns).toDF(*docs.columns)
    searchers = Shipped(spark, build(first, window))

    def keep(batches):
        for batch in batches:
            for piece in sliced(batch, body):
                raw, at = text_bytes(piece.column(body))
                low = LOWER[raw]
                starts, stops, first = word_spans(low, at, ALNUM)
                hashes, flat = hash_spans(low, starts, stops), low.tobytes()
                hit = np.zeros(len(starts) + 1, np.int64)
                for s in searchers.value:
                    for a, _ in s.search(hashes, first, flat, starts, stops):
                        hit[a : a + s.length] = 1
                total = np.concatenate([[0], np.cumsum(hit[:-1])])
                kept = piece.filter(pa.array(~flagged(total[first[1:]] - total[first[:-1]], np.diff(first))))
                if kept.num_rows:
                    yield kept

    return rows.mapInArrow(thrifty(keep), rows.schema).toDF(*docs.columns)


def brute(text: str | None, items: list[tuple[int, str | None]], window: int = WINDOW) -> tuple[int, int, int, str]:
    """The contract for one text by plain comparison, for tests."""
    words = words_of(text)
    hit, found = set(), set()
    for item, body in items:
        w = words_of(body)
        n = min(window, len(w))
        wins = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        for i in range(len(words) - n + 1 if w else 0):
            if tuple(words[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                found.add(item)
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
