"""SimHash near-duplicates by a self-join of binary tries.

Distinct fingerprints stand in tries over permuted bits.  With the 64 bits cut
into BLOCKS[0] blocks and a budget of r < BLOCKS[0] bits, two fingerprints within
the budget agree on at least BLOCKS[0] - r blocks; so for each choice of that many
blocks there is a trie with those blocks first, whose pairs of nodes start, error
free, below each common prefix.  Node pairs are traversed together, differing bits
add up, and a pair is dropped once its errors exceed the budget.

``keep_one`` uses the same join on wider fingerprints: 256 bits of the distinct
five-word shingles, whose differing bits estimate the shingles' Jaccard similarity.
Its tries stand on SAMPLES choices of 32 of those bits, two of which may differ, and
whole fingerprints are compared at the leaves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoline.llm.common import LOWER, NON_SPACE, boxed, hash_spans, mix, ragged, sliced, stage_table, text_bytes, thrifty, unboxed, word_spans
from chronoline.llm.graphs import dealt_join, star_components

SHINGLE, BUDGET, SEED = 4, 4, 42
#: Fingerprints below one prefix that a task takes whole; larger groups are split into pairs of sub-tries.
HOT = 50_000
SPLIT_BITS = 5
#: Node pairs that are advanced together, links that are united together, rows that a task holds (whole groups), rows of a task.
FRONTIER, UNITE, HELD, TASK = 200_000, 100_000, 100_000, 2_000_000
_ONE = np.uint64(1)
#: Wide fingerprints: words of a shingle, 64-bit lanes, samples of their bits, bits and differing bits of a sample.
WIDE_SHINGLE, LANES, SAMPLES, SAMPLE_BITS, SAMPLE_BUDGET = 5, 4, 16, 32, 2
#: Similarity that links, as the share of equal bits estimates it.
SIMILARITY = 0.8
_LANE = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(raw: bytes, starts: list[int], stops: list[int]) -> int:
    """Fingerprint of one text whose words lie in ``raw``, one space apart."""
    if not starts:
        return 0
    n = max(1, len(starts) - SHINGLE + 1)
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(raw[a:b], SEED) for a, b in zip(starts[:n], stops[min(SHINGLE, len(stops)) - 1 :])], dtype=">u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _fingerprints(column: pa.Array) -> list[int]:
    raw, at = text_bytes(column)
    low = LOWER[raw]
    starts, stops, first = word_spans(low, at, NON_SPACE)
    size = stops - starts
    ends = np.cumsum(size + 1)
    even = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
    even[ragged(ends - size - 1, size)] = low[ragged(starts, size)]
    body, a, b = even.tobytes(), (ends - size - 1).tolist(), (ends - 1).tolist()
    return [fingerprint(body, a[i:j], b[i:j]) for i, j in zip(first[:-1].tolist(), first[1:].tolist())]


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp long) of every row; texts without words have fingerprint zero."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def take(batches):
        for batch in batches:
            for piece in sliced(batch, "text", 1 << 20):
                yield pa.record_batch([piece.column("key"), pa.array(np.array(_fingerprints(piece.column("text")), np.uint64).view(np.int64))], ["key", "fp"])

    return rows.mapInArrow(thrifty(take), f"key {rows.schema['key'].dataType.simpleString()}, fp long").withColumnRenamed("key", key)


def block_plan(rows: int, budget: int = BUDGET) -> tuple[int, int]:
    """(blocks, leading blocks): the fewest tries whose prefixes leave about 64 random fingerprints or fewer."""
    for lead in range(1, 6):
        if rows <= 64 << (64 * lead // (budget + lead)):
            break
    return budget + lead, lead


class Plan:
    """How fingerprints stand in tries: the order of bits of each trie, its leading bits, budgets by depth and for whole fingerprints."""

    def __init__(self, lanes: int, orders: list[tuple[np.ndarray, int]], budget: np.ndarray, limit: int):
        self.lanes, self.orders, self.budget, self.limit = lanes, orders, budget, limit

    @classmethod
    def exact(cls, rows: int, budget: int) -> Plan:
        """All pairs of 64-bit fingerprints within ``budget``."""
        blocks, lead = block_plan(rows, budget)
        cut = [64 * k // blocks for k in range(blocks + 1)]
        orders = []
        for chosen in combinations(range(blocks), lead):
            rest = [k for k in range(blocks) if k not in chosen]
            orders.append((np.concatenate([np.arange(cut[k], cut[k + 1]) for k in [*chosen, *rest]]), sum(cut[k + 1] - cut[k] for k in chosen)))
        return cls(1, orders, np.full(65, budget), budget)

    @classmethod
    def wide(cls) -> Plan:
        """Most pairs of wide fingerprints whose similarity is SIMILARITY or more; see README for the share."""
        rng, bits = np.random.default_rng(42), 64 * LANES
        cut = [SAMPLE_BITS * k // (SAMPLE_BUDGET + 1) for k in range(SAMPLE_BUDGET + 2)]
        orders = []
        for k in range(SAMPLES):
            if k * SAMPLE_BITS % bits == 0:
                mixed = rng.permutation(bits)
            some = np.roll(mixed, -(k * SAMPLE_BITS % bits))[:64]
            for a, b in zip(cut, cut[1:]):  # one of the blocks is free of errors
                orders.append((np.concatenate([some[a:b], some[:a], some[b:]]), b - a))
        budget = np.full(65, SAMPLE_BUDGET + 14)  # ample for the bits after the sample
        budget[: SAMPLE_BITS + 1] = SAMPLE_BUDGET
        cosine = 2 * SIMILARITY / (1 + SIMILARITY)
        # The rounding up favours pairs at the threshold: half a deviation of the estimate.
        share = math.acos(cosine) / math.pi
        return cls(LANES, orders, budget, math.floor(bits * share + math.sqrt(bits * share * (1 - share)) / 2))

    def values(self, trie: int, fp: np.ndarray) -> np.ndarray:
        """The first 64 bits of each row of ``fp`` (lanes) in the trie's order."""
        bits = np.unpackbits(np.ascontiguousarray(fp.astype(">u8")).view(np.uint8).reshape(len(fp), -1), axis=1)
        return np.ascontiguousarray(np.packbits(bits[:, self.orders[trie][0]], axis=1)).view(">u8").ravel().astype(np.uint64)

    def near(self, fp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(fp[a] ^ fp[b]).sum(1, dtype=np.int64) <= self.limit


class Forest:
    """Components of the rows that a task holds: each row's smallest linked row."""

    def __init__(self, rows: int):
        self.root = np.arange(rows)

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            open_ = x != y
            if not open_.any():
                return
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while (self.root != self.root[self.root]).any():
                self.root = self.root[self.root]


class Trie:
    """A forest of binary tries: sorted values, each group's values in one range.

    near: whether the pairs (a, b) of places are links.  budget: the most errors by depth.
    """

    def __init__(self, values: np.ndarray, budget: np.ndarray, near):
        self.values, self.budget, self.near = values, budget, near
        self.ones: dict[int, np.ndarray] = {}
        self.kin: tuple[np.ndarray, np.ndarray] | None = None

    def settled(self, root: np.ndarray) -> None:
        """Tell which places are linked by now: pairs of nodes within one component are passed over."""
        self.kin = root, np.cumsum(np.concatenate([[0], root[1:] != root[:-1]]))

    def _middle(self, lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
        """Where the children with bit 1 begin."""
        if depth not in self.ones:
            self.ones[depth] = np.concatenate([[0], np.cumsum(self.values >> np.uint64(63 - depth) & _ONE, dtype=np.int64)])
        c = self.ones[depth]
        return hi - (c[hi] - c[lo])

    def _open(self, f: np.ndarray) -> np.ndarray:
        root, turns = self.kin
        same = (turns[f[:, 1] - 1] == turns[f[:, 0]]) & (turns[f[:, 3] - 1] == turns[f[:, 2]]) & (root[f[:, 0]] == root[f[:, 2]])
        return f[~same]

    def _products(self, f: np.ndarray):
        """All pairs of places of nodes whose values are used up, FRONTIER at a time."""
        for lo, hi, lo2, hi2 in f[:, :4].tolist():
            step = max(1, FRONTIER // (hi2 - lo2))
            for a in range(lo, hi, step):
                x = np.repeat(np.arange(a, min(a + step, hi)), hi2 - lo2)
                y = np.tile(np.arange(lo2, hi2), min(a + step, hi) - a)
                if self.kin is not None:
                    keep = self.kin[0][x] != self.kin[0][y]
                    x, y = x[keep], y[keep]
                yield x, y

    def pairs(self, frontier: np.ndarray, depth: int):
        """Index pairs within the budget, in arrays.  A row of ``frontier`` is a pair of nodes: lo, hi, lo, hi, errors."""
        stack = [(frontier, depth)]
        while stack:
            f, d = stack.pop()
            if len(f) > FRONTIER:
                stack += [(f[i : i + FRONTIER], d) for i in range(0, len(f), FRONTIER)]
                continue
            if self.kin is not None and len(f):
                f = self._open(f)
            one = (f[:, 1] - f[:, 0] == 1) & (f[:, 3] - f[:, 2] == 1)
            found = [(f[one, 0], f[one, 2])] if one.any() else []  # two leaves: the whole is compared at once
            f = f[~one]
            if d == 64 and len(f):
                found = [*found, *self._products(f)]
            for a, b in found:
                ok = a != b
                ok[ok] = self.near(a[ok], b[ok])
                if ok.any():
                    yield a[ok], b[ok]
            if not len(f) or d == 64:
                continue
            am, bm = self._middle(f[:, 0], f[:, 1], d), self._middle(f[:, 2], f[:, 3], d)
            same = f[:, 0] == f[:, 2]
            z = lambda a, b, c, e, more: np.stack([a, b, c, e, f[:, 4] + more], 1)
            new = [z(f[:, 0], am, f[:, 2], bm, 0), z(am, f[:, 1], bm, f[:, 3], 0), z(f[:, 0], am, bm, f[:, 3], 1), z(am, f[:, 1], f[:, 2], bm, 1)[~same]]
            f = np.concatenate(new)
            alone = (f[:, 0] == f[:, 2]) & (f[:, 1] - f[:, 0] == 1)
            f = f[(f[:, 0] < f[:, 1]) & (f[:, 2] < f[:, 3]) & (f[:, 4] <= self.budget[d + 1]) & ~alone]
            if len(f):
                stack.append((f, d + 1))


def _frontiers(group: np.ndarray, item: np.ndarray, value: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, int]]:
    """Starting pairs of nodes, and their depth, of all groups of one trie; rows come sorted by group, item and value."""
    cut = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (item[1:] != item[:-1]), [True]]))
    lo, hi = cut[:-1], cut[1:]
    whole = item[lo] < 0
    yield np.stack([lo, hi, lo, hi, np.zeros(len(lo), np.int64)], 1)[whole & (hi - lo > 1)], width
    cross = []
    for a, b in zip(lo[~whole].tolist(), hi[~whole].tolist()):  # a pair of sub-tries of a group that was split
        i, j = divmod(int(item[a]), 1 << SPLIT_BITS)
        child = value[a:b] >> np.uint64(64 - width - SPLIT_BITS) & np.uint64((1 << SPLIT_BITS) - 1)
        m = a + int(np.searchsorted(child, np.uint64(max(i, j))))
        cross.append([a, b, a, b, 0] if i == j else [a, m, m, b, (i ^ j).bit_count()])
    if cross:
        f = np.array(cross, np.int64)
        yield f[(f[:, 0] < f[:, 1]) & (f[:, 2] < f[:, 3])], width + SPLIT_BITS


def _spanned(plan: Plan, trie: np.ndarray, prefix: np.ndarray, item: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, another of their component) that span all links of the given whole groups."""
    names, node = np.unique(np.ascontiguousarray(fp).view(np.dtype((np.void, 8 * plan.lanes))).ravel(), return_inverse=True)
    distinct = names.view(np.uint64).reshape(-1, plan.lanes)
    forest = Forest(len(distinct))
    for k in np.unique(trie).tolist():
        here = np.flatnonzero(trie == k)
        value = plan.values(k, fp[here])
        order = np.lexsort([value, item[here], prefix[here]])
        here, value = here[order], value[order]
        place, group = node[here], prefix[here]
        beside = np.flatnonzero((group[1:] == group[:-1]) & (item[here][1:] == item[here][:-1]))
        beside = beside[plan.near(distinct, place[beside], place[beside + 1])]
        forest.unite(place[beside], place[beside + 1])
        tries = Trie(value, plan.budget, lambda a, b, place=place: plan.near(distinct, place[a], place[b]))
        tries.settled(forest.root[place])
        a_, b_, held = [], [], 0
        for frontier, depth in _frontiers(group, item[here], value, plan.orders[k][1]):
            for a, b in tries.pairs(frontier, depth):
                a_.append(place[a])
                b_.append(place[b])
                held += len(a)
                if held > UNITE:
                    forest.unite(np.concatenate(a_), np.concatenate(b_))
                    tries.settled(forest.root[place])
                    a_, b_, held = [], [], 0
        if held:
            forest.unite(np.concatenate(a_), np.concatenate(b_))
    bound = np.flatnonzero(forest.root != np.arange(len(distinct)))
    return distinct[bound], distinct[forest.root[bound]]


def _lanes(column: pa.Array, lanes: int) -> np.ndarray:
    """Fingerprints of a binary column, a row each and a lane a column."""
    return text_bytes(column)[0].view("<u8").reshape(-1, lanes)


def _binary(fp: np.ndarray) -> pa.Array:
    at = np.arange(len(fp) + 1, dtype=np.int32) * (8 * fp.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(fp), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(fp, "<u8"))])


def spanning_links(distinct: DataFrame, plan: Plan, rows: int) -> DataFrame:
    """(a, b): pairs that span each component of the links that the plan's tries find.

    distinct: one column fp binary of distinct fingerprints.  A task takes whole groups of one
    prefix in turn and emits a spanning forest of the links it finds, so a dense group gives no
    more rows than it has members.
    """
    spark = distinct.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8, -(-rows * len(plan.orders) // TASK))

    def placed(batches):
        for batch in batches:
            fp = _lanes(batch.column(0), plan.lanes)
            for k, (_, width) in enumerate(plan.orders):
                prefix = plan.values(k, fp) >> np.uint64(64 - width)
                yield pa.record_batch([pa.array(np.full(len(fp), k, np.int32)), pa.array(prefix.astype(np.int64)), pa.array(np.full(len(fp), -1, np.int32)), batch.column(0)], ["trie", "prefix", "item", "fp"])

    put = distinct.select("fp").mapInArrow(thrifty(placed), "trie int, prefix long, item int, fp binary")
    hot = stage_table(put.groupBy("trie", "prefix").agg(F.count("*").alias("n")).where(F.col("n") > HOT), "hot")
    if not hot.isEmpty():
        put = _split(put, hot, plan)

    def traversed(batches):
        held, rows = [], 0

        def spanned(table: pa.Table):
            trie, prefix, item = (table.column(c).to_numpy() for c in ("trie", "prefix", "item"))
            a, b = _spanned(plan, trie, prefix, item, _lanes(table.column("fp"), plan.lanes))
            if len(a):
                yield pa.record_batch([_binary(a), _binary(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows > HELD:
                table = pa.Table.from_batches(held).combine_chunks()
                keys = np.stack([table.column(c).to_numpy() for c in ("trie", "prefix", "item")], 1)
                turn = np.flatnonzero((keys[1:] != keys[:-1]).any(1))
                if len(turn):  # the last group may go on
                    stop = int(turn[-1]) + 1
                    yield from spanned(table.slice(0, stop))
                    held, rows = table.slice(stop).to_batches(), table.num_rows - stop
        if held:
            yield from spanned(pa.Table.from_batches(held).combine_chunks())

    keys = ["trie", "prefix", "item"]
    return put.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(thrifty(traversed), "a binary, b binary").where("a != b")


def _split(put: DataFrame, hot: DataFrame, plan: Plan) -> DataFrame:
    """Rows of hot groups go to each pair of sub-tries that theirs takes part in."""

    def items(batches):
        n = 1 << SPLIT_BITS
        for batch in batches:
            trie, fp = batch.column("trie").to_numpy(), _lanes(batch.column("fp"), plan.lanes)
            for k in np.unique(trie).tolist():
                here, width = np.flatnonzero(trie == k), plan.orders[k][1]
                child = (plan.values(k, fp[here]) >> np.uint64(64 - width - SPLIT_BITS)).astype(np.int64) & (n - 1)
                for other in range(n):
                    near = np.flatnonzero(np.bitwise_count(child ^ other) <= plan.budget[width + SPLIT_BITS])
                    if len(near):
                        rows = batch.take(pa.array(here[near]))
                        item = np.minimum(child[near], other) * n + np.maximum(child[near], other)
                        yield pa.record_batch([rows.column("trie"), rows.column("prefix"), pa.array(item.astype(np.int32)), rows.column("fp")], ["trie", "prefix", "item", "fp"])

    keys = ["trie", "prefix"]
    return put.join(hot, keys, "left_anti").unionByName(put.join(hot.select(*keys), keys).select("trie", "prefix", "item", "fp").mapInArrow(items, "trie int, prefix long, item int, fp binary"))


def links(distinct: DataFrame, budget: int = BUDGET, rows: int | None = None) -> DataFrame:
    """(a, b): links that span each component of 64-bit fingerprints at ``budget`` or fewer differing bits.

    distinct: one column fp long of distinct fingerprints.
    """
    rows = distinct.count() if rows is None else rows
    packed = distinct.select("fp").mapInArrow(lambda batches: (pa.record_batch([_binary(b.column(0).to_numpy().view(np.uint64)[:, None])], ["fp"]) for b in batches), "fp binary")
    found = spanning_links(packed, Plan.exact(rows, budget), rows)

    def numbers(batches):
        for b in batches:
            yield pa.record_batch([pa.array(_lanes(b.column(c), 1).ravel().view(np.int64)) for c in ("a", "b")], ["a", "b"])

    return found.mapInArrow(numbers, "a long, b long")


def near_duplicates(docs: DataFrame, budget: int = BUDGET, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp long, component_id) of every row.

    component_id: the smallest non-null key that links reach, the row itself included.  Equal
    texts have equal fingerprints and always link; null, empty and blank texts have fingerprint
    zero.  Repeated rows come out as often as they went in; other columns are ignored.
    """
    each = stage_table(fingerprints(docs, key, text).withColumnRenamed(key, "key"), "fingerprints")
    distinct = stage_table(each.groupBy("fp").agg(F.min("key").alias("least"), F.count("*").alias("n")), "distinct")
    rows = distinct.count()
    linked = star_components(links(distinct, budget, rows), "a", "b")
    rooted = distinct.join(linked, distinct["fp"] == linked["node"], "left").select("fp", "least", F.col("n").alias("copies"), F.coalesce("root", "fp").alias("root"))
    rooted = stage_table(rooted, "rooted")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    of = dealt_join(rooted, named, "root", "fp", rows).select("fp", "component_id", F.col("copies").alias("n"))
    return dealt_join(each, stage_table(of, "components"), "fp", "key", each.count()).select(F.col("key").alias(key), "fp", "component_id")


def sketch(column: pa.Array) -> np.ndarray:
    """Wide fingerprints of texts, a row each: the majority of every bit over the distinct WIDE_SHINGLE-word shingles.

    Fewer words are one shingle; no words give zero.
    """
    raw, at = text_bytes(column)
    low = LOWER[raw]
    starts, stops, first = word_spans(low, at, NON_SPACE)
    words = np.append(hash_spans(low, starts, stops), np.zeros(WIDE_SHINGLE, np.uint64))
    n = np.diff(first)
    m = np.where(n > 0, np.maximum(1, n - WIDE_SHINGLE + 1), 0)
    row, place = np.repeat(np.arange(len(n)), m), ragged(first[:-1], m)
    shingle = np.zeros(len(place), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WIDE_SHINGLE):
            shingle = mix(shingle + np.where(place + k < first[1:][row], words[place + k], np.uint64(0)))
        order = np.lexsort([shingle, row])
        shingle, row = shingle[order], row[order]
        new = np.ones(len(row), bool)
        new[1:] = (shingle[1:] != shingle[:-1]) | (row[1:] != row[:-1])
        shingle, row = shingle[new], row[new]
        ones = np.zeros((len(n), 64 * LANES), np.int32)
        for lo in range(0, len(row), 8192):
            some, of = shingle[lo : lo + 8192], row[lo : lo + 8192]
            lanes = np.stack([mix(some + np.uint64(k) * _LANE) for k in range(LANES)], 1).astype(">u8")
            bits = np.unpackbits(lanes.view(np.uint8).reshape(len(some), -1), axis=1)
            cut = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            ones[of[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.uint16)
    size = np.bincount(row, minlength=len(n))
    return np.ascontiguousarray(np.packbits(ones * 2 > size[:, None], axis=1)).view(">u8").reshape(len(n), LANES).astype(np.uint64)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their group: of each group that near
    copies connect, the row with the smallest key (of equal keys, the one with the smallest hash).

    Near copies: five-word shingles whose Jaccard similarity the wide fingerprints put at
    SIMILARITY or more.  Rows without words are copies of each other.  Of rows that repeat as a
    whole one stays.  Rows without a key stay.  An empty table gives no rows.
    """
    from pyspark.sql import Window

    rows, named = boxed(docs)
    kind = rows.schema[named[key]].dataType.simpleString()
    plain = [F.col(f.name) for f in rows.schema if "map<" not in f.dataType.simpleString()]
    marked = rows.select(F.col(named[key]).alias("key"), F.xxhash64(*plain).alias("hash"), F.col(named[text]).alias("text"), F.struct(*rows.columns).alias("rest"))

    def sketched(batches):
        for batch in batches:
            for piece in sliced(batch, "text", 1 << 20):
                yield pa.record_batch([piece.column("key"), piece.column("hash"), _binary(sketch(piece.column("text")))], ["key", "hash", "fp"])

    keyed = marked.where(F.col("key").isNotNull())
    each = stage_table(keyed.select("key", "hash", "text").mapInArrow(thrifty(sketched), f"key {kind}, hash long, fp binary"), "sketches")
    distinct = stage_table(each.groupBy("fp").agg(F.min(F.struct("key", "hash")).alias("least")).withColumn("id", F.xxhash64("fp")), "distinct")
    found = spanning_links(distinct, Plan.wide(), distinct.count()).select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"))
    linked = star_components(found, "a", "b")
    rooted = distinct.join(linked, distinct["id"] == linked["node"], "left").select("least", F.coalesce("root", "id").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("least")).select("least.key", "least.hash")
    times = each.groupBy("key", "hash").agg(F.count("*").alias("times"))
    chosen = stage_table(least.join(times, ["key", "hash"]), "chosen")
    # Dealt by key at every size; the keys are hashed and the texts stream past them, unsorted.
    kept = keyed.select("key", "hash", "rest").join(chosen.hint("shuffle_hash"), ["key", "hash"])
    again = chosen.where("times > 1")
    if not again.isEmpty():
        rank = F.row_number().over(Window.partitionBy("key", "hash").orderBy("hash"))
        repeated = keyed.select("key", "hash", "rest").join(again.hint("shuffle_hash"), ["key", "hash"]).withColumn("rank", rank).where("rank = 1")
        kept = kept.where("times = 1").select("rest").unionByName(repeated.select("rest"))
    return kept.select("rest").unionByName(marked.where(F.col("key").isNull()).select("rest")).select(*unboxed(F.col("rest"), docs))


def jaccard(a: str | None, b: str | None) -> float:
    """Similarity of two texts' five-word shingles by plain sets, for tests; two texts without words agree."""
    sets = []
    for t in (a, b):
        words = (t or "").encode().translate(bytes(LOWER.tolist())).split()
        n = max(1, len(words) - WIDE_SHINGLE + 1) if words else 0
        sets.append({tuple(words[i : i + WIDE_SHINGLE]) for i in range(n)})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0
