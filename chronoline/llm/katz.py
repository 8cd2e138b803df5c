"""Language-model scoring by Katz backoff over the whole corpus.

Order: P(w|h) of a token after the one before it; an event seen r times after h has
(r - D(r)) / c(h), D by Good-Turing for r <= GT and a constant beyond; the mass that
remains goes to unseen events by the unigram distribution, whose own backoff is the
additive one.  Each level sums to one exactly, the unknown word counted once.

A block of texts keeps its tokens as numbers.  It sends its distinct words to their
owners, which add up the counts and send each block its own; then its distinct pairs
to the owners of their histories, which do the same and also return, for histories
with unseen followers, what the backoff weight needs.  A frequent history's pairs are
spread over several owners.  Blocks, with their counts, lie in a table in the shared
folder, and so do the answers.  What travels is packed: one row for each block and owner.
Words are told apart by 64-bit hashes, the followers of one word by 48 bits of theirs.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoline.llm.common import LOWER, NON_SPACE, bucket_table, crc_mod, hash_spans, packed, sliced, stage_table, text_bytes, unpacked, word_spans

BLOCK_BYTES = 6 << 20
#: Counts with a Good-Turing discount; larger counts lose DISCOUNT.
GT, DISCOUNT = 5, 0.5
ADD = 0.1
#: Not words: the end of a text, and what stands before its first word.
END, BEGIN = np.uint64(1), np.uint64(2)
#: Marks the name of a history whose pairs are spread over owners.
SPREAD = np.uint64(1 << 63)
_M48 = np.uint64((1 << 48) - 1)


def _pack_rising(x: np.ndarray) -> bytes:
    return packed(np.diff(x, prepend=np.uint64(0)))


def _unpack_rising(b: bytes) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumsum(unpacked(b), dtype=np.uint64)


def _owner(hashes: np.ndarray, owners: int) -> np.ndarray:
    """Owners hold ranges of hashes, so that what is sorted by hash is sorted by owner."""
    return ((hashes >> np.uint64(40)) * np.uint64(owners) >> np.uint64(24)).astype(np.int64)


class _Block:
    """Tokens of several texts: numbers into the sorted distinct hashes; ``ends``: where each text's tokens end."""

    def __init__(self, keys, held, ends, codes, hashes):
        self.keys, self.held, self.ends, self.codes, self.hashes = keys, held, ends, codes, hashes

    def histories(self) -> np.ndarray:
        """For each token the number of the one before it; BEGIN's is len(hashes)."""
        out = np.empty(len(self.codes), np.int64)
        out[1:] = self.codes[:-1]
        out[np.concatenate([[0], self.ends[:-1]])] = len(self.hashes)
        return out

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ends)), np.diff(self.ends, prepend=0))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (history, word) as numbers, and each token's pair; sorted by history's and word's number."""
        width = np.int64(len(self.hashes) + 1)
        joint, which = np.unique(self.histories() * width + self.codes, return_inverse=True)
        return joint // width, joint % width, which


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, _Block]]:
    held_back, first, number = [], 0, 0

    def close():
        raw = np.concatenate([h[2] for h in held_back])
        sizes = np.concatenate([h[3] for h in held_back])
        ends = np.cumsum(sizes)
        hashes, codes = np.unique(raw, return_inverse=True)
        return first + number, _Block([k for h in held_back for k in h[0]], np.concatenate([h[1] for h in held_back]), ends, codes.astype(np.int64), hashes)

    room = BLOCK_BYTES
    for batch in batches:
        if batch.num_rows:
            first = batch.column("part")[0].as_py() << 32
        for piece in sliced(batch, "text", BLOCK_BYTES // 2):
            if room < 0:
                yield close()
                held_back, room, number = [], BLOCK_BYTES, number + 1
            raw, at = text_bytes(piece.column("text"))
            low = LOWER[raw]
            starts, stops, words = word_spans(low, at, NON_SPACE)
            hashes = hash_spans(low, starts, stops)
            hashes[hashes <= BEGIN] += np.uint64(3)
            sizes = np.diff(words) + 1
            tokens = np.full(int(sizes.sum()), END)
            is_word = np.ones(len(tokens), bool)
            is_word[np.cumsum(sizes) - 1] = False
            tokens[is_word] = hashes
            held_back.append((piece.column("key").to_pylist(), piece.column("held").to_numpy(zero_copy_only=False).astype(bool), tokens, sizes))
            room -= len(raw)
    if held_back:
        yield close()


def _release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished jobs."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Discounts:
    """D(1..GT) by Good-Turing from counts of counts; where those are too few or odd, one constant."""

    def __init__(self, times: np.ndarray):
        n = times.astype(np.float64)  # n[r]: events seen r times, r = 1..GT+1
        flat = n[1] / (n[1] + 2 * n[2]) if n[1] > 0 else DISCOUNT
        self.d = np.full(GT + 1, min(0.95, max(0.05, flat)))
        if (n[1 : GT + 2] > 0).all():
            common = (GT + 1) * n[GT + 1] / n[1]
            for r in range(1, GT + 1):
                ratio = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if common < 1 else 0
                if 0 < ratio < 1:
                    self.d[r] = r - ratio * r
        self.d[0] = DISCOUNT

    def __call__(self, r: np.ndarray) -> np.ndarray:
        return self.d[np.where(r > GT, 0, r)]


class Katz:
    """Counts of a corpus and the scores of its texts; see ``score``."""

    def __init__(self, docs: DataFrame, held_out, key: str, text: str):
        from pyspark.sql.pandas.types import to_arrow_type

        self.spark, self.key = docs.sparkSession, key
        rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), held_out.alias("held")).withColumn("part", F.spark_partition_id())
        self.kind, self.arrow = rows.schema["key"].dataType.simpleString(), to_arrow_type(rows.schema["key"].dataType)
        self.owners = 2 * max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
        self.blocks, self.counts, self.train_tokens, self.distinct, self.train_texts = self._count_words(rows)
        self.answers, self.discounts, self.spread = self._count_pairs()

    def _count_words(self, rows: DataFrame) -> tuple[DataFrame, DataFrame, int, int, int]:
        owners, arrow, kind = self.owners, self.arrow, self.kind

        def own(batches):
            for block, b in _blocks(batches):
                yield pa.record_batch([pa.array([block], pa.int64()), pa.array([b.keys], pa.list_(arrow)), *[pa.array([x], pa.binary()) for x in (packed(b.held.astype(np.uint8)), packed(b.ends.astype(np.uint64)), packed(b.codes.astype(np.uint32)), _pack_rising(b.hashes))]], _NAMES)

        # Written once: whatever the order of rows in a second scan, a block stays what it is.
        blocks = bucket_table(rows.mapInArrow(own, f"block long, keys array<{kind}>, held binary, ends binary, codes binary, hashes binary"), "block", "katz-blocks")

        def ask(batches):
            for block, b in _read(batches):
                train = ~b.held[b.text_of()]
                count = np.bincount(b.codes[train], minlength=len(b.hashes)).astype(np.uint64)
                cut = np.searchsorted(_owner(b.hashes, owners), np.arange(owners + 1))
                used = [o for o in range(owners) if cut[o] < cut[o + 1]]
                yield pa.record_batch([pa.array(used, pa.int32()), pa.array([block] * len(used), pa.int64()), pa.array([_pack_rising(b.hashes[cut[o] : cut[o + 1]]) for o in used], pa.binary()), pa.array([packed(count[cut[o] : cut[o + 1]]) for o in used], pa.binary())], ["owner", "block", "hashes", "counts"])

        def add(table: pa.Table) -> pa.Table:
            hashes = [_unpack_rising(x) for x in table.column("hashes").to_pylist()]
            counts = [unpacked(x) for x in table.column("counts").to_pylist()]
            total, which = _added(np.concatenate(hashes), np.concatenate(counts))
            out = np.split(total[which], np.cumsum([len(h) for h in hashes])[:-1])
            stats = np.array([total.sum(dtype=np.uint64), (total > 0).sum()], np.uint64)
            return pa.table([pa.array([*table.column("block").to_pylist(), -1], pa.int64()), pa.array([table.column("owner")[0].as_py()] * (len(out) + 1), pa.int32()), pa.array([*map(packed, out), packed(stats)], pa.binary())], ["block", "owner", "payload"])

        asked = blocks.mapInArrow(ask, "owner int, block long, hashes binary, counts binary")
        counts = stage_table(asked.groupBy("owner").applyInArrow(add, "block long, owner int, payload binary"), "katz-words")
        stats = [unpacked(r.payload) for r in counts.where("block < 0").select("payload").collect()]  # one row an owner
        texts = rows.where(~F.col("held")).count()
        _release(self.spark)
        lists = counts.where("block >= 0").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("owner", "payload")))["payload"].alias("payload"))
        return blocks, lists, int(sum(int(s[0]) for s in stats)), int(sum(int(s[1]) for s in stats)), texts

    def counted(self) -> DataFrame:
        """Blocks with the counts of their words, a list of answers by owner; the blocks are not shuffled."""
        return self.blocks.join(self.counts.hint("merge"), "block")

    def _count_pairs(self) -> tuple[DataFrame, Discounts, dict[int, tuple]]:
        owners, total, texts = self.owners, self.train_tokens, self.train_texts

        def ask(batches):
            for (block, b), count in _read_counted(batches):
                h, w, which = b.pairs()
                train = ~b.held[b.text_of()]
                times = np.bincount(which[train], minlength=len(h)).astype(np.uint64)
                owner, hh = _pair_owner(b, count, h, w, owners, total, texts)
                order = np.lexsort([b.hashes[w] & _M48, hh, owner])
                owner, hh, h, w, times = owner[order], hh[order], h[order], w[order], times[order]
                cut = np.searchsorted(owner, np.arange(owners + 1))
                for o in range(owners):
                    s = slice(cut[o], cut[o + 1])
                    if s.start == s.stop:
                        continue
                    new = np.flatnonzero(np.concatenate([[True], hh[s][1:] != hh[s][:-1]]))
                    size = np.diff(np.append(new, s.stop - s.start)).astype(np.uint32)
                    follow = (b.hashes[w[s]] & _M48).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                    yield pa.record_batch([pa.array([o], pa.int32()), pa.array([block], pa.int64()), pa.array([_pack_rising(hh[s][new])], pa.binary()), pa.array([packed(size)], pa.binary()), pa.array([np.ascontiguousarray(follow.T).tobytes()], pa.binary()), pa.array([packed(times[s])], pa.binary()), pa.array([packed(count[w[s]])], pa.binary())], ["owner", "block", "histories", "sizes", "words", "times", "counts"])

        def add(table: pa.Table) -> pa.Table:
            cols = {c: table.column(c).to_pylist() for c in table.column_names}
            heads, sizes = [_unpack_rising(x) for x in cols["histories"]], [unpacked(x) for x in cols["sizes"]]
            times, counts = np.concatenate([unpacked(x) for x in cols["times"]]), np.concatenate([unpacked(x) for x in cols["counts"]])
            words = []
            for x in cols["words"]:
                six = np.zeros((len(x) // 6, 8), np.uint8)
                six[:, :6] = np.frombuffer(x, np.uint8).reshape(6, -1).T
                words.append(six.view("<u8").ravel())
            history, where = np.unique(np.concatenate(heads), return_inverse=True)
            head_of = np.repeat(where, np.concatenate(sizes))
            order = np.lexsort([np.concatenate(words), head_of])
            a, b = head_of[order], np.concatenate(words)[order]
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            pair = np.empty(len(order), np.int64)
            pair[order] = np.cumsum(new) - 1
            r = np.bincount(pair, times).astype(np.uint64)  # sums of doubles are exact up to 2^53
            first = order[new]
            n = len(history)
            owner_head = head_of[first]
            per = np.stack([np.bincount(owner_head, r == k, n) for k in range(1, GT + 1)])
            over = np.bincount(owner_head, np.where(r > GT, r - DISCOUNT, 0), n)
            # Words that all texts of the training part together have seen after the history.
            seen = np.bincount(owner_head, np.where(r > 0, counts[first] + ADD, 0), n)
            rows, blocks, at, head_at = [], [], 0, 0
            for block, size, head in zip(cols["block"], sizes, heads):
                m = int(size.sum())
                got = r[pair[at : at + m]]
                spot = where[head_at : head_at + len(head)]
                lack = np.add.reduceat((got == 0).astype(np.int64), np.cumsum(size.astype(np.int64)) - size) > 0
                need = spot[lack]
                rows.append((packed(got), packed(np.concatenate([per[:, need].ravel(), over[need], seen[need]]).view(np.uint64)), packed(np.flatnonzero(lack).astype(np.uint32))))
                blocks.append(block)
                at, head_at = at + m, head_at + len(head)
            cofc = np.array([(r == k).sum() for k in range(GT + 2)], np.uint64)
            rows.append((packed(cofc), packed(np.zeros(0, np.uint64)), packed(np.zeros(0, np.uint32))))
            blocks.append(-1)
            owner = cols["owner"][0]
            # Histories that are spread over owners are put together by the driver: a bounded number, see _pair_owner.
            split = history >= SPREAD
            if split.any():
                rows.append((packed(history[split]), packed(np.concatenate([per[:, split].ravel(), over[split], seen[split]]).view(np.uint64)), packed(np.zeros(0, np.uint32))))
                blocks.append(-2)
            return pa.table([pa.array(blocks, pa.int64()), pa.array([owner] * len(rows), pa.int32()), *[pa.array([x[i] for x in rows], pa.binary()) for i in range(3)]], ["block", "owner", "times", "shares", "which"])

        asked = self.counted().mapInArrow(ask, "owner int, block long, histories binary, sizes binary, words binary, times binary, counts binary")
        answers = stage_table(asked.groupBy("owner").applyInArrow(add, "block long, owner int, times binary, shares binary, which binary"), "katz-answers")
        cofc, spread = np.zeros(GT + 2, np.uint64), {}
        for row in answers.where("block < 0").collect():  # two rows an owner at most
            if row.block == -1:
                cofc += unpacked(row.times)
            else:
                history = unpacked(row.times)
                for name, part in zip(history.tolist(), unpacked(row.shares).view(np.float64).reshape(GT + 2, -1).T):
                    spread[name] = spread.get(name, 0) + part
        _release(self.spark)
        return answers.where("block >= 0"), Discounts(cofc), spread

    def score(self) -> DataFrame:
        """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
        arrow, owners, total, distinct, texts = self.arrow, self.owners, self.train_tokens, self.distinct, self.train_texts
        discounts, spread = self.discounts, self.spark.sparkContext.broadcast(self.spread)
        norm = total + ADD * (distinct + 1)

        def settle(mine: pa.Table, theirs: pa.Table) -> pa.Table:
            owner = theirs.column("owner").to_pylist()
            order = sorted(range(len(owner)), key=owner.__getitem__)
            ((_, b), count) = next(_read_counted([mine]))
            cols = {c: theirs.column(c) for c in ("times", "shares", "which")}
            h, w, which = b.pairs()
            place, hh = _pair_owner(b, count, h, w, owners, total, texts)
            sort = np.lexsort([b.hashes[w] & _M48, hh, place])
            r = np.zeros(len(h), np.int64)
            r[sort] = np.concatenate([unpacked(cols["times"][i].as_py()) for i in order]) if len(h) else 0
            share = np.full((len(h), GT + 2), np.nan)  # by pair; only unseen ones' are read
            cut = np.searchsorted(place[sort], np.arange(owners + 1))
            for i in order:
                o = owner[i]
                s = sort[cut[o] : cut[o + 1]]
                new = np.flatnonzero(np.concatenate([[True], hh[s][1:] != hh[s][:-1]]))
                lack = unpacked(cols["which"][i].as_py())
                values = np.full((len(new), GT + 2), np.nan)
                values[lack] = unpacked(cols["shares"][i].as_py()).view(np.float64).reshape(GT + 2, -1).T
                share[s] = np.repeat(values, np.diff(np.append(new, len(s))), axis=0)
            whole = np.append(count, texts).astype(np.float64)[h]  # c(h)
            unigram = np.log10((count[w] + ADD) / norm)
            d = discounts(r)
            lost = (r == 0) & (whole > 0)
            for j in np.flatnonzero(lost & (hh >= SPREAD)).tolist():
                share[j] = spread.value[int(hh[j])]
            mass = share[:, :GT] @ (np.arange(1, GT + 1) - discounts.d[1:]) + share[:, GT]
            with np.errstate(divide="ignore", invalid="ignore"):
                backed = np.log10((whole - mass) / (1 - share[:, GT + 1] / norm)) - np.log10(whole) + unigram
                value = np.where(r > 0, np.log10(r - d) - np.log10(whole), np.where(lost, backed, unigram))
            n = np.diff(b.ends, prepend=0)
            begin = b.ends - n
            known = count[b.codes] > 0
            base = np.log10((count[b.codes] + ADD) / norm)
            add = lambda x: np.add.reduceat(x.astype(np.float64), begin)
            return pa.table(
                [pa.array(b.keys, arrow), pa.array(b.held), pa.array(n, pa.int64()), pa.array(np.add.reduceat(known.astype(np.int64), begin)), pa.array(np.full(len(n), total), pa.int64()), pa.array(add(base)), pa.array(add(value[which]))],
                ["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

        schema = f"key {self.kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
        out = self.counted().groupBy("block").cogroup(self.answers.groupBy("block")).applyInArrow(settle, schema)
        return out.withColumnRenamed("key", self.key)


_NAMES = ["block", "keys", "held", "ends", "codes", "hashes"]


def _read(batches) -> Iterator[tuple[int, _Block]]:
    """(block number, block) from rows of the block table."""
    for batch in batches:
        for i in range(batch.num_rows):
            c = {n: batch.column(n)[i].as_py() for n in _NAMES}
            held = unpacked(c["held"]).astype(bool)
            yield c["block"], _Block(c["keys"], held, unpacked(c["ends"]).astype(np.int64), unpacked(c["codes"]).astype(np.int64), _unpack_rising(c["hashes"]))


def _read_counted(batches) -> Iterator[tuple[tuple[int, _Block], np.ndarray]]:
    """The same with the counts of each block's words."""
    for batch in batches:
        for found, payload in zip(_read([batch]), batch.column("payload").to_pylist()):
            yield found, np.concatenate([np.zeros(0, np.uint64), *map(unpacked, payload)])


def _added(names: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums by distinct name, whole to 64 bits, and each name's place among them."""
    order = np.argsort(names, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = names[order][1:] != names[order][:-1]
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return np.add.reduceat(counts[order], np.flatnonzero(new)) if len(order) else counts, which


def _pair_owner(b: _Block, count: np.ndarray, h: np.ndarray, w: np.ndarray, owners: int, total: int, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Owner and name of the history of each pair.

    A history with more than total / (2 * owners) tokens (so fewer than 2 * owners + 1 of them)
    is spread by its followers' hashes.  A name is the history's hash, its top bit replaced by
    whether it is spread; words whose hashes differ in that bit only have different owners.
    """
    names, often = np.append(b.hashes, BEGIN), np.append(count, texts).astype(np.int64)
    heavy = often > max(1, total // (2 * owners))
    spread = heavy[h]
    owner = _owner(names, owners)[h]
    owner[spread] = _owner(b.hashes[w[spread]] << np.uint64(17) | b.hashes[w[spread]] >> np.uint64(47), owners)
    return owner, (names & ~SPREAD | np.where(heavy, SPREAD, np.uint64(0)))[h]


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", mod: int = 10, held: int = 0) -> DataFrame:
    """Log10 probabilities of every row's whole text under Katz backoff, learned from the rows whose
    crc32(key) mod ``mod`` is not ``held``.

    A null or empty text is one end token.  Repeated rows are counted and scored one by one.
    Without training rows every level is uniform over the one unknown token.
    """
    return Katz(docs, crc_mod(F.col(key), mod) == held, key, text).score()


def brute(texts: list[str | None], held: list[bool]) -> list[tuple]:
    """The same model by dictionaries, for tests: (n_tokens, n_known, train_tokens, base_score, score)."""
    import math
    import re
    from collections import Counter, defaultdict

    low = bytes(LOWER.tolist())
    rows = [[*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(low)), None] for t in texts]
    uni, big = Counter(), defaultdict(Counter)
    for row, out in zip(rows, held):
        if not out:
            uni.update(row)
            for a, b in zip([0, *row], row):
                big[a][b] += 1
    total, norm = sum(uni.values()), sum(uni.values()) + ADD * (len(uni) + 1)
    times = np.zeros(GT + 2)
    for c in big.values():
        for r in c.values():
            if r <= GT + 1:
                times[r] += 1
    d = Discounts(times)
    out = []
    for row in rows:
        base = value = 0.0
        for a, b in zip([0, *row], row):
            p1 = (uni[b] + ADD) / norm
            base += math.log10(p1)
            c = big.get(a)
            if not c:
                p = p1
            elif b in c:
                p = (c[b] - d.d[c[b] if c[b] <= GT else 0]) / sum(c.values())
            else:
                left = 1 - sum((r - d.d[r if r <= GT else 0]) for r in c.values()) / sum(c.values())
                p = left / (1 - sum((uni[x] + ADD) / norm for x in c)) * p1
            value += math.log10(p)
        out.append((len(row), sum(uni[b] > 0 for b in row), total, base, value))
    return out
