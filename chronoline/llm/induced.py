"""Suffix sorting of many byte strings by external induced sorting.

The strings of a shard stand one after another, each closed by a separator that is
smaller than every byte.  The LMS suffixes are sorted by recursion on the names of
their substrings; two scans then induce the order of all L and of all S suffixes.
What a scan induces waits in a queue of (first byte, rank of the inducer) until its
byte's turn comes; the queue keeps one append-only run a byte and moves its runs to
disk once they exceed a bound, so that only the run that is being read must fit in
memory.  Common-prefix values travel with the tuples: the value between two suffixes
that are induced next to each other is one more than the least value between their
inducers.  Values are capped, as only a fixed depth matters here.

All work is done on whole runs with numpy; a run of equal bytes takes as many rounds
as it has bytes in a row.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

#: Bytes of queued tuples that stay in memory; the rest waits in the task's scratch folder.
QUEUE_BYTES = 64 << 20


class BucketQueue:
    """A priority queue for keys 0..n-1 that are taken in one direction: runs of (position, rank) by key."""

    def __init__(self, keys: int, limit: int = QUEUE_BYTES):
        self.runs: list[list[np.ndarray]] = [[] for _ in range(keys)]
        self.spilled: dict[int, str] = {}
        self.size, self.limit, self.folder = 0, limit, None

    def push(self, key: int, tuples: np.ndarray) -> None:
        self.runs[key].append(tuples)
        self.size += tuples.nbytes
        if self.size > self.limit:
            self._spill()

    def _spill(self) -> None:
        if self.folder is None:
            self.folder = tempfile.TemporaryDirectory(prefix="queue-")
        for key, run in enumerate(self.runs):
            if run:
                path = self.spilled.setdefault(key, os.path.join(self.folder.name, str(key)))
                with open(path, "ab") as f:
                    for x in run:
                        f.write(x.tobytes())
                self.runs[key] = []
        self.size = 0

    def pop(self, key: int) -> np.ndarray:
        """All tuples of a key in the order of their push; two columns."""
        parts = self.runs[key]
        self.size -= sum(x.nbytes for x in parts)
        self.runs[key] = []
        if path := self.spilled.pop(key, None):
            parts = [np.fromfile(path, np.int64).reshape(-1, 2), *parts]
            os.remove(path)
        return np.concatenate(parts) if parts else np.zeros((0, 2), np.int64)

    def pieces(self, key: int, rows: int | None) -> Iterator[np.ndarray]:
        """The same, about ``rows`` of those on disk at a time; all at once without a number."""
        path = self.spilled.get(key)
        if rows is None or path is None:
            yield self.pop(key)
            return
        del self.spilled[key]
        rest = self.pop(key)  # taken out first: what is pushed meanwhile may spill
        with open(path, "rb") as f:
            while len(some := np.fromfile(f, np.int64, 2 * rows)):
                yield some.reshape(-1, 2)
        os.remove(path)
        yield rest

    def close(self) -> None:
        if self.folder is not None:
            self.folder.cleanup()


def _types(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each suffix is smaller than the next (S), and how many equal values follow in a row from it."""
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1])
    last = np.append(change, n - 1)  # last index of each run of equal values
    lengths = np.diff(np.concatenate([[-1], last]))
    up = np.zeros(len(last), bool)
    up[:-1] = text[last[:-1]] < text[last[:-1] + 1]
    up[-1] = True
    return np.repeat(up, lengths), np.repeat(last, lengths) - np.arange(n) + 1


def _least(values: np.ndarray, after: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """min(values[after+1 .. upto]) for rising, touching ranges: upto of one is after of the next."""
    lo, hi = int(after[0]) + 1, int(upto[-1]) + 1
    return np.minimum.reduceat(values[lo:hi], after - int(after[0]))


class Sorter:
    """Suffix array and capped common-prefix values of byte strings."""

    #: Bytes of queued tuples in memory, if not the queue's own bound.
    limits: tuple[int, ...] = ()
    #: Tuples and seeds that a scan takes at a time, if not all of a key.
    piece: int | None = None

    def __init__(self, strings: list[bytes], cap: int):
        self.cap = cap
        sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        self.ends = np.cumsum(sizes + 1) - 1  # places of the separators
        # Sixteen bits a value: numpy sorts those by radix.
        text = np.zeros(int(self.ends[-1]) + 1 if len(strings) else 0, np.int16)
        keep = np.ones(len(text), bool)
        keep[self.ends] = False
        text[keep] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int16) + 1
        self.text = text

    def room(self, n: int, dtype) -> np.ndarray:
        return np.zeros(n, dtype)

    def sort(self) -> tuple[np.ndarray, np.ndarray]:
        """(positions, values): suffixes from the largest to the smallest, separators left out, and each
        one's common prefix with the one before it, counted up to the cap and never over a separator."""
        text = self.text
        if not len(text):
            return np.zeros(0, np.int64), np.zeros(0, np.int16)
        s, run = _types(text)
        s[self.ends] = True
        seed = np.zeros(len(text), bool)
        seed[1:] = s[1:] & ~s[:-1]
        seed[self.ends] = True  # separators are LMS by definition, also that of an empty string
        lms = np.flatnonzero(seed)
        order = lms[self._rank_lms(lms)]
        keys = 257
        heads = np.append(0, np.cumsum(np.bincount(text[order], minlength=keys)))
        values = self._neighbour_values(order)
        pos, val = self._scan(text, ~s, run, [order[heads[k] : heads[k + 1]] for k in range(keys)], [values[heads[k] : heads[k + 1]] for k in range(keys)], rising=True)
        # The L suffixes, largest first, seed the second scan.
        left = ~s[pos]
        back_pos, back_val = self._reverse(pos, val, left)
        tails = np.append(0, np.cumsum(np.bincount(text[back_pos], minlength=keys)[::-1]))[::-1]
        by_key = [slice(tails[k + 1], tails[k]) for k in range(keys)]
        pos, val = self._scan(text, s, run, [back_pos[by_key[k]] for k in range(keys)], [back_val[by_key[k]] for k in range(keys)], rising=False)
        return pos, val

    def _reverse(self, pos: np.ndarray, val: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The kept suffixes in falling order, each with its value towards the kept one before it."""
        at = np.flatnonzero(keep)
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int16)
        out = np.zeros(len(at), np.int16)
        if len(at) > 1:
            out[:-1] = _least(val, at[:-1], at[1:])[: len(at) - 1]
        return pos[at][::-1], out[::-1]

    def _scan(self, text, wanted, run, seeds, seed_values, rising: bool) -> tuple[np.ndarray, np.ndarray]:
        """One inducing scan.  wanted: the type that it induces.  Gives all suffixes that it passes, in its order."""
        n, cap = len(text), self.cap
        pos_out, val_out, size = self.room(n, np.int64), self.room(n, np.int16), 0
        queue = BucketQueue(257, *self.limits)
        try:
            for key in range(257) if rising else range(256, 0, -1):
                begin = size

                def passed(pos: np.ndarray, val: np.ndarray) -> np.ndarray:
                    """Take suffixes over, queue what they induce, give what they induce under the same key."""
                    nonlocal size
                    pos_out[size : size + len(pos)], val_out[size : size + len(pos)] = pos, val
                    rank = np.arange(size, size + len(pos))
                    size += len(pos)
                    ok = pos > 0
                    pos, rank = pos[ok] - 1, rank[ok]
                    ok = wanted[pos]
                    pos, rank = pos[ok], rank[ok]
                    first = text[pos]
                    later = first > key if rising else (first < key) & (first > 0)
                    if later.any():
                        at = np.flatnonzero(later)
                        at = at[np.argsort(first[at], kind="stable")]
                        f, t = first[at], np.stack([pos[at], rank[at]], 1)
                        cut = np.flatnonzero(np.diff(f, prepend=-1))
                        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(f)]):
                            queue.push(int(f[a]), t[a:b])
                    now = first == key if key else np.zeros(len(first), bool)
                    return np.stack([pos[now], rank[now]], 1)

                waiting, last = queue.pieces(key, self.piece), -1
                while True:
                    following = []
                    for tuples in waiting:
                        if not len(tuples):
                            continue
                        rank = tuples[:, 1]
                        val = np.zeros(len(tuples), np.int16)
                        if last >= 0:
                            val[0] = min(cap, 1 + int(val_out[last + 1 : rank[0] + 1].min()))
                        if len(tuples) > 1:
                            val[1:] = np.minimum(cap, 1 + _least(val_out, rank[:-1], rank[1:]).astype(np.int64))
                        last = int(rank[-1])
                        # What they induce under the same key follows them all.
                        if len(more := passed(tuples[:, 0], val)):
                            following.append(more)
                    if not following:
                        break
                    waiting = following
                step = self.piece or max(1, len(seeds[key]))
                for lo in range(0, len(seeds[key]), step):
                    val = np.array(seed_values[key][lo : lo + step])
                    if not lo:
                        # Where the two types meet under one key, they share the shorter of their runs of it.
                        val[0] = min(cap, int(run[pos_out[size - 1]]), int(run[seeds[key][0]])) if size > begin and key else 0
                    rest = passed(np.asarray(seeds[key][lo : lo + step]), val)
                    assert not len(rest)
        finally:
            queue.close()
        return pos_out[:size], val_out[:size]

    def _lanes(self) -> np.ndarray:
        """The text with four values more."""
        return np.concatenate([self.text.astype(np.uint16), np.zeros(4, np.uint16)])

    def _neighbour_values(self, order: np.ndarray) -> np.ndarray:
        """Common prefix of each LMS suffix with the one before it, up to the cap; four values at a time."""
        out = np.zeros(len(order), np.int16)
        text, a, b = self.text, order[:-1], order[1:]
        lanes = np.ndarray((len(text),), "<u8", self._lanes(), strides=(2,))
        ones, tops = np.uint64(0x0001000100010001), np.uint64(0x8000800080008000)
        live, k = np.arange(len(a)), 0
        last = len(text) - 1
        while len(live) and k < self.cap:
            x, y = lanes[np.minimum(a[live] + k, last)], lanes[np.minimum(b[live] + k, last)]
            with np.errstate(over="ignore"):
                whole = (x == y) & ((x - ones) & ~x & tops == 0)  # equal, and no separator among the four
            ended = live[~whole]
            for j in range(3):
                p, q = text[np.minimum(a[ended] + k + j, last)], text[np.minimum(b[ended] + k + j, last)]
                ended = ended[(p == q) & (p > 0)]
                out[ended + 1] += 1
            live = live[whole]
            out[live + 1] += 4
            k += 4
        return np.minimum(out, self.cap)

    def _rank_lms(self, lms: np.ndarray) -> np.ndarray:
        """Order of the LMS suffixes: by their substrings' names, then by recursion on the names."""
        return self._by_names(self._dense(lms, np.append(lms[1:], lms[-1])))

    def _dense(self, lms: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Names 1.. of the LMS substrings in their order; a separator's is 0."""
        text, size = self.text, stop - lms + 1
        names = np.zeros(len(lms), np.int64)
        live = np.flatnonzero(text[lms] > 0)
        if not len(live):
            return names
        group = np.zeros(len(live), np.int64)
        k, most = 0, int(size[live].max())
        active = np.arange(len(live))
        while k < most and len(active):
            idx = live[active]
            chunk = np.zeros(len(active), np.uint64)
            for j in range(6):
                at = lms[idx] + k + j
                # Of two where one is the other's beginning, the longer is smaller: its value there has type L.
                chunk = chunk * np.uint64(512) + np.where(k + j < size[idx], text[np.minimum(at, stop[idx])].astype(np.uint64), np.uint64(511))
            order = np.lexsort([chunk, group[active]])
            g, c = group[active][order], chunk[order]
            new = np.concatenate([[True], (g[1:] != g[:-1]) | (c[1:] != c[:-1])])
            start = np.flatnonzero(new)
            length = np.diff(np.append(start, len(order)))
            # A group is named by the number of suffixes before it, so refining one leaves the others as they are.
            first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            base = np.repeat(first, np.diff(np.append(first, len(order))))
            fresh = g + np.repeat(start, length) - base
            group[active[order]] = fresh
            alive = np.zeros(len(active), bool)
            alive[order] = np.repeat(length > 1, length)
            k += 6
            # One that ends here stays for a round more: it is larger than the longer ones that begin with it.
            active = active[alive & (size[idx] >= k)]
        # A group's name is the number of smaller suffixes, so the taken numbers rise with the order.
        taken = np.zeros(len(live), bool)
        taken[group] = True
        names[live] = np.cumsum(taken)[group]
        return names

    def _by_names(self, names: np.ndarray) -> np.ndarray:
        """Order of the suffixes of the names, each string's closed by its 0, by doubling: the bottom of the recursion.

        Zeros differ: they stand in the order of their strings.
        """
        n = len(names)
        first = names.copy()
        zero = names == 0
        first[zero] = -1
        # A rank is the number of suffixes that are surely smaller; those that share one are still open.
        order = np.argsort(first, kind="stable")
        ranked = first[order]
        head = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        size = np.diff(np.append(head, n))
        rank, count = np.zeros(n, np.int64), np.zeros(n, np.int64)
        rank[order], count[order] = np.repeat(head, size), np.repeat(size, size)
        rank[zero], count[zero] = np.arange(int(zero.sum())), 1
        live, step = np.flatnonzero(count > 1), 1
        while len(live):
            key = rank[live] * (n + 1) + rank[live + step]
            order = np.argsort(key, kind="stable")
            key, group = key[order], rank[live][order]
            new = np.concatenate([[True], key[1:] != key[:-1]])
            head = np.flatnonzero(new)
            size = np.diff(np.append(head, len(live)))
            outer = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            base = np.repeat(outer, np.diff(np.append(outer, len(live))))
            fresh = group + np.repeat(head, size) - base
            rank[live[order]] = fresh
            open_ = np.zeros(len(live), bool)
            open_[order] = np.repeat(size > 1, size)
            live = live[open_]
            step *= 2
        out = np.zeros(n, np.int64)
        out[rank] = np.arange(n)
        return out


def repeated_starts(strings: list[bytes], weights: np.ndarray, depth: int) -> list[np.ndarray]:
    """For each string, the offsets whose ``depth`` bytes stand at two places or more.

    A place counts as often as its string weighs.
    """
    if not len(strings):
        return []
    sorter = Sorter(strings, depth)
    pos, val = sorter.sort()
    sizes = np.diff(sorter.ends, prepend=-1)
    left = np.repeat(sorter.ends, sizes) - np.arange(len(sorter.text))
    weight = np.repeat(weights, sizes)
    first = np.flatnonzero(val < depth)  # a new class where the common prefix falls short
    total = np.add.reduceat(weight[pos], first) if len(first) else np.zeros(0, np.int64)
    many = pos[np.repeat(total >= 2, np.diff(np.append(first, len(pos))))]
    hit = np.zeros(len(sorter.text), bool)
    hit[many] = left[many] >= depth
    at = np.flatnonzero(hit)
    begin = sorter.ends - sizes + 1
    cut = np.append(np.searchsorted(at, begin), len(at)).tolist()
    return [at[a:b] - c for a, b, c in zip(cut, cut[1:], begin.tolist())]
