"""Suffix sorting of shards that do not fit in memory.

``ExternalSorter`` sorts as ``Sorter`` does, but text, types, positions and values are
files of the task's scratch folder, mapped, and read in pieces.  Its LMS suffixes are
sorted by recursion: a first induction sorts the LMS substrings, which get names; the
string of names is sorted by the same induction, level by level, until it fits in
memory.  On every level what a scan induces waits in a queue on disk, by ranges of
the first value, until the scan comes to its range; within a range the scan takes as
many tuples at a time as cannot induce anything before the last of them.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

from chronoline.llm.induced import Sorter

#: Values of a string of names that is sorted in memory, and tuples of a range, of a piece, of a step of a scan.
IN_MEMORY, RANGE, PIECE, STEP = 1 << 19, 1 << 16, 1 << 18, 1 << 12


class Scratch:
    """Arrays in a folder that goes with it."""

    def __init__(self):
        self.folder = tempfile.TemporaryDirectory(prefix="suffixes-")
        self.made = 0

    def path(self) -> str:
        self.made += 1
        return os.path.join(self.folder.name, str(self.made))

    def room(self, n: int, dtype) -> np.ndarray:
        if not n:
            return np.zeros(0, dtype)
        return np.memmap(self.path(), dtype, "w+", shape=(n,))

    def close(self) -> None:
        self.folder.cleanup()


class Ranges:
    """Two queues of positions for each range of first values: those that are induced, and the seeds."""

    def __init__(self, scratch: Scratch, bounds: np.ndarray, limit: int):
        self.scratch, self.bounds, self.limit = scratch, bounds, limit
        self.held: list[list[list[np.ndarray]]] = [[[], []] for _ in range(len(bounds) - 1)]
        self.files: dict[tuple[int, int], str] = {}
        self.size = 0

    def push(self, kind: int, keys: np.ndarray, pos: np.ndarray) -> None:
        at = np.searchsorted(self.bounds, keys, "right") - 1
        order = np.argsort(at, kind="stable")
        at, pos = at[order], pos[order]
        cut = np.flatnonzero(np.diff(at, prepend=-1))
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(at)]):
            self.held[int(at[a])][kind].append(pos[a:b])
        self.size += pos.nbytes
        if self.size > self.limit:
            for r, kinds in enumerate(self.held):
                for k in (0, 1):
                    if kinds[k]:
                        with open(self.files.setdefault((r, k), self.scratch.path()), "ab") as f:
                            for x in kinds[k]:
                                f.write(np.ascontiguousarray(x, np.int64).tobytes())
                        kinds[k] = []
            self.size = 0

    def pop(self, r: int, kind: int) -> np.ndarray:
        parts = self.held[r][kind]
        self.size -= sum(x.nbytes for x in parts)
        self.held[r][kind] = []
        if path := self.files.pop((r, kind), None):
            parts = [np.fromfile(path, np.int64), *parts]
            os.remove(path)
        return np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)


def types(text: np.ndarray, ends: np.ndarray, scratch: Scratch, cap: int = 0) -> tuple[np.ndarray, np.ndarray | None]:
    """Whether each suffix is smaller than the next (S), and how many equal values follow in a row from it, up to ``cap``.

    Separators, at ``ends``, are S.  The text is read in pieces from its end.
    """
    n = len(text)
    s = scratch.room(n, bool)
    run = scratch.room(n, np.int16) if cap else None
    after, up, length = -1, True, 0  # of the place behind the piece: its value, whether it is S, its run
    for lo in range((n - 1) // PIECE * PIECE, -1, -PIECE):
        t = np.append(np.asarray(text[lo : lo + PIECE], np.int64), after)
        m = len(t) - 1
        change = np.flatnonzero(t[1:] != t[:-1])  # the last index of each run that ends within the piece
        last = np.append(change, m - 1) if not len(change) or change[-1] != m - 1 else change
        rises = np.where(t[last] != t[last + 1], t[last] < t[last + 1], up)
        if after == -1:
            rises[-1] = True
        sizes = np.diff(last, prepend=-1)
        more = np.where(t[last] == t[last + 1], length, 0)
        s[lo : lo + m] = np.repeat(rises, sizes)
        if cap:
            run[lo : lo + m] = np.minimum(np.repeat(last + more, sizes) - np.arange(m) + 1, cap)
        length = int(last[0] + more[0] + 1)
        after, up = int(t[0]), bool(rises[0])
    for lo in range(0, len(ends), PIECE):
        s[ends[lo : lo + PIECE]] = True
    return s, run


def _where(flags: np.ndarray, scratch: Scratch) -> np.ndarray:
    """Positions of the set flags."""
    total = sum(int(np.count_nonzero(flags[lo : lo + PIECE])) for lo in range(0, len(flags), PIECE))
    out, size = scratch.room(total, np.int64), 0
    for lo in range(0, len(flags), PIECE):
        at = np.flatnonzero(flags[lo : lo + PIECE]) + lo
        out[size : size + len(at)] = at
        size += len(at)
    return out


def lms_places(s: np.ndarray, ends: np.ndarray, scratch: Scratch) -> np.ndarray:
    seed = scratch.room(len(s), bool)
    for lo in range(0, len(s), PIECE):
        before = np.append(s[lo - 1] if lo else True, s[lo : lo + PIECE])
        seed[lo : lo + PIECE] = before[1:] & ~before[:-1]
    for lo in range(0, len(ends), PIECE):
        seed[ends[lo : lo + PIECE]] = True
    return _where(seed, scratch)


class Induction:
    """Inducing scans over one string of whole values, 0 being separators that differ by their place."""

    def __init__(self, text: np.ndarray, s: np.ndarray, scratch: Scratch, limit: int):
        self.text, self.s, self.scratch, self.limit = text, s, scratch, limit
        top = max(int(text[lo : lo + PIECE].max()) for lo in range(0, len(text), PIECE)) + 1
        self.top = top
        counts = scratch.room(top, np.int64)
        for lo in range(0, len(text), PIECE):
            names, times = np.unique(text[lo : lo + PIECE], return_counts=True)
            counts[names] += times
        self.counts = counts

    def _bounds(self, rising: bool) -> np.ndarray:
        """First keys of ranges of about RANGE suffixes, or of one value."""
        out, total = [0], 0
        for lo in range(0, self.top, PIECE):
            part = self.counts[lo : lo + PIECE] if rising else self.counts[::-1][lo : lo + PIECE]
            sums = np.cumsum(part)
            base = 0
            while (k := int(np.searchsorted(sums, base + RANGE - total, "left"))) < len(part):
                out.append(lo + k + 1)
                base, total = int(sums[k]), 0
            total += int(sums[-1]) - base if len(sums) else 0
        return np.unique(np.append(np.array(out, np.int64), self.top + 1))

    def scan(self, seeds: Iterator[np.ndarray], rising: bool) -> Iterator[np.ndarray]:
        """Positions in the scan's order, a piece at a time: L suffixes from LMS ones if rising, else S ones from L ones.

        Seeds of one value come in their order; of one value, what is induced precedes the seeds.
        """
        key = (lambda p: np.asarray(self.text[p], np.int64)) if rising else (lambda p: self.top - 1 - np.asarray(self.text[p], np.int64))
        queue = Ranges(self.scratch, self._bounds(rising), self.limit)
        for part in seeds:
            queue.push(1, key(part), part)
        for r in range(len(queue.bounds) - 1):
            high = int(queue.bounds[r + 1])
            pos = np.concatenate([queue.pop(r, 0), seed := queue.pop(r, 1)])
            rank = key(pos) * 2
            rank[len(pos) - len(seed) :] += 1
            order = np.argsort(rank, kind="stable")
            pos, rank, at = pos[order], rank[order], 0
            while at < len(pos):
                p, k = pos[at : at + STEP], rank[at : at + STEP]
                before = p - 1
                ok = p > 0
                ok[ok] = self.s[before[ok]] != rising
                if not rising:
                    ok[ok] = self.text[before[ok]] > 0
                to = np.full(len(p), np.iinfo(np.int64).max)
                to[ok] = key(before[ok]) * 2
                # What is induced comes after all that has its value already, so a step may go on to there.
                fine = np.minimum.accumulate(to) > k
                take = len(p) if fine.all() else int(np.argmin(fine))
                if not take:
                    take = int(np.searchsorted(k, k[0], "right"))  # one value's run: its successors follow them all
                yield p[:take]
                ok = ok[:take]
                fresh, to = before[:take][ok], to[:take][ok]
                at += take
                here = to < 2 * high
                if here.any():
                    pos, rank, at = pos[at:], rank[at:], 0
                    by = np.argsort(to[here], kind="stable")
                    spot = np.searchsorted(rank, to[here][by], "right")
                    pos, rank = np.insert(pos, spot, fresh[here][by]), np.insert(rank, spot, to[here][by])
                if not here.all():
                    queue.push(0, to[~here] // 2, fresh[~here])

    def sorted(self, seeds: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
        """All suffixes but the separators, from the largest to the smallest, by both scans from LMS suffixes."""
        n = len(self.text)
        left, size = self.scratch.room(n, np.int64), 0
        for part in self.scan(seeds, True):
            part = part[~self.s[part]]
            left[size : size + len(part)] = part
            size += len(part)
        falling = (left[max(0, hi - PIECE) : hi][::-1] for hi in range(size, 0, -PIECE))
        yield from self.scan(falling, False)


def _pieces(a: np.ndarray) -> Iterator[np.ndarray]:
    return (np.asarray(a[lo : lo + PIECE]) for lo in range(0, len(a), PIECE))


def _named(text: np.ndarray, lms: np.ndarray, falling: Iterator[np.ndarray], is_lms: np.ndarray, scratch: Scratch) -> tuple[np.ndarray, int]:
    """Names of the LMS substrings by LMS number, rising with them, and how many there are; separators are 0."""
    number = scratch.room(len(text), np.int64)  # of each LMS place
    for lo in range(0, len(lms), PIECE):
        part = lms[lo : lo + PIECE]
        number[part] = np.arange(lo, lo + len(part))
    names, name, last = scratch.room(len(lms), np.int64), 0, None
    seen = 0
    for part in falling:
        part = part[is_lms[part] & (text[part] > 0)]
        if not len(part):
            continue
        seen += len(part)
        pair = part if last is None else np.append(last, part)
        k = number[pair]
        size = np.where(k + 1 < len(lms), lms[np.minimum(k + 1, len(lms) - 1)], pair) - pair + 1
        same = size[1:] == size[:-1]
        live, j = np.flatnonzero(same), 0
        while len(live):
            equal = text[pair[live] + j] == text[pair[live + 1] + j]
            same[live[~equal]] = False
            j += 1
            live = live[equal & (size[live] > j)]
        new = np.concatenate([[last is None], ~same]) if last is None else ~same
        ids = name + np.cumsum(new)
        names[number[part]] = ids
        name, last = int(ids[-1]), part[-1]
    # Names were given from the largest on; turned round they rise, and separators stay 0.
    for lo in range(0, len(names), PIECE):
        part = names[lo : lo + PIECE]
        names[lo : lo + PIECE] = np.where(part > 0, name + 1 - part, 0)
    return names, name


def lms_order(text: np.ndarray, s: np.ndarray, lms: np.ndarray, scratch: Scratch, limit: int) -> np.ndarray:
    """LMS places by their suffixes' order, separators by their place first: by recursion on the names of their substrings."""
    n = len(lms)
    zeros = sum(int(np.count_nonzero(text[p] == 0)) for p in _pieces(lms))
    flags = scratch.room(len(text), bool)
    for p in _pieces(lms):
        flags[p] = True
    induction = Induction(text, s, scratch, limit)
    names, count = _named(text, lms, induction.sorted(_pieces(lms)), flags, scratch)
    out = scratch.room(n, np.int64)
    if count == n - zeros:  # all differ
        size = 0
        for lo in range(0, n, PIECE):
            part, at = names[lo : lo + PIECE], lms[lo : lo + PIECE]
            out[np.where(part > 0, zeros + part - 1, 0)[part > 0]] = at[part > 0]
            out[size : size + int((part == 0).sum())] = at[part == 0]
            size += int((part == 0).sum())
        return out
    order = suffix_order(names, scratch, limit)
    for lo in range(0, n, PIECE):
        out[lo : lo + PIECE] = lms[order[lo : lo + PIECE]]
    return out


def suffix_order(text: np.ndarray, scratch: Scratch, limit: int) -> np.ndarray:
    """Places of the suffixes of a string of names in their order, the separators (0) by their place first."""
    n = len(text)
    if n <= IN_MEMORY:
        return Sorter([], 1)._by_names(np.asarray(text))
    flags = scratch.room(n, bool)
    for lo in range(0, n, PIECE):
        flags[lo : lo + PIECE] = text[lo : lo + PIECE] == 0
    ends = _where(flags, scratch)
    s, _ = types(text, ends, scratch)
    lms = lms_places(s, ends, scratch)
    seeds = lms_order(text, s, lms, scratch, limit)
    out = scratch.room(n, np.int64)
    out[: len(ends)] = ends
    hi = n
    for part in Induction(text, s, scratch, limit).sorted(_pieces(seeds)):
        part = part[text[part] > 0]
        out[hi - len(part) : hi] = part[::-1]
        hi -= len(part)
    return out


class ExternalSorter(Sorter):
    """``Sorter`` over files.  strings: an iterator of byte strings; sizes: their lengths."""

    def __init__(self, strings: Iterator[bytes], sizes: np.ndarray, cap: int, limit: int = 64 << 20):
        self.cap, self.limit, self.limits, self.piece, self.scratch = cap, limit, (limit,), PIECE, Scratch()
        self.ends = np.cumsum(sizes + 1) - 1
        n = int(self.ends[-1]) + 1
        self._padded = self.scratch.room(n + 4, np.int16)
        self.text = self._padded[:n]
        at = 0
        for x in strings:
            self.text[at : at + len(x)] = np.frombuffer(x, np.uint8).astype(np.int16) + 1
            at += len(x) + 1

    def room(self, n: int, dtype) -> np.ndarray:
        return self.scratch.room(n, dtype)

    def close(self) -> None:
        self.scratch.close()

    def _lanes(self) -> np.ndarray:
        return self._padded

    def sort(self) -> tuple[np.ndarray, np.ndarray]:
        text, scratch, keys = self.text, self.scratch, 257
        s, run = types(text, self.ends, scratch, self.cap)
        lms = lms_places(s, self.ends, scratch)
        order = lms_order(text, s, lms, scratch, self.limit)
        values = self._neighbour_values(order)
        wants_l = scratch.room(len(s), bool)
        for lo in range(0, len(s), PIECE):
            wants_l[lo : lo + PIECE] = ~s[lo : lo + PIECE]
        heads = self._heads(order, keys)
        pos, val = self._scan(text, wants_l, run, [order[heads[k] : heads[k + 1]] for k in range(keys)], [values[heads[k] : heads[k + 1]] for k in range(keys)], rising=True)
        back_pos, back_val = self._turned(pos, val, s)
        tails = self._heads(back_pos, keys)
        total = len(back_pos)
        by_key = [slice(total - tails[k + 1], total - tails[k]) for k in range(keys)]
        return self._scan(text, s, run, [back_pos[by_key[k]] for k in range(keys)], [back_val[by_key[k]] for k in range(keys)], rising=False)

    def _heads(self, places: np.ndarray, keys: int) -> np.ndarray:
        """How many places have a first value under each key."""
        count = np.zeros(keys, np.int64)
        for p in _pieces(places):
            count += np.bincount(self.text[p], minlength=keys)
        return np.append(0, np.cumsum(count))

    def _turned(self, pos: np.ndarray, val: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The L suffixes in falling order, each with its value towards the one before it."""
        total = sum(int(np.count_nonzero(~s[p])) for p in _pieces(pos))
        out_pos, out_val = self.room(total, np.int64), self.room(total, np.int16)
        at, least = total, self.cap  # least value since the last L suffix
        for lo in range(0, len(pos), PIECE):
            p, v = np.asarray(pos[lo : lo + PIECE]), np.asarray(val[lo : lo + PIECE])
            keep = np.flatnonzero(~s[p])
            if not len(keep):
                least = min(least, int(v.min()))
                continue
            low = np.minimum.reduceat(v[: keep[-1] + 1], np.append(0, keep[:-1] + 1))
            low[0] = min(int(low[0]), least)
            k = len(keep)
            # In falling order a suffix's value is that of the next larger one here.
            out_pos[at - k : at] = p[keep][::-1]
            first = at == total
            spots = np.arange(at, at - k, -1)
            if first:
                spots, low = spots[1:], low[1:]
            out_val[spots] = low
            at -= k
            rest = v[keep[-1] + 1 :]
            least = min(self.cap, int(rest.min())) if len(rest) else self.cap
        if total:
            out_val[0] = 0
        return out_pos, out_val

    def _neighbour_values(self, order: np.ndarray) -> np.ndarray:
        out = self.room(len(order), np.int16)
        for lo in range(0, len(order), PIECE):
            part = np.asarray(order[max(0, lo - 1) : lo + PIECE])
            found = Sorter._neighbour_values(self, part)
            out[lo : lo + PIECE] = found[1:] if lo else found
        return out


def repeated_starts(strings: Iterator[bytes], sizes: np.ndarray, weights: np.ndarray, depth: int, limit: int = 64 << 20) -> Iterator[np.ndarray]:
    """For each string, the offsets whose ``depth`` bytes stand at two places or more, as ``induced.repeated_starts``; over files."""
    sorter = ExternalSorter(strings, sizes, depth, limit)
    try:
        pos, val = sorter.sort()
        ends, n = sorter.ends, len(pos)
        hit = sorter.room(len(sorter.text), bool)
        lo = 0
        while lo < n:
            hi = min(n, lo + PIECE)
            while hi < n:  # a class of equal windows is judged as a whole
                more = np.flatnonzero(np.asarray(val[hi : hi + PIECE]) < depth)
                if len(more):
                    hi += int(more[0])
                    break
                hi = min(n, hi + PIECE)
            p = np.asarray(pos[lo:hi])
            first = np.flatnonzero(np.asarray(val[lo:hi]) < depth)
            owner = np.searchsorted(ends, p)
            total = np.add.reduceat(weights[owner], first)
            many = np.repeat(total >= 2, np.diff(np.append(first, len(p)))) & (ends[owner] - p >= depth)
            hit[p[many]] = True
            lo = hi
        begin = 0
        for size in sizes.tolist():
            yield np.flatnonzero(hit[begin : begin + size])
            begin += size + 1
    finally:
        sorter.close()
