"""Toxicity: gradient-boosted trees over dense features with isotonic calibration.

Features are rates over the whole text: lexicon densities (a short list of insults
and the words and word beginnings that the training labels single out), how near
the hits stand to second-person words, capitals, punctuation, and hits that only
appear after the common letter substitutions are undone.  The learner is a
histogram booster with logistic loss.  All labelled rows of the sample learn the
lexicon, the trees and the calibration, but none judges itself: a row's features come
from a lexicon that has not counted it, and the calibration sees margins of trees that
were fitted without it.  Texts stay on the executors; the driver gets entries and features.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoline.llm.common import ALNUM, LOWER, Shipped, boxed, crc_mod, hash_spans, hash_word, sliced, stage_table, text_bytes, thrifty, word_spans

#: Bound of the training sample: labelled rows, each with its whole text.
TRAIN_ROWS = 12_000
#: Tasks that share the sample.
SAMPLE_PARTS = 12
#: Parts of the sample for the calibration: trees fitted on the others give a part's margins.
FOLDS = 3
THRESHOLD = 0.7
#: A learned entry needs so many toxic rows, and so many times the clean rows' rate.
MIN_TOXIC, MIN_LIFT = 4, 40.0
#: Lengths in bytes of the word beginnings that are tried as lexicon entries.
STEMS = (4, 5, 6)
# Insults, and second-person words of four languages.
INSULTS = "idiot moron stupid loser scum trash pathetic worthless disgusting clown bastard bitch asshole dumb fool freak imbecile jerk retard vermin".split()
YOU = "you your yours yourself du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()
#: Letters that stand for others, by byte.
LEET = np.arange(256, dtype=np.uint8)
LEET[list(b"0134578@$!|")] = list(b"oieastbasil")
LETTERS = ALNUM.copy()
LETTERS[48:58] = False
NAMES = ["hits", "hit_rate", "stems", "stem_rate", "insults", "near_you", "leet", "joined", "capitals", "shouted", "exclamations", "symbols", "odd_words", "length"]


def _known(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(hashes), bool)
    return table[np.minimum(np.searchsorted(table, hashes), len(table) - 1)] == hashes


def _table(words) -> np.ndarray:
    return np.array(sorted({hash_word(w) for w in words}), np.uint64)


def _entries(column: pa.Array, stem: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct words of each text (stem 0), or of the beginnings of the longer ones."""
    raw, at = text_bytes(column)
    low = LOWER[raw]
    starts, stops, first = word_spans(low, at, ALNUM)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    if stem:
        long = stops - starts > stem
        starts, row = starts[long], row[long]
        stops = starts + stem
    hashes = hash_spans(low, starts, stops)
    order = np.lexsort([hashes, row])
    h, r = hashes[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return r[new], h[new]


class Lexicon:
    """Words, and beginnings of words, that stand in toxic rows of the sample far more often than in clean ones.  Entries are hashes.

    entries: (stem, hash, toxic rows, clean rows) of candidates.  without: the label of a row that
    the counts shall not hold; every entry of that row is one row less of its kind.
    """

    def __init__(self, entries: list[tuple[int, int, int, int]], toxic: int, clean: int, without: int | None = None):
        n1, n0 = max(1, toxic - (without == 1)), max(1, clean - (without == 0))
        tables = {}
        for stem in (0, *STEMS):
            names = np.array([h % (1 << 64) for k, h, _, _ in entries if k == stem], np.uint64)
            times = np.array([t for k, _, t, _ in entries if k == stem], np.float64) - (without == 1)
            other = np.array([c for k, _, _, c in entries if k == stem], np.float64) - (without == 0)
            tables[stem] = np.sort(names[(times >= MIN_TOXIC) & (times / n1 >= MIN_LIFT * (np.maximum(other, 0) + 0.5) / n0)])
        self.words, self.stems = tables[0], {k: tables[k] for k in STEMS}
        self.insults, self.you = _table(w.encode() for w in INSULTS), _table(w.encode() for w in YOU)


def features(column: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """One row of NAMES for each text; an empty text is all zeros."""
    raw, at = text_bytes(column)
    rows = len(at) - 1
    low = LOWER[raw]
    starts, stops, first = word_spans(low, at, ALNUM)
    n = np.diff(first)
    hashes = hash_spans(low, starts, stops)

    def by_row(flags: np.ndarray, cut: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return (total[cut[1:]] - total[cut[:-1]]).astype(np.float64)

    insult = _known(lexicon.insults, hashes)
    hit = insult | _known(lexicon.words, hashes)
    stem = np.zeros(len(hashes), bool)
    for k, table in lexicon.stems.items():
        if len(table):
            stem |= _known(table, hash_spans(low, starts, np.minimum(stops, starts + k))) & (stops - starts > k)
    you, spots = np.flatnonzero(_known(lexicon.you, hashes)), np.flatnonzero(hit | stem)
    near = np.zeros(len(hashes), bool)
    if len(you) and len(spots):
        doc = np.searchsorted(first, np.arange(len(hashes)), "right")
        k = np.searchsorted(you, spots)
        for j in (np.maximum(k - 1, 0), np.minimum(k, len(you) - 1)):
            near[spots] |= (np.abs(you[j] - spots) <= 8) & (doc[you[j]] == doc[spots])
    # Hits that appear once letter substitutions are undone, and across one symbol inside a word.
    leet = LEET[low]
    ls, le, lf = word_spans(leet, at, LETTERS)
    lh = hash_spans(leet, ls, le)
    undone = by_row(_known(lexicon.insults, lh) | _known(lexicon.words, lh), lf)
    odd = np.zeros(len(ls), bool)
    if len(ls) > 1:  # single letters in a row: s t u p i d, s.t.u.p.i.d
        single = (le - ls) == 1
        odd[1:] = single[1:] & single[:-1] & (ls[1:] - le[:-1] == 1)
    upper = (raw >= 65) & (raw <= 90)
    letter = LETTERS[raw]
    shout = by_row(upper, at)
    size = np.maximum(np.diff(at), 1).astype(np.float64)
    count = np.maximum(n, 1).astype(np.float64)
    hits, stems = by_row(hit, first), by_row(stem & ~hit, first)
    total = np.concatenate([[0], np.cumsum(upper)])
    shouted = by_row((total[stops] - total[starts] == stops - starts) & (stops - starts > 1), first) if len(starts) else np.zeros(rows)
    symbol = np.isin(raw, list(b"*@#$%&!?"))
    symbol_in = by_row(symbol, at)
    marks = by_row(raw == 33, at)
    mixed = np.zeros(len(raw), bool)
    if len(raw) > 2:
        mixed[1:-1] = (symbol[1:-1] | ((raw[1:-1] >= 48) & (raw[1:-1] <= 57))) & letter[:-2] & letter[2:]
    columns = [
        hits, 1000 * hits / count, stems, 1000 * stems / count, by_row(insult, first), by_row(near, first), np.maximum(undone - hits, 0), by_row(odd, lf),
        shout / size, shouted / count, marks / size, symbol_in / size, by_row(mixed, at) / count, np.log1p(n),
    ]
    return np.stack(columns, 1) if rows else np.zeros((0, len(NAMES)))


class Boosted:
    """Regression trees of depth DEPTH on binned features, logistic loss, fitted one after another."""

    DEPTH, TREES, RATE, BINS, LEAST, RIDGE = 3, 60, 0.2, 32, 8, 1.0

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.BINS + 1)[1:-1])) for j in range(x.shape[1])]
        # Rare features are zero almost everywhere: quantiles of their positive part are edges too.
        self.edges = [np.unique(np.concatenate([e, [0.0], np.quantile(p, np.linspace(0, 1, 9)) if len(p := x[x[:, j] > 0, j]) else []])) for j, e in enumerate(self.edges)]
        b = self._binned(x)
        rate = (y.sum() + 0.5) / (len(y) + 1)
        self.start = math.log(rate / (1 - rate))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        f = np.full(len(y), self.start)
        for _ in range(self.TREES if 0 < y.sum() < len(y) else 0):
            p = 1 / (1 + np.exp(-f))
            tree, at = self._tree(b, y - p, p * (1 - p))
            self.trees.append(tree)
            f += tree[2][at]

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1)

    def _tree(self, b, g, h):
        nodes = 2**self.DEPTH - 1
        feature, cut, at = np.full(nodes, -1), np.zeros(nodes, np.int64), np.zeros(len(g), np.int64)
        width = int(b.max()) + 2 if b.size else 2
        for node in range(nodes):
            here = np.flatnonzero(at == node)
            best = (1e-6, -1, 0)
            if len(here) >= 2 * self.LEAST:
                base = g[here].sum() ** 2 / (h[here].sum() + self.RIDGE)
                for j in range(b.shape[1]):
                    gs, hs = (np.cumsum(np.bincount(b[here, j], v[here], width))[:-1] for v in (g, h))
                    ns = np.cumsum(np.bincount(b[here, j], minlength=width))[:-1]
                    gain = gs**2 / (hs + self.RIDGE) + (g[here].sum() - gs) ** 2 / (h[here].sum() - hs + self.RIDGE) - base
                    gain[(ns < self.LEAST) | (ns > len(here) - self.LEAST)] = 0
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (gain[k], j, k)
            feature[node], cut[node] = best[1], best[2]
            right = b[here, best[1]] > best[2] if best[1] >= 0 else np.zeros(len(here), bool)
            at[here] = 2 * node + 1 + right
        leaf = at - nodes
        value = np.bincount(leaf, g, 2**self.DEPTH) / (np.bincount(leaf, h, 2**self.DEPTH) + self.RIDGE) * self.RATE
        return (feature, cut, value), leaf

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, out = self._binned(x), np.full(len(x), self.start)
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.DEPTH):
                j = feature[at]
                at = 2 * at + 1 + ((j >= 0) & (b[np.arange(len(x)), np.maximum(j, 0)] > cut[at]))
            out += value[at - (2**self.DEPTH - 1)]
        return out


class Isotonic:
    """Non-decreasing map from margin to share of toxic rows: pooled adjacent violators, joined by lines.

    Each pool counts one toxic and one clean row more, weighted by the sample's rate, so that no score is exactly 0 or 1.
    """

    def __init__(self, margin: np.ndarray, y: np.ndarray):
        order = np.argsort(margin, kind="stable")
        rate = (y.sum() + 0.5) / (len(y) + 1)
        pools: list[list[float]] = []  # toxic rows, rows, lowest and highest margin
        for m, v in zip(margin[order], y[order]):
            if pools and pools[-1][3] == m:
                pools[-1][0] += v
                pools[-1][1] += 1
            else:
                pools.append([float(v), 1.0, m, m])
            while len(pools) > 1 and (pools[-2][3] == m or pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]):
                v1 = pools.pop()
                pools[-1] = [pools[-1][0] + v1[0], pools[-1][1] + v1[1], pools[-1][2], v1[3]]
        self.x = np.array([x for p in pools for x in p[2:]])
        self.y = np.maximum.accumulate(np.repeat([(p[0] + rate) / (p[1] + 1) for p in pools], 2))

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        return np.interp(margin, self.x, self.y) if len(self.x) else np.zeros(len(margin))


class Model:
    """Lexicon, trees and calibration.  x, y: features and labels of the sample, in hash order."""

    def __init__(self, lexicon: Lexicon, x: np.ndarray, y: np.ndarray):
        self.lexicon = lexicon
        self.trees = Boosted(x, y) if len(y) else None
        part = np.arange(len(y)) % FOLDS
        margin = np.zeros(len(y))
        for k in range(FOLDS if len(y) >= FOLDS else 0):
            margin[part == k] = Boosted(x[part != k], y[part != k]).margin(x[part == k])
        self.calibrated = Isotonic(margin, y) if len(y) else None

    def score(self, column: pa.Array) -> np.ndarray:
        x = features(column, self.lexicon)
        return np.clip(self.calibrated(self.trees.margin(x)), 0.0, 1.0) if self.trees else np.zeros(len(x))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", mod: int = 3, held: int = 1) -> Model:
    """Learn from at most about TRAIN_ROWS labelled rows, chosen by hash, whose crc32(key) mod ``mod`` is not ``held``.

    Null keys, labels and texts do not take part; a row with several labels counts as toxic if
    one says so.  Nothing to learn from: every score is 0.
    """
    said = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & (crc_mod(F.col(key), mod) != held)).groupBy(F.col(key).alias("key")).agg(F.max(label).alias("label"))
    n = said.count()
    slots = 1 << 30
    if n > TRAIN_ROWS:
        said = said.where(F.pmod(F.xxhash64("key"), F.lit(slots)) < F.lit(int(slots * TRAIN_ROWS / n)))
    said = F.broadcast(said)  # counted, then cut to about TRAIN_ROWS rows
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text")).join(said, "key")
    rows = stage_table(rows.select(F.xxhash64("key").alias("h"), F.xxhash64("text").alias("h2"), "text", (F.col("label") > 0).cast("int").alias("label")).repartition(SAMPLE_PARTS), "toxic-sample")
    counted = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    toxic, clean = counted.get(1, 0), counted.get(0, 0)

    def entries(batches):
        for batch in batches:
            for piece in sliced(batch, "text", 1 << 20):
                y = piece.column("label").to_numpy()
                for stem in (0, *STEMS):
                    row, found = _entries(piece.column("text"), stem)
                    names, which = np.unique(found, return_inverse=True)
                    bad = np.bincount(which, y[row], len(names)).astype(np.int64)
                    good = np.bincount(which, minlength=len(names)) - bad
                    yield pa.record_batch([pa.array(np.full(len(names), stem, np.int32)), pa.array(names.view(np.int64)), pa.array(bad), pa.array(good)], ["stem", "hash", "toxic", "clean"])

    often = rows.select("text", "label").mapInArrow(thrifty(entries), "stem int, hash long, toxic long, clean long").groupBy("stem", "hash").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # Entries that any of the three lexicons below could hold: bounded by the sample.
    lift = MIN_LIFT * (F.greatest(F.col("clean") - 1, F.lit(0)) + 0.5) / max(1, clean)
    found = [tuple(r) for r in often.where((F.col("toxic") >= MIN_TOXIC) & (F.col("toxic") / max(1, toxic - 1) >= lift * 0.9)).collect()]
    without = Shipped(docs.sparkSession, {k: Lexicon(found, toxic, clean, k) for k in (0, 1)})

    def measured(batches):
        for batch in batches:
            for piece in sliced(batch, "text", 1 << 20):
                y = piece.column("label").to_numpy()
                x = np.zeros((len(y), len(NAMES)))
                for k, lexicon in without.value.items():
                    at = np.flatnonzero(y == k)
                    x[at] = features(piece.column("text").take(pa.array(at)), lexicon)
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * len(NAMES)), pa.array(x.ravel()))
                yield pa.record_batch([piece.column("h"), piece.column("h2"), piece.column("label"), values], ["h", "h2", "label", "x"])

    # TRAIN_ROWS rows of len(NAMES) numbers.
    sample = sorted((r.h, r.h2, r.label, r.x) for r in rows.mapInArrow(thrifty(measured), "h long, h2 long, label int, x array<double>").collect())
    return Model(Lexicon(found, toxic, clean), np.array([r[3] for r in sample]).reshape(-1, len(NAMES)), np.array([r[2] for r in sample], np.float64))


def scored(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row by its whole text; null and empty texts are scored as empty."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    given = Shipped(docs.sparkSession, model)  # bounded by the training sample

    def score(batches):
        for batch in batches:
            for piece in sliced(batch, "text", 1 << 20):
                yield pa.record_batch([piece.column("key"), pa.array(given.value.score(piece.column("text")), pa.float64())], ["key", "score"])

    return rows.mapInArrow(thrifty(score), f"key {rows.schema['key'].dataType.simpleString()}, score double").withColumnRenamed("key", key)


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose score is under ``threshold``."""
    given = Shipped(docs.sparkSession, model)
    rows, named = boxed(docs)

    def keep(batches):
        for batch in batches:
            for piece in sliced(batch, named[text], 1 << 20):
                kept = piece.filter(pa.array(given.value.score(piece.column(named[text])) < threshold))
                if kept.num_rows:
                    yield kept

    return rows.mapInArrow(thrifty(keep), rows.schema).toDF(*docs.columns)
