"""Language identification by prediction by partial matching.

Each language has context trees of bytes: for a context of up to ORDER bytes the
counts of the next byte.  A byte's code length is that of the escapes from longer
contexts in which it was never seen (method C, with exclusion of the bytes seen
there) and of the byte itself; order -1 is uniform.  The statistics are frozen, so
a byte's cost depends on its last ORDER bytes only.  A context never reaches back
over white space: every word is coded after a space and ends with one.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoline.llm.common import LOWER, NON_SPACE, Shipped, crc_mod, hash_spans, ragged, sliced, stage_table, text_bytes, word_spans

ORDER = 4
#: Bound of the training sample: rows of a language, each with its whole text.
TRAIN_ROWS = 300
#: Languages that are scored together, and costs that are kept for them; both bound a worker's memory.
BLOCK, MEMO = 16, 1_600_000


class ContextTree:
    """Counts of the next byte after every context of up to ORDER bytes, in arrays.

    The contexts' numbers are sorted; ``at`` says where the bytes and counts of each begin.
    """

    def __init__(self, texts: list[str]):
        counts: dict[bytes, dict[int, int]] = {}
        low = bytes(LOWER.tolist())
        for text in texts:
            for word in text.encode().translate(low).split():
                coded = b" " + word + b" "
                for i in range(1, len(coded)):
                    for k in range(min(ORDER, i) + 1):
                        found = counts.setdefault(coded[i - k : i], {})
                        found[coded[i]] = found.get(coded[i], 0) + 1
        order = sorted(counts, key=_number)
        self.contexts = np.array([_number(c) for c in order], np.int64)
        self.at = np.cumsum([0, *(len(counts[c]) for c in order)]).astype(np.int32)
        self.bytes = bytes(b for c in order for b in counts[c])
        self.counts = np.array([n for c in order for n in counts[c].values()], np.int32)

    def _found(self, context: bytes) -> dict[int, int]:
        number = _number(context)
        i = int(self.contexts.searchsorted(number))
        if i == len(self.contexts) or self.contexts[i] != number:
            return {}
        a, b = self.at[i], self.at[i + 1]
        return dict(zip(self.bytes[a:b], self.counts[a:b].tolist()))

    def cost(self, context: bytes, byte: int) -> float:
        """Code length of a byte after a context, in nats."""
        out, gone = 0.0, set()
        for k in range(len(context), -1, -1):
            found = self._found(context[len(context) - k :])
            if not found:
                continue
            left = {b: n for b, n in found.items() if b not in gone}
            if not left:
                continue
            total = sum(left.values()) + len(left)
            if byte in left:
                return out - math.log(left[byte] / total)
            out -= math.log(len(left) / total)
            gone |= left.keys()
        return out + math.log(256 - len(gone))


def _number(context: bytes) -> int:
    """One number for each context, of any length up to that of seven bytes."""
    return int.from_bytes(b"\1" + context, "big")


class Model:
    def __init__(self, trees: dict[str, ContextTree]):
        self.names = sorted(trees)
        self.trees = [trees[k] for k in self.names]
        self.memo: dict[tuple[int, int], list[float]] = {}

    def _gram(self, packed: int, lo: int, hi: int) -> list[float]:
        if (found := self.memo.get((lo, packed))) is None:
            if len(self.memo) * (hi - lo) > MEMO:
                self.memo.clear()
            gram = (packed >> 8).to_bytes(ORDER + 1, "big")[ORDER + 1 - (packed & 255) :]
            found = self.memo[lo, packed] = [t.cost(gram[:-1], gram[-1]) for t in self.trees[lo:hi]]
        return found

    def words(self, raw: np.ndarray, starts: np.ndarray, stops: np.ndarray, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Code lengths of words, a row each and a column for each language from ``lo`` to before ``hi``."""
        hi = len(self.names) if hi is None else hi
        size = stops - starts + 2  # with the space before and after
        ends = np.cumsum(size)
        coded = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
        coded[ragged(ends - size + 1, size - 2)] = raw[ragged(starts, size - 2)]
        place = np.arange(len(coded)) - np.repeat(ends - size, size)
        packed = np.zeros(len(coded), np.uint64)
        for k in range(ORDER, -1, -1):
            shifted = np.zeros(len(coded), np.uint64)
            shifted[k:] = coded[: len(coded) - k] if k else coded
            packed = packed << np.uint64(8) | np.where(place >= k, shifted, np.uint64(0))
        packed = packed << np.uint64(8) | np.minimum(place + 1, ORDER + 1).astype(np.uint64)
        kept = place > 0
        grams, which = np.unique(packed[kept], return_inverse=True)
        costs = np.array([self._gram(g, lo, hi) for g in grams.tolist()], np.float64).reshape(len(grams), hi - lo)
        at = ends - size - np.arange(len(ends))
        return np.add.reduceat(costs[which], at, axis=0) if len(ends) else np.zeros((0, hi - lo))


def train(docs: DataFrame, label: str = "lang", text: str = "text", key: str = "doc_id") -> Model:
    """Learn a context tree for every label from at most TRAIN_ROWS rows of it (hash order of key and text)."""
    rows = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).alias("label"), F.col(text).alias("text"), F.xxhash64(F.col(key)).alias("hash"))
    counts = stage_table(rows.groupBy("label").agg(F.count("*").alias("n")), "labels")
    # A hash threshold for each label keeps about twice the rows wanted; the rest is cut off in hash order.
    slots = 1 << 30
    near = rows.join(F.broadcast(counts), "label").where(F.pmod("hash", F.lit(slots)) < F.least(F.lit(slots), F.ceil(F.lit(slots * 2 * TRAIN_ROWS) / F.col("n"))))  # a row a label
    sample = near.select("label", "hash", "text").withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy("hash", "text"))).where(F.col("place") <= TRAIN_ROWS)

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"label": [pdf["label"].iloc[0]], "tree": [pickle.dumps(vars(ContextTree(pdf["text"].tolist())))]})

    trees: dict[str, ContextTree] = {}
    for r in stage_table(sample.groupBy("label").applyInPandas(learn, "label string, tree binary"), "trees").toLocalIterator():
        trees[r.label] = ContextTree.__new__(ContextTree)
        vars(trees[r.label]).update(pickle.loads(r.tree))
    return Model(trees)


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of every row by the whole text's code lengths.

    score: the best language's share when each code length counts as a probability.  Ties go
    to the smallest name.  ``und`` with score 0 where the text is null or has no letter, or
    nothing was learned.  Rows are taken one by one; other columns are ignored.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    given = Shipped(docs.sparkSession, model)  # bounded by the training sample, a few MB a language

    def score(batches):
        model = given.value
        for batch in batches:
            for piece in sliced(batch, "text", 1 << 20):
                raw, at = text_bytes(piece.column("text"))
                low = LOWER[raw]
                starts, stops, first = word_spans(low, at, NON_SPACE)
                names, values = ["und"] * piece.num_rows, [0.0] * piece.num_rows
                if model.names:
                    _, one, which = np.unique(hash_spans(low, starts, stops), return_index=True, return_inverse=True)
                    parts = []
                    for lo in range(0, len(model.names), BLOCK):
                        hi = min(lo + BLOCK, len(model.names))
                        costs = model.words(low, starts[one], stops[one], lo, hi)
                        part = np.concatenate([np.zeros((1, hi - lo)), np.cumsum(costs[which], axis=0)])
                        parts.append(part[first[1:]] - part[first[:-1]])
                    total = np.concatenate(parts, axis=1)
                    for i, t in enumerate(piece.column("text").to_pylist()):
                        if t and any(map(str.isalpha, t)):
                            best = int(np.argmin(total[i]))
                            names[i] = model.names[best]
                            values[i] = float(1 / np.exp(np.maximum(total[i, best] - total[i], -700)).sum())
                yield pa.record_batch([piece.column("key"), pa.array(names, pa.string()), pa.array(values, pa.float64())], ["key", "lang_pred", "score"])

    return rows.mapInArrow(score, f"key {rows.schema['key'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("key", key)


def held_out(key: str = "doc_id"):
    return crc_mod(F.col(key), 4) == 2
