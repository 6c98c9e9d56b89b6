"""Operator 8, quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from the UTF-8 bytes of whole texts, a batch at a time. The trees are fitted on a bounded sample of labelled
rows (SAMPLE, a parameter) with 64-bin histograms, and kept as flat arrays (feature, threshold, leaf value of complete
binary trees), which a batch descends level by level in numpy.

Nulls and edges: a null text is scored as the empty text; repeated rows get equal scores; with no usable label the score is
0.5, with one class alone its smoothed rate; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import arrow_udf

from weftwork.llm.common import doc_crc, raw, slices, word_hashes, words
from weftwork.llm.learning import labelled

#: Labelled rows that the trees are fitted on, at most.
SAMPLE = 20_000
BINS, TREES, DEPTH, RATE, SHRINK, LEAST = 64, 80, 4, 0.15, 1.0, 8.0
#: Scores from here on are accepted.
ACCEPT = 0.3

_CLASSES = ("upper", "lower", "digit", "blank", "line end", "stop", "mark", "lead", "tail")
_CLASS = np.full(256, 6, dtype=np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 0, 1, 2
_CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]], _CLASS[0x0A] = 3, 4
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 5
_CLASS[0xC0:], _CLASS[0x80:0xC0] = 7, 8


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many flags are set between each two neighbours of `at`."""
    return np.diff(np.r_[0, np.cumsum(flags, dtype=np.int64)][at])


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of statistics for each text."""
    data, at = raw(texts)
    begins, ends, first = words(data, at)
    kinds = _CLASS[data]
    counts = np.stack([_sums(kinds == k, at) for k in range(len(_CLASSES))], axis=1).astype(float)
    chars = np.maximum(counts.sum(axis=1) - counts[:, 8], 1)
    n = np.diff(first).astype(float)
    some = np.maximum(n, 1)
    hashes = word_hashes(data, begins, ends)
    out = [np.log1p(chars), *(counts[:, k] / chars for k in range(8)), np.log1p(n), chars / some]
    if len(begins):
        long = ends - begins
        ups = np.r_[0, np.cumsum(kinds == 0, dtype=np.int64)]
        again = np.r_[False, hashes[1:] == hashes[:-1]]
        again[first[:-1][n > 0]] = False  # the word before is another text's
        last = kinds[ends - 1]
        share = [again, kinds[begins] == 0, (ups[ends] - ups[begins] == long) & (long > 1), last == 5, last == 6, (long == 1) & (last == 6), long > 20]
        out += [_sums(x, first) / some for x in share]
    else:
        out += [np.zeros(len(n))] * 7
    tail = np.zeros((len(n), 4))
    pairs = hashes[1:] * np.uint64(0x9E3779B97F4A7C15) + hashes[:-1] if len(hashes) > 1 else hashes[:0]
    for i in range(len(n)):
        a, b = first[i], first[i + 1]
        if b > a:
            times = np.unique(hashes[a:b], return_counts=True)[1]
            tail[i, :2] = len(times) / (b - a), times.max() / (b - a)
        if b > a + 1:
            times = np.unique(pairs[a : b - 1], return_counts=True)[1]
            tail[i, 2:] = len(times) / (b - a - 1), times.max() / (b - a - 1)
    return np.column_stack([*out, tail]).astype(np.float32)


@arrow_udf(T.ArrayType(T.FloatType()))
def statistics_udf(texts: pa.Array) -> pa.Array:
    parts = [statistics(texts[a:b]) for a, b in slices(texts, 4 << 20)] or [statistics(texts)]
    x = np.concatenate(parts)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


@dataclass(frozen=True)
class Trees:
    """Complete binary trees: inner node i of a tree has the children 2i+1 (at most threshold) and 2i+2."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - (2**DEPTH - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees under the logistic loss. Each level's histograms are two bincounts a feature over (node, bin)."""
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    rate = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(rate / (1 - rate)))
    features, thresholds, values = [], [], []
    if 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS)) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
        margin = np.full(len(y), base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            feature, threshold = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf, dtype=np.float32)
            node = np.zeros(len(y), dtype=np.int64)
            for level in range(DEPTH):
                width, start = 2**level, 2**level - 1
                gain, split, place = np.full(width, 1e-6), np.zeros(width, dtype=np.int64), np.full(width, -1)
                for f, c in enumerate(cuts):
                    at = (node - start) * BINS + binned[:, f]
                    gs = np.bincount(at, g, width * BINS).reshape(width, BINS).cumsum(axis=1)
                    hs = np.bincount(at, h, width * BINS).reshape(width, BINS).cumsum(axis=1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    with np.errstate(all="ignore"):
                        new = gs**2 / (hs + SHRINK) + (gt - gs) ** 2 / (ht - hs + SHRINK) - gt**2 / (ht + SHRINK)
                    new[(hs < LEAST / 4) | (ht - hs < LEAST / 4)] = 0
                    new[:, len(c) :] = 0
                    best = new.argmax(axis=1)
                    better = new[np.arange(width), best] > gain
                    gain[better], split[better], place[better] = new[np.arange(width), best][better], f, best[better]
                for k in np.flatnonzero(place >= 0):
                    feature[start + k], threshold[start + k] = split[k], cuts[split[k]][place[k]]
                node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
            leaf = node - inner
            value = -RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + SHRINK)
            margin += value[leaf]
            features.append(feature), thresholds.append(threshold), values.append(value)
    return Trees(base, np.array(features).reshape(-1, inner).astype(np.int64), np.array(thresholds).reshape(-1, inner), np.array(values).reshape(-1, leaves))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees from the labelled rows that may teach: those whose crc32(doc_id as text) mod 5 is not 0."""
    known = labelled(docs, labels, "quality", doc_crc(F.col("doc_id")) % 5 != 0, sample)
    rows = known.select("doc_id", "y", statistics_udf("text").alias("x")).groupBy("doc_id").agg(F.min(F.struct("y", "x")).alias("r"))
    table = rows.orderBy("doc_id").select("r.y", "r.x").toArrow()
    x = np.asarray(table["x"].combine_chunks().flatten(), dtype=np.float32)
    return fit(x.reshape(len(table), -1 if len(table) else 1), np.asarray(table["y"], dtype=float))


def score_udf(trees: Trees):
    @arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        parts = [trees.score(statistics(texts[a:b])) for a, b in slices(texts, 4 << 20)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return score


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out (no label of it was learned), score (0 to 1, higher: better), predicted."""
    score = score_udf(train(docs, labels, sample))
    out = docs.select("doc_id", (doc_crc(F.col("doc_id")) % 5 == 0).alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, unchanged, whose score is at least ACCEPT."""
    score = score_udf(train(docs, labels, sample))
    return docs.filter(score("text") >= ACCEPT)
