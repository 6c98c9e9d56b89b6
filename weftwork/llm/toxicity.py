"""Operator 1, toxicity: nearest labelled examples by exact TF-IDF cosine over a block-max inverted index.

The index holds a bounded sample of labelled documents (SAMPLE) with all their terms (runs of letters, A-Z lowered).
A term weighs its inverse document frequency over the whole corpus, times how much it tells the classes apart
in the sample (between TELL and 1, by log-likelihood ratio); a term that no example holds counts in a text's length as if one
document held it. Examples lie in blocks of BLOCK, and each term keeps its sorted postings and the greatest weight of each
block that it occurs in. A query opens blocks by falling upper bound and stops when none can reach its K-th cosine, so the K
nearest are exact. They vote weighted by their cosine, and the vote is calibrated by isotonic regression over the examples
themselves, each left out of its own neighbours.

Nulls and edges: a null text is scored as the empty text; a text that shares no term with any example gets the smoothed rate
of all examples; equal cosines are taken by place in the index; with no usable label the score is 0; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import arrow_udf

from weftwork.llm.common import LETTERS, doc_crc, mix, ranges, raw, slices, word_hashes, words, written
from weftwork.llm.learning import labelled

#: Labelled rows in the index, neighbours that vote, examples to a posting block.
SAMPLE, K, BLOCK = 8_000, 15, 128
#: Terms of all examples together, at most: with longer texts there are fewer examples.
POSTINGS = 6_000_000
#: A term that one in so many examples holds has all its postings in one dense row.
COMMON = 24
#: Scores from here on are predicted toxic.
TOXIC = 0.3
#: Share of its weight that a term keeps which tells nothing, and the log-likelihood ratio at which it keeps half.
TELL, HALF = 0.01, 30.0
_BITS = np.uint64(44)


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, times), sorted by text and term: hashes of 44 bits of all terms of up to a million texts."""
    data, at = raw(texts)
    begins, ends, first = words(data, at, LETTERS)
    if not len(begins):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    owner = np.searchsorted(first, np.arange(len(begins)), side="right") - 1
    both = owner.astype(np.uint64) << _BITS | word_hashes(data, begins, ends) >> (np.uint64(64) - _BITS)
    both.sort()
    new = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
    return (both[new] >> _BITS).astype(np.int64), both[new] & ((np.uint64(1) << _BITS) - np.uint64(1)), np.diff(np.r_[new, len(both)])


@arrow_udf(T.StructType([T.StructField("terms", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.LongType())), T.StructField("least", T.ArrayType(T.LongType()))]))
def terms_udf(texts: pa.Array) -> pa.Array:
    """The terms of a text with their times, and two least hashes of its runs of three words (near copies mostly share them)."""
    at, keys, times, least = [np.zeros(1, np.int64)], [], [], []
    for a, b in slices(texts, 4 << 20):
        text, key, n = terms(texts[a:b])
        keys.append(key), times.append(n), at.append(np.searchsorted(text, np.arange(1, b - a + 1)) + at[-1][-1])
        data, where = raw(texts[a:b])
        begins, ends, first = words(data, where, LETTERS)
        w = word_hashes(data, begins, ends)
        for i in range(b - a):
            own = w[first[i] : first[i + 1]]
            runs = own[:-2] * np.uint64(3) + own[1:-1] * np.uint64(5) + own[2:] if len(own) > 2 else own.sum(keepdims=True)
            least += [int(mix(runs ^ np.uint64(k)).min().astype(np.int64)) for k in (0, 1)]
    offsets = pa.array(np.concatenate(at).astype(np.int32))
    flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, times)]
    pairs = pa.array(np.arange(0, len(least) + 1, 2, dtype=np.int32))
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(flat[0].astype(np.uint64).view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(flat[1].astype(np.int64))), pa.ListArray.from_arrays(pairs, pa.array(least, pa.int64()))], ["terms", "times", "least"])


@dataclass
class Index:
    """Postings of unit vectors by term and block.

    keys: the terms' hashes, rising, and weight, what one occurrence of each weighs. Term t has the postings from first[t] to
    first[t + 1], an example's place and its weight each. All else is made of these where it is used: entry e of a rare term
    stands for one block, its number block[e], its greatest weight most[e] and its postings from start[e] to start[e + 1];
    term t has the entries from entry[t] to entry[t + 1]. A common term has a row instead, row[t] in dense (-1 for none): the
    common terms' part of all cosines is one product, and its greatest value in a block is part of the block's bound.
    """

    keys: np.ndarray
    weight: np.ndarray
    rare: float
    ids: np.ndarray
    labels: np.ndarray
    first: np.ndarray
    place: np.ndarray
    value: np.ndarray
    votes: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))
    rates: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))
    row: np.ndarray | None = None

    @staticmethod
    def of(keys: np.ndarray, weight: np.ndarray, rare: float, ids: np.ndarray, labels: np.ndarray, example: np.ndarray, term: np.ndarray, value: np.ndarray) -> Index:
        """The index of postings (example, term, value)."""
        order = np.lexsort((example, term))
        first = np.searchsorted(term[order], np.arange(len(keys) + 1)).astype(np.int32)
        return Index(keys, weight.astype(np.float32), rare, ids, labels, first, example[order].astype(np.int32), value[order].astype(np.float32))

    def __getstate__(self) -> dict:
        made = ("entry", "block", "most", "start", "dense", "places", "values")
        return {k: v for k, v in self.__dict__.items() if k not in made} | {"row": None}

    def ready(self) -> None:
        """Entries and dense rows, once a Python worker."""
        if self.row is not None:
            return
        held, width = np.diff(self.first), -(-max(len(self.ids), 1) // BLOCK) * BLOCK
        often = np.flatnonzero(held * COMMON >= max(len(self.ids), 1))
        term = np.repeat(np.arange(len(self.keys)), held)
        row = np.full(len(self.keys), -1)
        row[often] = np.arange(len(often))
        common = row[term] >= 0
        self.dense = np.zeros((len(often), width), dtype=np.float32)
        self.dense[row[term[common]], self.place[common]] = self.value[common]
        term, self.places, self.values = term[~common], self.place[~common], self.value[~common]
        block = self.places // BLOCK
        new = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])]) if len(term) else np.zeros(0, np.int64)
        self.most = np.maximum.reduceat(self.values, new) if len(new) else np.zeros(0)
        self.entry, self.block, self.start = np.searchsorted(term[new], np.arange(len(self.keys) + 1)), block[new], np.r_[new, len(term)]
        self.row = row

    @property
    def prior(self) -> float:
        return float((self.labels.sum() + 0.5) / (len(self.labels) + 1)) if len(self.labels) else 0.0

    def vectors(self, text: np.ndarray, key: np.ndarray, times: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(text, terms, weights) of each text that holds a term; its whole vector has unit length."""
        if not len(self.keys) or not len(text):
            return
        term = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = self.keys[term] == key
        value = (1 + np.log(times)) * np.where(known, self.weight[term], self.rare)
        starts = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
        value = value.astype(float)
        length = np.sqrt(np.add.reduceat(value**2, starts))
        for a, b, size in zip(starts, [*starts[1:], len(text)], length):
            hit = a + np.flatnonzero(known[a:b])
            if len(hit):
                yield int(text[a]), term[hit], value[hit] / size

    def nearest(self, which: np.ndarray, weights: np.ndarray, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The K examples of greatest cosine over 0 and their cosines, by falling cosine, then place."""
        self.ready()
        rows = self.row[which]
        base = weights[rows >= 0].astype(np.float32) @ self.dense[rows[rows >= 0]]
        if without >= 0:
            base[without] = -np.inf
        which, weights = which[rows < 0], weights[rows < 0]
        entries = ranges(self.entry[which], self.entry[which + 1])
        share = np.repeat(weights, self.entry[which + 1] - self.entry[which])
        block = self.block[entries]
        bounds = base.reshape(-1, BLOCK).max(axis=1) + np.bincount(block, share * self.most[entries], len(base) // BLOCK)
        order = np.argsort(-bounds, kind="stable")
        best, cosines, floor = np.zeros(0, np.int64), np.zeros(0), 1e-6
        at, step = 0, 4
        while at < len(order):
            open_ = order[at : at + step]
            open_ = open_[(bounds[open_] > 0) & (bounds[open_] >= floor - 1e-6)]
            if not len(open_):
                break
            mine = np.zeros(len(bounds), dtype=bool)
            mine[open_] = True
            some = mine[block]
            few = entries[some]
            begin, end = self.start[few], self.start[few + 1]
            postings = ranges(begin, end)
            sums = base + np.bincount(self.places[postings], np.repeat(share[some], end - begin) * self.values[postings], len(base))
            sums = np.round(sums, 6)
            keep = np.flatnonzero((sums >= floor) & np.repeat(mine, BLOCK))
            best, cosines = np.concatenate([best, keep]), np.concatenate([cosines, sums[keep]])
            if len(best) > K:
                high = np.flatnonzero(cosines >= np.partition(cosines, len(cosines) - K)[len(cosines) - K])
                best, cosines = best[high], cosines[high]
            top = np.lexsort((best, -cosines))[:K]
            best, cosines = best[top], cosines[top]
            floor = max(floor, cosines[-1]) if len(best) == K else floor
            at, step = at + step, len(order)
        return best, cosines

    def vote(self, best: np.ndarray, cosines: np.ndarray) -> float:
        """Share of toxic neighbours weighted by cosine, drawn to the prior by half the vote of the nearest."""
        if not len(best):
            return self.prior
        pull = 0.5 * cosines[0]
        return float((cosines @ self.labels[best] + pull * self.prior) / (cosines.sum() + pull))

    def calibrated(self, votes: np.ndarray) -> np.ndarray:
        return np.interp(votes, self.votes, self.rates)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y on x (pool adjacent violators), each pool's rate smoothed by half a row of each class."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for at, value in zip(x[order], y[order]):
        pools.append([at, at, value, 1.0])
        while len(pools) > 1 and (pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3] or pools[-2][1] == pools[-1][0]):
            low, _, s, n = pools.pop(-2)
            pools[-1] = [low, pools[-1][1], s + pools[-1][2], n + pools[-1][3]]
    knots = [(edge, (s + 0.5) / (n + 1)) for low, high, s, n in pools for edge in dict.fromkeys((low, high))]
    return np.array([k for k, _ in knots]), np.maximum.accumulate(np.array([r for _, r in knots]))


def document_counts(docs: DataFrame, keys: np.ndarray) -> tuple[int, np.ndarray]:
    """How many documents there are and how many hold each term, over all of docs. Each task sums its own first."""
    sent = docs.sparkSession.sparkContext.broadcast(keys)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = sent.value
        held, n = np.zeros(len(keys) + 1, dtype=np.int64), 0
        for batch in batches:
            for a, b in slices(batch.column(0), 4 << 20):
                key = terms(batch.column(0)[a:b])[1]
                place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                held[:-1] += np.bincount(place[keys[place] == key], minlength=len(keys)) if len(keys) else 0
            n += batch.num_rows
        held[-1] = n
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(held[some])], ["term", "n"])

    rows = docs.select("text").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    sent.destroy()
    out = np.zeros(len(keys) + 1, dtype=np.int64)
    out[np.asarray(rows["term"])] = np.asarray(rows["n"])
    return int(out[-1]), out[:-1]


def ratio(held: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The log-likelihood ratio of each term: held (class, term) documents of n (class) hold it."""
    both, total = held.sum(axis=0), n.sum()
    out = np.zeros(held.shape[1])
    for k in (0, 1):
        for seen, whole in ((held[k], both), (n[k] - held[k], total - both)):
            with np.errstate(divide="ignore", invalid="ignore"):
                out += np.where(seen > 0, 2 * seen * np.log(seen * total / (n[k] * whole)), 0)
    return out


def within(rows: DataFrame, postings: int = 0) -> DataFrame:
    """The examples (doc_id, terms...) that come first by a hash until they have POSTINGS terms: a bound on what the driver and the
    workers hold, whatever the texts' length. At most SAMPLE rows are put in order, by id and size alone."""
    sizes = rows.select("doc_id", F.size("terms").alias("n"))
    if (sizes.agg(F.sum("n")).first()[0] or 0) <= (postings or POSTINGS):
        return rows
    upto = F.sum("n").over(Window.orderBy(F.xxhash64("doc_id", F.lit("toxic")), "doc_id"))
    return rows.join(sizes.withColumn("upto", upto).filter(F.col("upto") <= (postings or POSTINGS)).select("doc_id"), "doc_id")


def build(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Index:
    """The index over labelled rows that may teach: those whose crc32(doc_id as text) mod 4 is not 2."""
    known = labelled(docs, labels, "toxic", doc_crc(F.col("doc_id")) % 4 != 2, sample)
    rows = known.select("doc_id", "y", terms_udf("text").alias("t")).select("doc_id", "y", "t.*")
    # A doc_id that repeats is one example, so the examples are at most `sample`.
    rows = within(written(rows.groupBy("doc_id").agg(F.min(F.struct("y", "terms", "times", "least")).alias("r")).select("doc_id", "r.*"), "toxicity-sample"))
    got = rows.orderBy("doc_id").toArrow()
    ids, y = np.asarray(got["doc_id"], dtype=np.int64), np.asarray(got["y"], dtype=np.int64)
    flat = [np.asarray(got[c].combine_chunks().flatten()) if len(got) else np.zeros(0, np.int64) for c in ("terms", "times")]
    size = np.array([len(x) for x in got["terms"]], dtype=np.int64)
    keys, term = np.unique(flat[0].view(np.uint64), return_inverse=True)
    example = np.repeat(np.arange(len(ids)), size)
    total, held = document_counts(docs, keys)
    idf = np.log((total + 1) / (held + 1)) + 1
    # Near copies would else vouch for their chance words many times: of those that share a least hash one counts.
    once = np.ones(len(ids), dtype=bool)
    least = np.asarray(got["least"].combine_chunks().flatten()).reshape(-1, 2) if len(got) else np.zeros((0, 2), np.int64)
    for k in (0, 1):
        at = np.flatnonzero(once)
        once[:] = False
        once[at[np.unique(least[at, k], return_index=True)[1]]] = True
    mine = once[example]
    counts = np.stack([np.bincount(term[mine & (y[example] == k)], minlength=len(keys)) for k in (0, 1)]).astype(float)
    apart = (ratio(counts, np.array([(once & (y == k)).sum() for k in (0, 1)], dtype=float)) / HALF) ** 2
    weight = idf * (TELL + (1 - TELL) * apart / (1 + apart))
    value = (1 + np.log(flat[1])) * weight[term] if len(term) else np.zeros(0)
    value = value / np.sqrt(np.bincount(example, value**2, len(ids)))[example]
    # Examples that share their weightiest term lie together, so the bounds of a block are tight.
    heaviest = np.full(len(ids), -1)
    order = np.lexsort((value, example))
    heaviest[example[order]] = term[order]
    place = np.empty(len(ids), dtype=np.int64)
    by = np.lexsort((ids, heaviest))
    place[by] = np.arange(len(ids))
    out = Index.of(keys, weight, (np.log((total + 1) / 2) + 1) * TELL, ids[by], y[by].astype(float), place[example], term, value)
    if len(ids):
        sent = _broadcast(docs, out)

        def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = sent.value
            where = {i: p for p, i in enumerate(index.ids.tolist())}
            for batch in batches:
                owner = np.repeat(np.arange(batch.num_rows), np.asarray(pa.compute.list_value_length(batch.column(1))))
                votes = np.full(batch.num_rows, index.prior)
                for i, t, w in index.vectors(owner, np.asarray(batch.column(1).flatten()).view(np.uint64), np.asarray(batch.column(2).flatten())):
                    votes[i] = index.vote(*index.nearest(t, w, where[batch.column(0)[i].as_py()]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(votes)], ["doc_id", "vote"])

        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        got = rows.select("doc_id", "terms", "times").repartition(parts, "doc_id").mapInArrow(left_out, "doc_id long, vote double").orderBy("doc_id").toArrow()
        sent.destroy()
        out.votes, out.rates = isotonic(np.asarray(got["vote"]), y.astype(float))
    return out


def score_udf(docs: DataFrame, index: Index, evidence: int = 3):
    """Column function text -> struct(score, evidence: doc_ids of the nearest examples). Equal texts of a batch are scored once."""
    sent = _broadcast(docs, index)

    @arrow_udf(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("evidence", T.ArrayType(T.LongType()))]))
    def score(texts: pa.Array) -> pa.Array:
        index = sent.value
        known = pa.compute.dictionary_encode(pa.compute.fill_null(texts, ""))
        distinct = known.dictionary
        votes = np.full(len(distinct), np.nan)
        near: list[list[int]] = [[] for _ in range(len(distinct))]
        for a, b in slices(distinct, 1 << 20):
            for i, which, weights in index.vectors(*terms(distinct[a:b])):
                best, cosines = index.nearest(which, weights)
                votes[a + i], near[a + i] = index.vote(best, cosines), index.ids[best[:evidence]].tolist()
        scores = np.where(np.isnan(votes), index.prior, index.calibrated(np.nan_to_num(votes)))
        out = pa.StructArray.from_arrays([pa.array(scores), pa.array(near, pa.list_(pa.int64()))], ["score", "evidence"])
        return out.take(known.indices)

    return score


def _broadcast(docs: DataFrame, index: Index):
    """Bounded by POSTINGS: eight bytes for each term of an example, and sixteen for each distinct one."""
    return docs.sparkSession.sparkContext.broadcast(index)


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out (no label of it was learned), score, predicted, evidence (nearest examples)."""
    found = score_udf(docs, build(docs, labels, sample))
    out = docs.select("doc_id", (doc_crc(F.col("doc_id")) % 4 == 2).alias("held_out"), found("text").alias("f"))
    return out.select("doc_id", "held_out", "f.score", (F.col("f.score") >= TOXIC).cast("int").alias("predicted"), "f.evidence")
