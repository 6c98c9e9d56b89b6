"""Operator 11, hard-negative mining: exact top-k search in windows of scores, over buckets of candidates sorted by norm.

Every row is a candidate; anchors are a stated query set. Anchors are cut into blocks of about BLOCK, candidates into bands by a
hash of the row; each block meets each band in one cell, whose candidates arrive sorted by falling norm and are taken BUCKET at
a time. No score of a bucket exceeds (anchor's norm) * (greatest norm of the bucket), so a bucket is left out for an anchor once
that lies under the lower limit of each of its windows and under the kth score found so far (equal ones stay: ties go by id);
once it does for all anchors, so do all later buckets, and the rest of the cell is passed over. A cell holds one block, one
bucket and k rows a window; it gives k rows a window, and the best of all bands are picked after a shuffle by anchor.

Components become floor(256 * x). Scores are exact: products are summed in floats only where no sum can leave the integers
that these hold, else in Python integers; a score over 64 bits is an error.

Nulls and edges: rows with a null label, a null vector or a null or non-finite component take no part. Every row counts for
itself: a repeated anchor gives its rows again, and its twin is one of its positives. A null vec_id is no anchor, not divisible by 7
and last in ties. Vectors of unequal lengths are compared as if the shorter went on with zeros; an empty one scores 0. Negative
positive scores have no window, as half of one is more than 0.95 of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftwork.llm.common import written

#: Anchors a block, anchors that share one product of matrices, candidates a bucket.
BLOCK, TILE, BUCKET = 8192, 256, 4096
#: The id that stands for null within a cell: last in ties.
NO_ID = np.iinfo(np.int64).max


def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over (vec_id, label, embedding): (vec_id, label, v, wide, norm) of the rows that take part."""
    for batch in batches:
        batch = batch.filter(pa.compute.and_(batch.column(1).is_valid(), batch.column(2).is_valid()))
        lists = batch.column(2)
        sizes = np.asarray(pa.compute.list_value_length(lists), dtype=np.int64)
        values = lists.flatten()
        x = np.asarray(values.cast(pa.float64()).fill_null(np.nan), dtype=np.float64)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        with np.errstate(over="ignore"):
            q = np.floor(256 * x)
        bad = np.bincount(owner[~np.isfinite(x)], minlength=len(sizes)) > 0
        wide = np.bincount(owner[~(np.abs(q) <= 32767)], minlength=len(sizes)) > 0
        with np.errstate(invalid="ignore", over="ignore"):
            norm = np.sqrt(np.bincount(owner, q * q, minlength=len(sizes)))
        at = np.r_[0, np.cumsum(sizes)]
        good = np.flatnonzero(~bad)
        v = [q[at[i] : at[i + 1]].astype("<f8" if wide[i] else "<i2").tobytes() for i in good]
        ids, labels = (batch.column(k).cast(pa.int64()).take(pa.array(good)) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([ids, labels, pa.array(v, pa.binary()), pa.array(wide[good]), pa.array(norm[good])], ["vec_id", "label", "v", "wide", "norm"])


def vectors(embeddings: DataFrame) -> DataFrame:
    """uid, vec_id, label, v, wide, norm of the rows that take part, written: a uid stays with its row."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), moved.alias("label"), "embedding")
    rows = rows.mapInArrow(quantise, "vec_id long, label long, v binary, wide boolean, norm double")
    return written(rows.withColumn("uid", F.monotonically_increasing_id()), "negatives-vectors")


def _matrix(v: pa.Array, wide: np.ndarray) -> np.ndarray:
    rows = [np.frombuffer(b, dtype="<f8" if w else "<i2").astype(np.float64) for b, w in zip(v.to_pylist(), wide)]
    out = np.zeros((len(rows), max(map(len, rows), default=0)))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def products(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of whole-numbered rows, exact, in the narrowest type that can hold every partial sum."""
    d = min(a.shape[1], c.shape[1])
    a, c = a[:, :d], c[:, :d]
    most = d * float(np.abs(a).max(initial=0)) * float(np.abs(c).max(initial=0))
    if most < 1 << 24:
        return a.astype(np.float32) @ c.T.astype(np.float32)
    if most < 1 << 53:
        return a @ c.T
    whole = np.vectorize(int, otypes=[object])
    return whole(a).dot(whole(c).T)


class _Cell:
    """One block of anchors and the best that it has found."""

    def __init__(self, anchors: pa.RecordBatch, k: int, same: bool):
        self.k, self.same = k, same
        self.uid, self.label, self.norm = (np.asarray(anchors.column(n)) for n in ("uid", "label", "norm"))
        self.rows = _matrix(anchors.column("v"), np.asarray(anchors.column("wide")))
        windows = anchors.column("windows").to_pylist()
        n, w = len(windows), max(map(len, windows))
        self.low, self.high, self.of = np.full((n, w), np.inf), np.full((n, w), -np.inf), np.zeros((n, w), np.int64)
        self.exact = np.full((n, w, 2), None, dtype=object)  # the limits as whole numbers, for scores that no float holds
        for i, ws in enumerate(windows):
            for j, x in enumerate(ws):
                low, high = x["low"], x["high"]
                self.low[i, j], self.high[i, j], self.of[i, j] = -np.inf if low is None else low, np.inf if high is None else high, x["of"]
                self.exact[i, j] = (self.low[i, j] if low is None else low, self.high[i, j] if high is None else high)
        self.kth = np.nextafter(self.low, -np.inf)
        self.best = [[np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)] for _ in range(w)]  # anchor, score, id

    def take(self, c: pa.RecordBatch) -> bool:
        """Scores one bucket; whether any anchor could still gain by it."""
        norm = np.asarray(c.column("norm"))
        open_ = (self.norm * norm[0] * (1 + 1e-9) + 0.5)[:, None] >= self.kth
        rows = np.flatnonzero(open_.any(axis=1))
        if not len(rows):
            return False
        values = _matrix(c.column("v"), np.asarray(c.column("wide")))
        label, uid, ids = (np.asarray(c.column(n)) for n in ("label", "uid", "id"))
        for t in range(0, len(rows), TILE):
            mine = rows[t : t + TILE]
            s = products(self.rows[mine], values)
            hit = (s >= np.where(open_[mine], self.kth[mine], np.inf).min(axis=1)[:, None]).astype(bool)
            hit &= (label[None, :] == self.label[mine][:, None]) == self.same
            if self.same:
                hit &= uid[None, :] != self.uid[mine][:, None]
            i, j = np.nonzero(hit)
            score, i = s[i, j], mine[i]
            for w, held in enumerate(self.best):
                low, high = (self.exact[i, w, 0], self.exact[i, w, 1]) if score.dtype == object else (self.low[i, w], self.high[i, w])
                has = np.isfinite(self.high[i, w]) | (self.high[i, w] > 0)
                in_ = has & (score >= self.kth[i, w])
                in_[in_] = ((score[in_] >= low[in_]) & (score[in_] <= high[in_])).astype(bool)
                if in_.any():
                    self._merge(w, held, i[in_], score[in_], ids[j[in_]])
        return True

    def _merge(self, w: int, held: list[np.ndarray], i: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        touched = np.isin(held[0], i)
        anchor = np.concatenate([held[0][touched], i])
        score = np.concatenate([held[1][touched], score])
        ids = np.concatenate([held[2][touched], ids])
        order = np.lexsort((ids, -score, anchor))
        anchor, score, ids = anchor[order], score[order], ids[order]
        first = np.r_[0, np.flatnonzero(anchor[1:] != anchor[:-1]) + 1]
        place = np.arange(len(anchor)) - np.repeat(first, np.diff(np.r_[first, len(anchor)]))
        full = place == self.k - 1
        self.kth[anchor[full], w] = np.nextafter(score[full].astype(np.float64), -np.inf)
        stay = place < self.k
        held[:] = [np.concatenate([h[~touched], x[stay]]) for h, x in zip(held, (anchor, score, ids))]

    def found(self) -> Iterator[pa.RecordBatch]:
        for w, (i, score, ids) in enumerate(self.best):
            if len(i):
                scores = pa.array([int(x) for x in score], pa.int64())
                found = pa.array(ids, pa.int64(), mask=ids == NO_ID)
                yield pa.RecordBatch.from_arrays([pa.array(self.uid[i]), pa.array(self.of[i, w]), found, scores], ["uid", "of", "found_id", "score"])


def search_cells(k: int, same: bool):
    """mapInArrow over rows sorted by (cell, kind, falling norm): the best k rows a window of each anchor in each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, waiting, rows, block, done = None, [], 0, None, False

        def bucket() -> pa.RecordBatch:
            return pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]

        def close():
            if block is not None:
                if waiting and not done:
                    block.take(bucket())
                yield from block.found()

        for batch in batches:
            at, kinds = np.asarray(batch.column("cell")), np.asarray(batch.column("kind"))
            cuts = np.r_[0, np.flatnonzero((at[1:] != at[:-1]) | (kinds[1:] != kinds[:-1])) + 1, len(at)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if at[a] != cell:
                    yield from close()
                    cell, waiting, rows, block, done = at[a], [], 0, None, False
                part = batch.slice(a, b - a)
                if kinds[a] == 0:
                    waiting.append(part)
                    continue
                if block is None:
                    if not waiting:  # candidates of a cell without anchors
                        done = True
                        continue
                    block, waiting = _Cell(bucket(), k, same), []
                if not done:
                    for s in range(0, len(part), BUCKET):
                        waiting.append(part.slice(s, BUCKET))
                        rows += waiting[-1].num_rows
                        if rows >= BUCKET:
                            done = not block.take(bucket())
                            waiting, rows = [], 0
                            if done:
                                break
        yield from close()

    return run


def search(vecs: DataFrame, anchors: DataFrame, count: int, k: int, same: bool) -> DataFrame:
    """uid, of, found_id, score, place: the best k rows of vecs for each window of each anchor, by falling score, then id.

    anchors has the columns of vecs and windows, an array of (of, low, high), null for no limit; `of` names the window. Only
    rows of the anchor's label count (same, and not the row itself) or only those of others.
    """
    n = int(vecs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-count // BLOCK))
    bands = max(1, -(-2 * n // blocks))
    at = lambda block, band: (block * bands + band).cast("int").alias("cell")
    part = lambda m: F.pmod(F.xxhash64("uid"), F.lit(m))
    tail = ["uid", "label", F.coalesce("vec_id", F.lit(int(NO_ID))).alias("id"), "v", "wide", "norm"]
    asks = anchors.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(bands - 1)))).select(at(part(blocks), F.col("band")), F.lit(0).alias("kind"), *tail, "windows")
    gives = vecs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(at(F.col("block"), part(bands)), F.lit(1).alias("kind"), *tail, F.lit(None).cast(asks.schema["windows"].dataType).alias("windows"))
    rows = asks.union(gives).repartitionById(n, F.col("cell") % n).sortWithinPartitions("cell", "kind", F.desc("norm"))
    found = rows.mapInArrow(search_cells(k, same), "uid long, of long, found_id long, score long")
    best = Window.partitionBy("uid", "of").orderBy(F.desc("score"), F.col("found_id").asc_nulls_last())
    return found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)


def mine(embeddings: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: the hard negatives of each anchor's positives."""
    vecs = vectors(embeddings)
    anchors = vecs.filter(F.col("vec_id") % every == 0)
    count = anchors.count()
    whole = F.array(F.struct(F.lit(0).cast("long").alias("of"), F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high")))
    near = written(search(vecs, anchors.withColumn("windows", whole), count, positives, True).select("uid", F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")
    # 50 p <= 100 n <= 95 p in whole numbers: n from half of p, rounded up, to p less a twentieth, rounded up.
    p = F.col("positive_score")
    window = F.struct(p.alias("of"), F.expr("positive_score div 2 + positive_score % 2").alias("low"), F.expr("positive_score - (positive_score div 20 + if(positive_score % 20 > 0, 1, 0))").alias("high"))
    windows = near.filter(p >= 0).groupBy("uid").agg(F.collect_set(window).alias("windows"))
    far = search(vecs, anchors.join(windows, "uid"), count, negatives, False)
    far = far.select("uid", F.col("of").alias("positive_score"), F.col("found_id").alias("negative_id"), F.col("score").alias("negative_score"), F.col("place").cast("int").alias("rank"))
    ids = anchors.select("uid", F.col("vec_id").alias("anchor_id"))
    return far.join(near, ["uid", "positive_score"]).join(ids, "uid").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
