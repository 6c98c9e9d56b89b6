"""Operator 3, document fingerprints: closed syncmers as anchors with their places, compared by anchors in the same order.

A run of K code points is an anchor if the least hash among its runs of S lies at either of its edges. Whether a run is an
anchor depends on the run alone, so shared passages share their anchors whatever surrounds them, and an edit disturbs only
the runs that touch it. A fingerprint holds every anchor of the text, as its hash and its distance from the one before, so
places can be read back. Two fingerprints are compared by position: the i-th anchor of a hash in one text is paired with the
i-th of that hash in the other, and of these pairs the longest chain counts that goes forward in both texts; likeness is the
share of all anchors of both texts that are in it.

Nulls and edges: a null text is the empty text, with an empty fingerprint, which is like another empty one (1) and unlike
the rest (0); a text shorter than K is one anchor of its own; equal doc_ids are ordered by a hash of their text, equal rows
are interchangeable; null doc_ids come last in the order; the document after the last is the first, so a sole document
follows itself.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import arrow_udf

from weftwork.llm.common import mix, written

K, S = 32, 8
#: Bytes of text between two places where the order of all documents is cut, at most, and runs to a shuffle partition, at
#: least, about; bytes of text in such a partition, about; places drawn for one that is kept, so that runs are even; code points
#: looked at at once; equal rows from which on they are sent as one with their number.
RUN, RUNS, PART, DRAWN, CHUNK, EQUAL = 16 << 20, 8, 256 << 20, 16, 1 << 20, 1000


def anchors(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, 32-bit hash) of the closed syncmers of a sequence of code points."""
    n = len(points) - K + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    h = mix(points.astype(np.uint64))
    span, inner = 1, h
    while span < K:
        if span == S:
            inner = mix(h)
        h = h[:-span] * np.uint64(pow(0x9E3779B97F4A7C15, span, 1 << 64)) + h[span:]
        span *= 2
    # Least of the K - S + 1 inner runs: two overlapping windows of a power of two.
    least, span = inner, 1
    while 2 * span <= K - S + 1:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    last = K - S + 1 - span
    least = np.minimum(least[:n], least[last : last + n])
    at = np.flatnonzero((inner[:n] == least) | (inner[K - S : K - S + n] == least))
    return at, (mix(h[at]) >> np.uint64(32)).astype(np.uint32)


def short(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The one anchor of a text shorter than K."""
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    return np.zeros(1, np.int64), np.frombuffer(hashlib.sha256(points.tobytes()).digest()[:4], dtype=np.uint32)


def _nth(hashes: np.ndarray) -> np.ndarray:
    """Each hash with how many equal ones come before it, as one number."""
    order = np.argsort(hashes, kind="stable")
    rising = hashes[order]
    starts = np.flatnonzero(np.r_[True, rising[1:] != rising[:-1]])
    nth = np.arange(len(hashes)) - np.repeat(starts, np.diff(np.r_[starts, len(hashes)]))
    out = np.empty(len(hashes), dtype=np.uint64)
    out[order] = rising.astype(np.uint64) << np.uint64(32) | nth.astype(np.uint64)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the anchors of both texts (hashes in order of place) that pair up in one order."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if np.array_equal(a, b):
        return 1.0
    left, right = _nth(a), _nth(b)
    order = np.argsort(right)
    found = np.minimum(np.searchsorted(right, left, sorter=order), len(right) - 1)
    there = order[found]
    there = there[right[there] == left]
    # Steps of one are followed without a search: a shared passage is one run of them.
    ends: list[int] = []
    for place in there.tolist():
        if not ends or place > ends[-1]:
            ends.append(place)
        else:
            ends[bisect_left(ends, place)] = place
    return 2 * len(ends) / (len(a) + len(b))


_HEX = np.frombuffer(b"".join(b"%02x" % i for i in range(256)), dtype=np.uint8).reshape(256, 2)


def written_out(place: np.ndarray, hashes: np.ndarray) -> str:
    """Ten hex digits an anchor: its hash, then its distance from the anchor before (under K, for every K - S runs hold one)."""
    if not len(hashes):
        return ""
    gaps = np.diff(place, prepend=0).astype(np.uint8)
    each = np.column_stack([hashes.astype(">u4").view(np.uint8).reshape(-1, 4), gaps])
    return _HEX[each].tobytes().decode()


def read(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the anchors of a written fingerprint."""
    each = np.frombuffer(bytes.fromhex(fingerprint), dtype=np.uint8).reshape(-1, 5)
    return np.cumsum(each[:, 4], dtype=np.int64), np.ascontiguousarray(each[:, :4]).view(">u4").ravel().astype(np.uint32)


class Document:
    """A text with its anchors; those of an edited text come from these, but for the runs that straddle the seam."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        parts = [anchors(self.points[i : i + CHUNK + K - 1]) for i in range(0, max(len(self.points), 1), CHUNK)]
        self.at = np.concatenate([at + i * CHUNK for i, (at, _) in enumerate(parts)])
        self.hashes = np.concatenate([h for _, h in parts])
        if len(self.points) < K:
            self.at, self.hashes = short(self.points)

    def edited(self, after: Document) -> tuple[str, np.ndarray, np.ndarray]:
        """The edited text, and the places and hashes of its anchors."""
        n = len(self.points)
        cut, most = n - n // 2, min(n // 2, len(after.points))
        text = self.text[:cut] + after.text[:most]
        if cut + most < K:
            return text, *short(np.concatenate([self.points[:cut], after.points[:most]]))
        seam = np.concatenate([self.points[max(0, cut - K + 1) : cut], after.points[: min(most, K - 1)]])
        at, hashes = anchors(seam)
        at = at + max(0, cut - K + 1)
        head = self.at <= cut - K if n >= K else np.zeros(len(self.at), bool)
        tail = after.at <= most - K if len(after.points) >= K else np.zeros(len(after.at), bool)
        return text, np.concatenate([self.at[head], at, after.at[tail] + cut]), np.concatenate([self.hashes[head], hashes, after.hashes[tail]])


COLUMNS = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64(), "times": pa.int64()}
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, times long"


def _compared(doc_id: int | None, one: Document, after: Document, times: int) -> tuple:
    text, at, hashes = one.edited(after)
    digest = hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()
    return doc_id, len(one.points), digest, written_out(one.at, one.hashes), written_out(at, hashes), likeness(one.hashes, hashes), likeness(one.hashes, after.hashes), times


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares each document with the next one of its run; a row with ghost set only follows. Of n equal rows sent as one, all
    but the last follow each other."""
    last: tuple[int, int | None, Document] | None = None
    for batch in batches:
        out: list[tuple] = []
        held = 0
        for run, doc_id, ghost, times, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
            doc = Document(text)
            if last and last[0] == run:
                out.append(_compared(last[1], last[2], doc, 1))
                held += len(out[-1][3]) + len(out[-1][4])
            if times > 1 and not ghost:
                out.append(_compared(doc_id, doc, doc, times - 1))
            last = None if ghost else (run, doc_id, doc)
            if held > 32 << 20:
                yield _batch(out)
                out, held = [], 0
        yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(COLUMNS.values())], list(COLUMNS))


def _places(marks: pa.Table):
    """Column function (doc_id, tie) -> (run, ghost) of each place that a row is sent to: its run, and if the row begins that
    run, as a ghost to the run before. marks: (doc_id, tie) where runs begin, in order."""
    ids, ties = marks["doc_id"].combine_chunks(), np.asarray(marks["tie"], dtype=np.int64)
    none = np.asarray(ids.is_null(), dtype=bool)
    known = int((~none).sum())
    down = ~np.asarray(pa.compute.fill_null(ids, 0), dtype=np.int64)[:known]
    runs = len(ties)

    @arrow_udf(T.ArrayType(T.StructType([T.StructField("run", T.LongType()), T.StructField("ghost", T.BooleanType())])))
    def places(doc_id: pa.Array, tie: pa.Array) -> pa.Array:
        absent, tie = np.asarray(doc_id.is_null(), dtype=bool), np.asarray(tie, dtype=np.int64)
        at = ~np.asarray(pa.compute.fill_null(doc_id, 0), dtype=np.int64)
        low, high = np.searchsorted(down, at, "left"), np.searchsorted(down, at, "right")
        low[absent], high[absent] = known, runs
        run = high - 1
        begins = np.zeros(len(at), dtype=bool)
        # Where marks share the id, the tie decides: few ids, or the nulls all at once.
        open_ = np.flatnonzero(high > low)
        for a, b in set(zip(low[open_].tolist(), high[open_].tolist())):
            mine = open_[(low[open_] == a) & (high[open_] == b)]
            run[mine] = a + np.searchsorted(ties[a:b], tie[mine], "right") - 1
            begins[mine] = (run[mine] >= a) & (ties[np.maximum(run[mine], 0)] == tie[mine])
        size = np.where(begins, 2, 1)
        to = np.repeat(run, size)
        ghost = np.zeros(len(to), dtype=bool)
        second = np.cumsum(size)[begins] - 1
        ghost[second] = True
        to[second] = (to[second] - 1) % runs
        rows = pa.StructArray.from_arrays([pa.array(to.astype(np.int64)), pa.array(ghost)], ["run", "ghost"])
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), rows)

    return places


def _every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One of DRAWN rows of each sorted partition."""
    at = 0
    for batch in batches:
        yield batch.take(pa.array(np.arange(-at % DRAWN, batch.num_rows, DRAWN)))
        at += batch.num_rows


def fingerprint(docs: DataFrame, run: int = RUN) -> DataFrame:
    """One row a document, its fingerprint held against its edited text's and the next document's.

    The order of all documents (descending doc_id, nulls last, then a hash of the text) is cut into runs of about `run`
    bytes at documents drawn by a hash of both, so neither nulls nor a repeated doc_id gather in one run. The marks are read
    from doc_id and hash alone and sent to all tasks: 16 bytes for each `run` bytes of text (100 MB for 100 TB). A document that begins a run is
    also sent to the run before, so texts move once. Equal rows over EQUAL are sent as one, with their number.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    order = written(rows.groupBy("doc_id", "tie").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("text")).alias("b")), "fingerprint-order")
    n, size = order.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("b") * F.least("n", F.lit(EQUAL))), F.lit(0))).first()
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // PART)
    every = max(1, n // (DRAWN * max(1, size // run, RUNS * parts)))
    by = [F.col("doc_id").desc_nulls_last(), F.col("tie")]
    drawn = order.filter(F.pmod(F.xxhash64("doc_id", "tie", F.lit("run")), F.lit(every)) == 0).select("doc_id", "tie")
    even = drawn.orderBy(*by).mapInArrow(_every, "doc_id long, tie long")
    marks = order.orderBy(*by).limit(1).select("doc_id", "tie").union(even).distinct().orderBy(*by).toArrow()
    heavy = order.filter(F.col("n") > EQUAL).select(F.col("doc_id").alias("h_id"), F.col("tie").alias("h_tie"), F.col("n").alias("times"))
    if heavy.limit(1).count():
        with_times = rows.join(heavy, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("tie") == F.col("h_tie")), "left").select("doc_id", "tie", "text", "times")
        one = with_times.filter("times is not null").groupBy("doc_id", "tie").agg(F.first("text").alias("text"), F.first("times").alias("times"))
        rows = with_times.filter("times is null").withColumn("times", F.lit(1).cast("long")).unionByName(one)
    else:
        rows = rows.withColumn("times", F.lit(1).cast("long"))
    sent = rows.withColumn("to", F.explode(_places(marks)("doc_id", "tie"))).select("to.run", "doc_id", "to.ghost", "tie", "times", "text")
    dealt = sent.repartition(parts, "run").sortWithinPartitions("run", "ghost", *by)
    out = dealt.select("run", "doc_id", "ghost", "times", "text").mapInArrow(_rows, SCHEMA)
    return out.withColumn("again", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))).drop("again", "times")
