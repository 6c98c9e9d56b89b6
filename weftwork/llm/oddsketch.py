"""Operator 13, MinHash near-dedup: banded MinHash candidates, odd sketches to estimate them, full sets to confirm them.

A document's set are its distinct five-word shingles. SAMPLES MinHash samples of the set are folded into a bitmap of BITS bits,
each sample flipping the bit that it hashes to. Two bitmaps differ in the parity of the samples that the sets do not share, so
the population count of their XOR tells how many these are, most precisely where they are few, at high similarity. The first
BANDS * ROWS samples make BANDS keys; sets that share a key meet in a cell, where those over CUT differing bits part. What is
left only proposes groups; within a group, full sets are compared and links are those of similarity SIMILAR or more.

How much can be lost: two sets at the limit of 0.85 share no key with probability (1 - 0.85**3)**16 = 2.4e-7; over CUT bits
differ only if over 44 of 128 samples do where 19 are expected (6 deviations, about 1e-8), or the parity errs as far.

Equal sets are one node from the start, known by 128 bits, so copies cost nothing further. Shingles are known by 64 bits.

Nulls and edges: a null, empty or wordless text has an empty set, is linked with nothing and kept; fewer than five words are one
shingle, the whole sequence; repeated rows are linked like any equal sets; rows without a doc_id count like others, but give no
component their id: a component of such rows alone has a null id, and all of them are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from weftwork.llm.common import mix, slices, written
from weftwork.llm.setlinks import joined, links_within, set_alike, set_forest
from weftwork.llm.simhash import components, shingle_hashes, shingles_udf

SHINGLE, SIMILAR = 5, (85, 100)
SAMPLES, BITS, BANDS, ROWS, CUT = 128, 512, 16, 3, 80
#: Nodes of a cell, and shingles of a group, that one task compares at once; larger ones are divided.
CELL, SHINGLES = 4096, 1_000_000
#: Shingles of several texts that are sampled in one pass.
RUN = 1 << 15

_STEPS = mix(np.arange(1, 2 * SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FLIP, _TIMES = _STEPS[:SAMPLES], _STEPS[SAMPLES:] | np.uint64(1)


def samples(sets: list[np.ndarray]) -> np.ndarray:
    """SAMPLES MinHash samples of each set: the least of its elements under that many permutations. No set is empty."""
    out = np.empty((len(sets), SAMPLES), dtype=np.uint64)
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    ends = np.cumsum(sizes)
    a = 0
    while a < len(sets):
        base = ends[a] - sizes[a]
        b = max(a + 1, int(np.searchsorted(ends, base + RUN, side="right")))
        h = np.concatenate(sets[a:b])
        starts = ends[a:b] - sizes[a:b] - base
        for k in range(SAMPLES):
            out[a:b, k] = np.minimum.reduceat((h ^ _FLIP[k]) * _TIMES[k], starts)
        a = b
    return out


def odd_sketches(drawn: np.ndarray) -> np.ndarray:
    """A bitmap of BITS bits for each row of samples, 64 to a word: each sample flips the bit that it hashes to."""
    n = len(drawn)
    at = (mix(drawn + np.arange(SAMPLES, dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(BITS)).astype(np.int64)
    odd = np.bincount((np.arange(n)[:, None] * BITS + at).ravel(), minlength=n * BITS).reshape(n, BITS) & 1
    return np.packbits(odd.astype(np.uint8), axis=1, bitorder="little").view(np.uint64)


def band_keys(drawn: np.ndarray) -> np.ndarray:
    """BANDS keys of each row of samples, each of ROWS samples and of its place."""
    first = drawn[:, : BANDS * ROWS].reshape(len(drawn), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), first.shape[:2])
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + first[:, :, k])
    return key.view(np.int64)


def estimate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The Jaccard similarity that two odd sketches tell: 1 less the share of samples that the sets do not share."""
    apart = np.minimum(np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64), BITS // 2 - 1)
    return 1 + np.log(1 - 2 * apart / BITS) * BITS / (4 * SAMPLES)


def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over (id, h, text): (id, h, node, n, keys, sketch); all but id, h and n are null for an empty set."""
    for batch in batches:
        for a, b in slices(batch.column(2), 4 << 20):
            texts = pa.compute.fill_null(batch.column(2).slice(a, b - a), "").cast(pa.binary()).to_pylist()
            sets = [np.unique(shingle_hashes(t, SHINGLE)) for t in texts]
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            full = np.flatnonzero(sizes)
            drawn = samples([sets[i] for i in full])
            node, keys, sketch = ([None] * len(sets) for _ in range(3))
            for i, k, s in zip(full.tolist(), band_keys(drawn), odd_sketches(drawn)):
                node[i], keys[i], sketch[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), k, s.tobytes()
            columns = [pa.array(node, pa.binary()), pa.array(sizes), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(k).slice(a, b - a) for k in (0, 1)] + columns, ["id", "h", "node", "n", "keys", "sketch"])


def sketch_forest(loads: list[bytes], label: np.ndarray) -> list[tuple[int, int]]:
    """Links (i, j) of sketches at most CUT bits apart; a spanning forest. Sketches of one label count as joined."""
    s = np.frombuffer(b"".join(loads), dtype=np.uint64).reshape(len(loads), -1)
    label, out = np.unique(label, return_inverse=True)[1].copy(), []
    for a in range(0, len(s), 128):
        if (label == label[0]).all():
            break
        apart = np.zeros((min(128, len(s) - a), len(s) - a), dtype=np.uint16)
        for w in range(s.shape[1]):
            apart += np.bitwise_count(s[a : a + 128, w, None] ^ s[None, a:, w])
        i, j = np.nonzero((apart <= CUT) & (label[a : a + 128, None] != label[None, a:]))
        for x, y in zip((i + a).tolist(), (j + a).tolist()):
            if joined(label, x, y):
                out.append((x, y))
    return out


def sketches_alike():
    """Column function over two sketches: whether at most CUT bits differ."""

    @arrow_udf("boolean")
    def alike(mine: pa.Array, leads: pa.Array) -> pa.Array:
        x, y = (np.frombuffer(b"".join(t or bytes(BITS // 8) for t in c.to_pylist()), dtype=np.uint64).reshape(len(c), -1) for c in (mine, leads))
        return pa.array(np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= CUT)

    return alike


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    prints = written(texts.mapInArrow(sketched, f"id {kind}, h long, node binary, n long, keys array<long>, sketch binary"), "odd-prints")
    firsts = F.min_by(F.struct("id", "h", "n", "keys", "sketch"), F.struct(F.col("id").isNull(), "id", "h")).alias("f")
    nodes = prints.filter("node is not null").groupBy("node").agg(firsts).select("node", "f.*").withColumn("nid", F.monotonically_increasing_id())
    nodes = written(nodes, "odd-nodes")
    # Banded candidates, parted by their sketches.
    cells = nodes.select(F.explode("keys").alias("cell"), F.col("nid").alias("node"), F.lit(1).alias("weight"), F.col("sketch").alias("load"))
    groups = components(links_within(cells, CELL, sketches_alike(), sketch_forest, components, merge=1024))
    # Full sets of the members of each proposed group, read again from one document of each node.
    wanted = nodes.select("nid", F.col("id").alias("k_id"), F.col("h").alias("k_h"), F.col("n").alias("weight")).join(groups.withColumnRenamed("node", "nid"), "nid")
    wanted = written(wanted, "odd-proposed")
    same = F.col("id").eqNullSafe(F.col("k_id")) & (F.col("h") == F.col("k_h"))
    members = texts.join(wanted.hint("shuffle_hash"), same).groupBy("nid").agg(F.first("root").alias("cell"), F.first("weight").alias("weight"), F.first("text").alias("text"))
    sets = members.select("cell", F.col("nid").alias("node"), "weight", shingles_udf(SHINGLE)("text").alias("load"))
    roots = components(links_within(sets, SHINGLES, set_alike(SIMILAR), set_forest(SIMILAR), components))
    # The smallest id of each component, to each node, to each document.
    tagged = nodes.select("node", "nid", "id").join(roots.withColumnRenamed("node", "nid"), "nid", "left").select("node", "id", F.coalesce("root", "nid").alias("root"))
    tagged = written(tagged, "odd-tagged")
    least = tagged.groupBy("root").agg(F.min("id").alias("component_id"))
    ids = tagged.join(least, "root").select("node", "component_id")
    out = prints.select("id", "n", "node").join(ids, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
