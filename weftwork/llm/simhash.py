"""Operator 5, SimHash near-dedup: bit-sliced comparison of fingerprints within cells, then connected components.

Fingerprints at most `radius` bits apart must be equal in one of radius+1 blocks of bits, so each distinct fingerprint goes
to one cell a block (pigeonhole: no link is lost). Within a cell, bit planes are stored vertically, one machine word holding
one bit of 64 fingerprints; carry-save counters add up the differing bits of many pairs at once, and pairs of a block are
abandoned once all of them exceed the radius. A cell gives a spanning forest of its links, never all its pairs. A cell over
CELL fingerprints is divided by the blocks of another cut of the bits, of which one must agree too, up to DIVIDED times and as
long as that halves the largest cell; what is still over CELL (fingerprints that hardly differ) is cut into chunks, and every two
chunks meet in a cell of their own.

Nulls and edges: a null or wordless text has the fingerprint zero and links like any other; fewer words than a shingle give
one shingle; equal fingerprints are one node; null doc_ids are kept, and a component of them alone has a null id.

The pipeline's near-duplicate filter (`deduplicated`) proposes groups in this way and confirms their links by exact Jaccard, both
with the large groups divided as `setlinks` says.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from weftwork.llm.common import LOWER_TABLE, mix, slices, small, written
from weftwork.llm.setlinks import links_within, set_alike, set_forest

#: A cell over so many fingerprints is cut into chunks; cells under MERGE share one comparison.
CELL, MERGE, DIVIDED = 8192, 1024, 3
#: Queries compared at once, and bit planes between two looks at whether all pairs exceed the radius.
ROWS, LOOK = 256, 16


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `size` words, A-Z lowered, joined by single spaces; repeats stay."""
    w = text.translate(LOWER_TABLE).split()
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), 42)], dtype=np.uint64)
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), map(b" ".join, zip(*(w[i:] for i in range(size))))), dtype=np.uint64, count=len(w) - size + 1)


def fold(hashes: np.ndarray, lanes: int = 1) -> np.ndarray:
    """The fingerprint, 64 bits a lane: a bit is set if it is set in over half of the hashes. Later lanes remix the hashes."""
    out = np.zeros(lanes, dtype=np.uint64)
    for lane in range(lanes if len(hashes) else 0):
        h = mix(hashes + np.uint64(lane * 0x9E3779B97F4A7C15 % (1 << 64))) if lane else hashes
        ones = np.zeros(64, dtype=np.int64)
        for i in range(0, len(h), 4096):
            ones += np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[lane] = np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0]
    return out


def fingerprint_udf(size: int, lanes: int = 1, keys: int = 0):
    """Column function text -> array<long>: the lanes of the fingerprint, then `keys` minima of remixed shingle hashes."""

    @arrow_udf("array<bigint>")
    def fingerprint(texts: pa.Array) -> pa.Array:
        out = np.zeros((len(texts), lanes + keys), dtype=np.uint64)
        for a, b in slices(texts, 4 << 20):
            for i, t in enumerate(pa.compute.fill_null(texts[a:b], "").cast(pa.binary()).to_pylist(), a):
                h = shingle_hashes(t, size)
                out[i, :lanes] = fold(h, lanes)
                if keys and len(h):
                    out[i, lanes:] = [mix(h ^ np.uint64(0xD6E8FEB86659FD93 * (k + 1) % (1 << 64))).min() for k in range(keys)]
        at = pa.array(np.arange(0, out.size + 1, lanes + keys, dtype=np.int32))
        return pa.ListArray.from_arrays(at, pa.array(out.view(np.int64).ravel()))

    return fingerprint


def set_print_udf(size: int, lanes: int, keys: int):
    """Column function text -> array<long> of the set of its shingles: a hash of the whole set, how many shingles it has, the
    lanes of its fingerprint, then `keys` minima of remixed shingle hashes. Repeats count once."""

    @arrow_udf("array<bigint>")
    def set_print(texts: pa.Array) -> pa.Array:
        out = np.zeros((len(texts), 2 + lanes + keys), dtype=np.uint64)
        for a, b in slices(texts, 4 << 20):
            for i, t in enumerate(pa.compute.fill_null(texts[a:b], "").cast(pa.binary()).to_pylist(), a):
                h = np.unique(shingle_hashes(t, size))
                out[i, :2] = xxhash.xxh64_intdigest(h.tobytes()), len(h)
                out[i, 2 : 2 + lanes] = fold(h, lanes)
                if len(h):
                    out[i, 2 + lanes :] = [mix(h ^ np.uint64(0xD6E8FEB86659FD93 * (k + 1) % (1 << 64))).min() for k in range(keys)]
        at = pa.array(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32))
        return pa.ListArray.from_arrays(at, pa.array(out.view(np.int64).ravel()))

    return set_print


def shingles_udf(size: int):
    """Column function text -> its distinct shingle hashes, rising, as bytes."""

    @arrow_udf("binary")
    def shingles(texts: pa.Array) -> pa.Array:
        out = []
        for a, b in slices(texts, 4 << 20):
            out += [np.unique(shingle_hashes(t or b"", size)).tobytes() for t in texts[a:b].cast(pa.binary()).to_pylist()]
        return pa.array(out, pa.binary())

    return shingles


def planes(prints: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints (n, lanes): row b holds bit b of all of them, 64 to a word."""
    n, lanes = prints.shape
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(n, 8 * lanes), axis=1, bitorder="little")
    wide = np.zeros((64 * lanes, -(-n // 64) * 64), dtype=np.uint8)
    wide[:, :n] = bits.T
    return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)


def _over(counts: list[np.ndarray], radius: int) -> np.ndarray:
    """A bit for each pair whose bit-sliced count exceeds the radius."""
    over = np.zeros_like(counts[0])
    same = ~over
    for j in range(len(counts) - 1, -1, -1):
        if radius >> j & 1:
            same &= counts[j]
        else:
            over |= same & counts[j]
            same &= ~counts[j]
    return over


def near(prints: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of all pairs i < j at most radius bits apart, a block of rows at a time."""
    n, lanes = prints.shape
    stored = planes(prints)
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(n, 8 * lanes), axis=1, bitorder="little")
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for a in range(0, n, ROWS):
        rows = np.arange(a, min(a + ROWS, n))
        w0 = a // 64
        counts = [np.zeros((len(rows), stored.shape[1] - w0), dtype=np.uint64) for _ in range((64 * lanes).bit_length())]
        for b in range(0, 64 * lanes, 2):
            x = stored[b, w0:][None, :] ^ (bits[rows, b].astype(np.uint64) * full)[:, None]
            y = stored[b + 1, w0:][None, :] ^ (bits[rows, b + 1].astype(np.uint64) * full)[:, None]
            # A full adder takes both planes at once; its carry ripples as far as a count can have grown.
            c = counts[0]
            t = c ^ x
            carry = (c & x) | (t & y)
            counts[0] = t ^ y
            for j in range(1, (b + 2).bit_length()):
                c = counts[j]
                counts[j] = c ^ carry
                carry = c & carry
            if (b + 2) % LOOK == 0 and b + 2 > radius:
                alive = (_over(counts, radius) != full).any(axis=1)
                if not alive.all():
                    rows, counts = rows[alive], [c[alive] for c in counts]
                if not len(rows):
                    break
        if len(rows):
            hit = np.unpackbits((~_over(counts, radius)).view(np.uint8), axis=1, bitorder="little")[:, : n - 64 * w0]
            i, j = np.nonzero(hit)
            i, j = rows[i], j + 64 * w0
            yield i[i < j], j[i < j]


def forest(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Members of a cell that link to others, and the first member that each can be reached from."""
    label = np.arange(len(prints))
    for i, j in near(prints, radius):
        while len(i):
            low = np.minimum(label[i], label[j])
            old = label.copy()
            np.minimum.at(label, old[i], low)
            np.minimum.at(label, old[j], low)
            while (label[label] != label).any():
                label = label[label]
            open_ = label[i] != label[j]
            i, j = i[open_], j[open_]
    moved = np.flatnonzero(label != np.arange(len(label)))
    return moved, label[moved]


def compare(radius: int, lanes: int):
    """mapInArrow over rows sorted by cell: (cell, node, print): gives links (node, other)."""

    def links(cell: np.ndarray, node: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        a, b = forest(prints, radius)
        return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0

        def join():
            cell, node, prints = (np.concatenate(x) for x in zip(*held))
            return cell, node, prints

        for batch in batches:
            prints = np.asarray(batch.column(2).flatten()).view(np.uint64).reshape(-1, lanes)
            held.append((np.asarray(batch.column(0)), np.asarray(batch.column(1)), prints))
            rows += len(prints)
            if rows < MERGE:
                continue
            # All but the last cell are whole. Small neighbours share a comparison: what links in it is a link.
            cell, node, prints = join()
            starts = np.r_[0, np.flatnonzero(cell[1:] != cell[:-1]) + 1]
            at = 0
            for s, e in zip(starts[:-1], starts[1:]):
                if e - at >= MERGE or e == starts[-1]:
                    if e - s >= MERGE and s > at:
                        yield links(cell[at:s], node[at:s], prints[at:s])
                        at = s
                    yield links(cell[at:e], node[at:e], prints[at:e])
                    at = e
            held, rows = [(cell[at:], node[at:], prints[at:])], len(cell) - at
        if held:
            yield links(*join())

    return run


def block_cells(prints: DataFrame, radius: int, count: int) -> DataFrame:
    """(cell, node, print): each fingerprint of one lane once for every choice of blocks that must agree.

    With radius+1 blocks one must agree, with radius+2 two, and so on. More blocks are taken as the corpus grows, so that a
    cell of evenly spread fingerprints stays at about a thousand; only as many bits of a key are used as that needs.
    """
    from itertools import combinations

    want = max(1, math.ceil(math.log2(max(count, 1) / 1024))) if count > 1024 else 1
    agree = 1
    while agree < 5 and agree * 64 // (radius + agree) < want:
        agree += 1
    n = radius + agree
    edges = [64 * i // n for i in range(n + 1)]
    keys = []
    for k, chosen in enumerate(combinations(range(n), agree)):
        bits = [b for c in chosen for b in range(edges[c], edges[c + 1])]
        mask = sum(1 << b for b in bits[: max(want, 1)])
        mask -= (1 << 64) if mask >> 63 else 0
        keys.append(F.xxhash64(F.lit(k), F.col("print")[0].bitwiseAND(F.lit(mask))))
    return prints.select(F.explode(F.array(*keys)).alias("cell"), "node", "print")


def divided(cells: DataFrame, radius: int, level: int) -> DataFrame:
    """cells with those over CELL nodes of one lane divided by radius+1 blocks of bits, cut elsewhere at each level: two
    fingerprints within the radius agree in one of any radius+1 blocks, so they meet again."""
    large = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CELL).select(F.col("cell").alias("of"))
    shift, n, keys = 64 * level // (DIVIDED + 1) // (radius + 1) + level, radius + 1, []
    for k in range(n):
        mask = sum(1 << (b + shift) % 64 for b in range(64 * k // n, 64 * (k + 1) // n))
        mask -= (1 << 64) if mask >> 63 else 0
        keys.append(F.xxhash64("cell", F.lit(level), F.lit(k), F.col("print")[0].bitwiseAND(F.lit(mask))))
    to = F.when(F.col("of").isNull(), F.array("cell")).otherwise(F.array(*keys))
    out = cells.join(small(large), F.col("cell") == F.col("of"), "left").select(F.explode(to).alias("cell"), "node", "print")
    return written(out, "simhash-cells")


def largest(cells: DataFrame) -> int:
    return cells.groupBy("cell").count().agg(F.max("count")).first()[0] or 0


def links(cells: DataFrame, radius: int) -> DataFrame:
    """Distinct links (u, v) between nodes that share a cell and are at most radius bits apart, a spanning forest a cell.

    Cells over CELL nodes are divided; those that stay so large are cut by a hash of the node, and every two chunks of a cell
    meet in one cell of their own.
    """
    cells = written(cells, "simhash-cells")
    most = largest(cells)
    for level in range(1, DIVIDED + 1):
        if most <= CELL:
            break
        finer = divided(cells, radius, level)
        # Fingerprints that agree in nearly all bits stay together in every block: their cell would only be there five times.
        if 2 * (left := largest(finer)) > most:
            break
        cells, most = finer, left
    sums = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    chunks = F.ceil(F.col("n") / F.lit(CELL)).cast("int")
    cells = cells.join(sums, "cell").withColumn("k", chunks)
    mine = F.pmod(F.xxhash64("node", F.lit(7)), F.col("k")).cast("int")
    few = F.col("k") == 1
    cells = cells.withColumn("other", F.explode(F.when(few, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("k") - 1))))
    cells = cells.select(F.when(few, F.col("cell")).otherwise(F.xxhash64("cell", F.least(mine, F.col("other")), F.greatest(mine, F.col("other")))).alias("cell"), "node", "print")
    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(n, "cell").sortWithinPartitions("cell").mapInArrow(compare(radius, 1), "u long, v long").distinct()


def wide_links(cells: DataFrame, radius: int) -> DataFrame:
    """`links` of fingerprints of several lanes, by leaders and chunks of large cells."""

    @arrow_udf("binary")
    def as_bytes(prints: pa.Array) -> pa.Array:
        flat = np.asarray(prints.flatten()).reshape(len(prints), -1)
        return pa.array([x.tobytes() for x in flat], pa.binary())

    @arrow_udf("boolean")
    def alike(mine: pa.Array, leads: pa.Array) -> pa.Array:
        x = mine.to_pylist()
        a, b = (np.frombuffer(b"".join(c), dtype=np.uint64).reshape(len(c), -1) for c in (x, [t or bytes(len(x[0])) for t in leads.to_pylist()]))
        return pa.array(np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64) <= radius)

    def near_forest(loads: list[bytes], _: np.ndarray) -> list[tuple[int, int]]:
        a, b = forest(np.frombuffer(b"".join(loads), dtype=np.uint64).reshape(len(loads), -1), radius)
        return list(zip(a.tolist(), b.tolist()))

    rows = cells.select("cell", "node", F.lit(1).alias("weight"), as_bytes("print").alias("load"))
    return links_within(rows, CELL, alike, near_forest, components, merge=MERGE)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each linked node can be reached from.

    Every round, a node takes the least label of itself and its neighbours, then the label of that label; each round is
    written to the shared folder. Labels only fall, so the rounds end when none changed.
    """
    edges = written(edges.select("u", "v").union(edges.select("v", "u")).distinct(), "simhash-links")
    labels = written(edges.groupBy(F.col("u").alias("node")).agg(F.least("node", F.min("v")).alias("root")), "simhash-labels")
    while True:
        heard = edges.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("heard"))
        step = labels.join(heard, "node").select("node", F.col("root").alias("was"), F.least("root", "heard").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("far"))
        after = written(step.join(jump, "root", "left").select("node", "was", F.least("root", "far").alias("root")), "simhash-labels")
        changed = after.filter("root != was").limit(1).count()
        labels = after.select("node", "root")
        if not changed:
            return labels


def confirmed(docs: DataFrame, nodes: DataFrame, roots: DataFrame, size: int) -> DataFrame:
    """Links (u, v) between nodes of one proposed group (node, root) whose shingle sets are similar, compared exactly.

    docs has id, h and text, nodes the id and h of one text of each. A group of over SHINGLES shingles is divided.
    """
    nodes = nodes.select("node", "n", F.col("least.id").alias("k_id"), F.col("least.h").alias("k_h")).join(roots, "node")
    wanted = written(nodes.select("node", F.col("root").alias("cell"), F.col("n").alias("weight"), "k_id", "k_h"), "simhash-proposed")
    same = F.col("id").eqNullSafe(F.col("k_id")) & (F.col("h") == F.col("k_h"))
    texts = docs.join(wanted.hint("shuffle_hash"), same).groupBy("node").agg(F.first("cell").alias("cell"), F.first("weight").alias("weight"), F.first("text").alias("text"))
    sets = texts.select("cell", "node", "weight", shingles_udf(size)("text").alias("load"))
    return links_within(sets, SHINGLES, set_alike(SIMILAR), set_forest(SIMILAR), components)


def grouped(prints: DataFrame, least, radius: int, lanes: int, cells, confirm=None) -> tuple[DataFrame, DataFrame]:
    """(node, root) of all nodes and (root, least): the least value, of an expression over prints, in each component.

    prints has node and print (and keys, n); equal nodes are summed up before anything meets in one place. With `confirm`,
    what the fingerprints link is only proposed: components are made of the links that confirm(nodes, roots) gives.
    """
    more = [F.first(c).alias(c) for c in ("keys", "n") if c in prints.columns]
    nodes = written(prints.groupBy("node").agg(F.first("print").alias("print"), F.min(least).alias("least"), *more), "simhash-nodes")
    roots = components(links(cells(nodes), radius) if lanes == 1 else wide_links(cells(nodes), radius))
    if confirm:
        roots = components(confirm(nodes, roots))
    tagged = nodes.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    return tagged.select("node", "root"), tagged.groupBy("root").agg(F.min("least").alias("least"))


def simhash_components(docs: DataFrame, size: int = 4, radius: int = 4) -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hex digits), component_id."""
    prints = docs.select("doc_id", fingerprint_udf(size)("text").alias("print")).withColumn("node", F.col("print")[0])
    prints = written(prints, "simhash-prints")
    nodes, least = grouped(prints, F.col("doc_id"), radius, 1, lambda nodes: block_cells(nodes, radius, nodes.count()))
    ids = nodes.join(least, "root").select("node", F.col("least").alias("component_id"))
    return prints.join(ids, "node").select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")


#: Near-duplicate filter: shingles of five words, fingerprints of eight lanes, cells by eight minima of shingle hashes. The
#: fingerprint only proposes: sets of similarity 0.8 differ in 78 of the 512 bits on average with a deviation of 8, and in 96
#: in the worst case (4 shingles of 5), so RADIUS is over five deviations off.
SHINGLE, LANES, KEYS, RADIUS = 5, 8, 8, 144
#: Texts are near duplicates from a Jaccard similarity of 4 / 5 on: as a ratio, so that it is compared in whole numbers.
SIMILAR = (4, 5)
#: A proposed group of over so many shingles is divided.
SHINGLES = 1_000_000


def deduplicated(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of docs, unchanged, of which one stays for each group of near duplicates: that of the smallest doc_id.

    Texts meet in a cell for each minimum that they share; two texts of similarity 0.8 share none of eight once in 400,000.
    Fingerprints of the shingle sets within the radius propose groups; within each, sets of Jaccard similarity 0.8 or more,
    compared exactly, link, and the groups that count are the connected components of these links. Rows of the same doc_id
    and text count as one; rows without a doc_id stay only if all of their group are such.
    """
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    prints = docs.select(F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), set_print_udf(size, LANES, KEYS)("text").alias("all"))
    prints = prints.select("id", "h", F.col("all")[0].alias("node"), F.col("all")[1].alias("n"), F.slice("all", 3, LANES).alias("print"), F.slice("all", LANES + 3, KEYS).alias("keys"))
    prints = written(prints, "simhash-prints")
    cells = lambda nodes: nodes.select(F.explode(F.transform("keys", lambda k, i: F.xxhash64(i, k))).alias("cell"), "node", "print")
    texts = docs.select(F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text")
    _, least = grouped(prints, F.struct(F.col("id").isNull().alias("none"), "id", "h"), radius, LANES, cells, lambda nodes, roots: confirmed(texts, nodes, roots, size))
    stay = written(least.select(F.col("least.id").alias("k_id"), F.col("least.h").alias("k_h")), "simhash-stay")
    same = F.col("id").eqNullSafe(F.col("k_id")) & (F.col("h") == F.col("k_h"))
    again = prints.groupBy("id", "h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").join(stay, same).select("k_id", "k_h")
    kept = whole.join(stay.hint("shuffle_hash"), same)
    if again.limit(1).count():
        again = written(again, "simhash-again")
        lone = whole.join(stay.join(again, ["k_h"], "left_anti").hint("shuffle_hash"), same)
        twice = whole.join(stay.join(again.select("k_h").distinct(), "k_h", "left_semi").hint("shuffle_hash"), same)
        kept = lone.select("row", "id", "h").union(twice.groupBy("id", "h").agg(F.first("row").alias("row")).select("row", "id", "h"))
    return kept.select("row.*")
