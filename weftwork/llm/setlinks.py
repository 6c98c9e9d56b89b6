"""Links between members of proposed groups, a spanning forest, without all pairs and without a group in one task.

A group within `most` is compared in one task. Of a larger one, first a few members (leaders) are held against all others, in
rows of their own: what they link, directly or over each other, is one class and need not meet again. Then the largest class and
the rest are cut into chunks by a hash, and every chunk of the rest meets every other chunk; chunks of the largest class never
meet each other. So a group of near copies takes time in proportion to its size and to what its leaders leave over.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from weftwork.llm.common import written

#: Leaders a group over the bound, and bytes of leaders up to which they are broadcast.
LEADERS, LEADER_BYTES = 4, 16 << 20
#: Rows from which on small neighbouring cells are no longer compared together.
MERGE = 1024

Forest = Callable[[list[bytes], np.ndarray], list[tuple[int, int]]]


def joined(label: np.ndarray, i: int, j: int) -> bool:
    """Gives the class of j the label of i; whether they were apart."""
    if label[i] == label[j]:
        return False
    label[label == label[j]] = label[i]
    return True


def similar_forest(sets: list[np.ndarray], similar: tuple[int, int], label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (i, j) that join all sets whose Jaccard similarity is at least similar[0] / similar[1], exactly; a spanning forest.

    Sets of one label count as joined. Elements are put in order by how many sets hold them, rarest first; two similar sets share
    one of the first |x| - ceil(|x| * similarity) + 1 elements of each, so only these are looked up. The elements that all of a
    group share come last, so sets that are alike in a common part alone never meet.
    """
    p, q = similar
    n, sizes = len(sets), np.array([len(x) for x in sets], dtype=np.int64)
    label, out = np.arange(n) if label is None else np.unique(label, return_inverse=True)[1].copy(), []
    if n < 2 or (label == label[0]).all():
        return out
    alike = lambda both, i, j: (both > 0) & (both * (p + q) >= p * (sizes[i] + sizes[j]))
    _, term, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(times), np.int64)
    rank[np.argsort(times, kind="stable")] = np.arange(len(times))
    owner = np.repeat(np.arange(n), sizes)
    term = rank[term][np.lexsort((rank[term], owner))]
    at = np.r_[0, np.cumsum(sizes)]
    marked = np.zeros(len(times) + 1, dtype=bool)

    def test(i: int, others: np.ndarray) -> None:
        others = others[p * np.maximum(sizes[others], sizes[i]) <= q * np.minimum(sizes[others], sizes[i])]
        others = others[sizes[others] > 0]
        if not len(others):
            return
        marked[term[at[i] : at[i + 1]]] = True
        ends = np.cumsum(sizes[others])
        starts = np.r_[0, ends[:-1]]
        both = np.add.reduceat(marked[term[np.repeat(at[others] - starts, sizes[others]) + np.arange(ends[-1])]], starts, dtype=np.int64)
        marked[term[at[i] : at[i + 1]]] = False
        for j in others[alike(both, i, others)].tolist():
            if joined(label, i, j):
                out.append((i, j))

    test(int(np.argmax(sizes)), np.delete(np.arange(n), int(np.argmax(sizes))))
    if (label == label[0]).all():
        return out
    # Postings of the first elements alone, without those that one set alone has.
    first = np.arange(len(term)) - np.repeat(at[:-1], sizes) < np.repeat(sizes - -(-p * sizes // q) + 1, sizes)
    first &= np.sort(times)[term] > 1
    of, holder = term[first], owner[first]
    held = np.r_[0, np.cumsum(np.bincount(holder, minlength=n))]
    order = np.argsort(of, kind="stable")
    holders, ends = holder[order], np.cumsum(np.bincount(of, minlength=len(times)))
    begins = np.r_[0, ends[:-1]]
    large = label == np.bincount(label).argmax()
    for i in np.flatnonzero(~large | (large.sum() == 1)).tolist():
        mine = of[held[i] : held[i + 1]]
        count = ends[mine] - begins[mine]
        places = np.repeat(begins[mine] - np.cumsum(count) + count, count) + np.arange(count.sum())
        others = holders[places]
        others = others[(label[others] != label[i]) & ((others > i) | large[others])]
        if len(others):
            test(i, np.unique(others))
    return out


def set_forest(similar: tuple[int, int]) -> Forest:
    return lambda loads, label: similar_forest([np.frombuffer(x, dtype=np.uint64) for x in loads], similar, label)


def set_alike(similar: tuple[int, int]):
    """Column function over two sets, rising hashes as bytes: whether they are similar."""
    p, q = similar

    @arrow_udf("boolean")
    def alike(mine: pa.Array, leads: pa.Array) -> pa.Array:
        out, last, lead = [], None, None
        for x, y in zip(mine.to_pylist(), leads.to_pylist()):
            if y is not last and y != last:
                last, lead = y, np.frombuffer(y, dtype=np.uint64)
            a = np.frombuffer(x, dtype=np.uint64)
            if not len(a) or not len(lead):
                out.append(False)
                continue
            both = int((lead[np.minimum(np.searchsorted(lead, a), len(lead) - 1)] == a).sum())
            out.append(both * (p + q) >= p * (len(a) + len(lead)))
        return pa.array(out, pa.bool_())

    return alike


def compare(forest: Forest, merge: int):
    """mapInArrow over rows sorted by cell: (cell, node, label, load): links (u, v). Cells under `merge` rows share a comparison."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, nodes, labels, loads = None, [], [], []

        def found() -> list[tuple[int, int]]:
            return [(nodes[i], nodes[j]) for i, j in forest(loads, np.array(labels))] if len(nodes) > 1 else []

        rows = lambda out: pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["u", "v"])
        for batch in batches:
            out: list[tuple[int, int]] = []
            for cell, node, label, load in zip(*(c.to_pylist() for c in batch.columns)):
                if cell != last and len(nodes) >= merge:
                    out += found()
                    nodes, labels, loads = [], [], []
                last = cell
                nodes.append(node)
                labels.append(label)
                loads.append(load)
            yield rows(out)
        yield rows(found())

    return run


def links_within(rows: DataFrame, most: int, alike: Callable[..., Column], forest: Forest, components: Callable[[DataFrame], DataFrame], merge: int = 0) -> DataFrame:
    """Distinct links (u, v) that join all alike nodes of each cell. rows: cell, node (long), weight, load (binary)."""
    rows = written(rows.select("cell", "node", "weight", "load"), "links-rows")
    sums = rows.groupBy("cell").agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    sums = written(sums.select("cell", (F.col("total") > most).alias("large")), "links-cells")
    met = rows.join(sums, "cell")
    cells = met.filter(~F.col("large")).select("cell", "node", F.col("node").alias("label"), "load")
    links = []
    if sums.filter("large").limit(1).count():
        large = written(met.filter("large").select("cell", "node", "weight", "load", F.lit(False).alias("tied")), "links-large")
        for _ in range(LEADERS):
            lead = large.filter(~F.col("tied")).groupBy("cell").agg(F.min_by(F.struct("node", "load"), "node").alias("lead"))
            lead = written(lead.select("cell", F.col("lead.node").alias("lead"), F.col("lead.load").alias("lead_load")), "links-leaders")
            size = lead.agg(F.sum(F.octet_length("lead_load") + 32).alias("n")).first().n
            if not size:
                break
            met = large.join(F.broadcast(lead) if size <= LEADER_BYTES else lead, "cell", "left")
            hit = F.coalesce((F.col("node") == F.col("lead")) | alike(F.col("load"), F.coalesce("lead_load", F.lit(b""))), F.lit(False))
            large = written(met.withColumn("hit", hit), "links-large")
            links.append(large.filter("hit and node != lead").select(F.col("node").alias("u"), F.col("lead").alias("v")))
            large = large.select("cell", "node", "weight", "load", (F.col("tied") | F.col("hit")).alias("tied"))
        roots = components(reduce(DataFrame.union, links))
        large = written(large.join(roots, "node", "left").select("cell", "node", "weight", "load", F.coalesce("root", "node").alias("label")), "links-large")
        classes = large.groupBy("cell", "label").agg(F.sum("weight").alias("weight"))
        classes = classes.groupBy("cell").agg(F.max_by("label", F.struct("weight", "label")).alias("main"), F.max("weight").alias("inside"), F.sum("weight").alias("total"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        parts = lambda w: F.ceil(w * 2 / F.lit(most)).cast("int")
        classes = written(classes.select("cell", "main", parts(F.col("inside")).alias("mains"), parts(F.col("total") - F.col("inside")).alias("rests")), "links-classes")
        met = large.join(classes, "cell").withColumn("in", F.col("label") == F.col("main"))
        mine = F.pmod(F.xxhash64("node", F.lit(7)), F.when(F.col("in"), F.col("mains")).otherwise(F.col("rests"))).cast("int")
        span = lambda n, f: F.transform(F.sequence(F.lit(0), n - 1), f)
        cell = lambda *x: F.xxhash64("cell", *x)
        met = met.withColumn("mine", mine)
        to_rest = span(F.col("rests"), lambda i: cell(F.lit(1), F.least("mine", i), F.greatest("mine", i)))
        to_main = span(F.col("mains"), lambda j: cell(F.lit(2), F.col("mine"), j))
        from_main = span(F.col("rests"), lambda i: cell(F.lit(2), i, F.col("mine")))
        met = met.select(F.explode(F.when(F.col("in"), from_main).otherwise(F.concat(to_rest, to_main))).alias("cell"), "node", "label", "load")
        cells = cells.union(met)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = cells.repartition(n, "cell").sortWithinPartitions("cell").mapInArrow(compare(forest, merge), "u long, v long")
    return reduce(DataFrame.union, links, found).distinct()
