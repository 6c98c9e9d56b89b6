"""Operator 12, conversation prefix trie: chained digests of every prefix, grouped into nodes; subtree sums over ancestors.

A turn is a SHA-256 of role and text; a prefix is a SHA-256 of the digest of the prefix before it and its last turn, so equal
prefixes have equal digests, and a prefix is 32 bytes whatever it holds. Every conversation gives a row for each of its prefixes
(read in order, one digest in memory), and the prefixes are grouped by (depth, digest): these are the nodes. A node is known by
its depth and smallest member. Nodes go to all their ancestors, which are the prefixes of that member; the nodes that one
conversation stands for are summed from its end first, so that an ancestor gets one row a conversation, not one a node.
Texts are read once, for digests and lengths; only these are shuffled.

The list of conversations that end at a node is hashed as a stream: ids sorted over all tasks, joined to pieces of PIECE
characters where they lie, and the pieces hashed in order, so no list is ever held whole.

Nulls and edges: a null turn comes first; turns of equal number are put in order by their digests; a repeated row is a turn of
its own; null role and text are empty; rows without a conv_id take no part; no conversations give no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftwork.llm.common import written

#: Characters of joined ids in a piece.
PIECE = 1 << 16
ROOT = bytes(32)


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, at (from 0), digest and code points of each turn. A length before the role keeps role and text apart."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    rows = rows.select("conv_id", F.col("turn").alias("place"), digest.alias("turn"), F.char_length("text").cast("long").alias("chars"))
    order = Window.partitionBy("conv_id").orderBy(F.col("place").asc_nulls_first(), "turn")
    return rows.withColumn("at", (F.row_number().over(order) - 1).cast("long")).drop("place")


def rebuilt(conversations: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """conv_id, at, turn, chars: the first h turns of the conversation that starts its group, then its own after its first h.

    h = crc32(conv_id as text) % most. A conversation left without turns has one row with a null `at`.
    """
    own = written(turns(conversations), "trie-turns")
    h, base = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most, F.col("conv_id") - F.col("conv_id") % group
    convs = own.select("conv_id").distinct().select("conv_id", h.alias("h"), base.alias("base"))
    heads = own.filter((F.col("at") < most - 1) & (F.col("conv_id") % group == 0)).select(F.col("conv_id").alias("base"), "at", "turn", "chars")
    first = convs.join(heads, "base", "left").select("conv_id", F.when(F.col("at") < F.col("h"), F.struct("at", "turn", "chars")).alias("t"))
    # One row without a turn for each conversation, so that none is lost.
    none = convs.select("conv_id", F.lit(None).cast(first.schema["t"].dataType).alias("t"))
    later = own.filter(F.col("at") >= h).select("conv_id", F.struct("at", "turn", "chars").alias("t"))
    return first.filter("t is not null").union(later).union(none).select("conv_id", "t.*")


def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over rows sorted by conv_id and `at`, null first: a row for each prefix, the empty one too."""
    conv, depth, digest = None, 0, ROOT
    for batch in batches:
        ids, turn_of, at = batch.column("conv_id").to_pylist(), batch.column("turn").to_pylist(), batch.column("at").to_pylist()
        depths, digests, parents = [], [], []
        for c, t, a in zip(ids, turn_of, at):
            if c != conv:
                conv, depth, digest = c, 0, ROOT
            before = None
            if a is not None:
                before, depth, digest = digest, depth + 1, hashlib.sha256(digest + t).digest()
            depths.append(depth)
            digests.append(digest)
            parents.append(before)
        chars = pa.compute.fill_null(batch.column("chars"), 0)
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(depths, pa.int64()), pa.array(digests, pa.binary()), pa.array(parents, pa.binary()), chars], ["conv_id", "depth", "digest", "parent", "chars"])


def prefixes(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, digest, parent, chars (of the last text), last: every prefix of every rebuilt conversation, written."""
    rows = rebuilt(conversations)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", F.col("at").asc_nulls_first())
    rows = rows.mapInArrow(chained, "conv_id long, depth long, digest binary, parent binary, chars long")
    ends = Window.partitionBy("conv_id").orderBy("depth")
    return written(rows.withColumn("last", F.lead("depth").over(ends).isNull()), "trie-prefixes")


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over (depth, digest, conv_id) sorted by these: ids of a node joined by commas, PIECE characters or so a row."""
    key, first, held, size = None, 0, [], 0

    def rows(done):
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate(kinds)], ["depth", "digest", "first", "ids"])

    for batch in batches:
        out = []
        for d, g, c in zip(*(batch.column(n).to_pylist() for n in ("depth", "digest", "conv_id"))):
            if (d, g) != key or size >= PIECE:
                if held:
                    out.append((*key, first, ",".join(held)))
                key, first, held, size = (d, g), c, [], 0
            held.append(str(c))
            size += len(held[-1]) + 1
        yield rows(out)
    if held:
        yield rows([(*key, first, ",".join(held))])


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over pieces sorted by node and first id: the SHA-256 of each node's whole list."""
    key, state = None, None

    def rows(done):
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.string()))], ["depth", "digest", "ends"])

    for batch in batches:
        done = []
        for d, g, ids in zip(*(batch.column(n).to_pylist() for n in ("depth", "digest", "ids"))):
            if (d, g) != key:
                if state:
                    done.append((*key, state.hexdigest()))
                key, state = (d, g), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield rows(done)
    if state:
        yield rows([(*key, state.hexdigest())])


def end_lists(paths: DataFrame) -> DataFrame:
    """depth, digest, ends: the hash of the sorted ids that end at each node where any do."""
    n = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = paths.filter("last").select("depth", "digest", "conv_id")
    joined = ends.repartitionByRange(n, "depth", "digest", "conv_id").sortWithinPartitions("depth", "digest", "conv_id").mapInArrow(pieces, "depth long, digest binary, first long, ids string")
    return joined.repartition(n, "depth", "digest").sortWithinPartitions("depth", "digest", "first").mapInArrow(hashed, "depth long, digest binary, ends string")


def subtree_sums(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """depth, digest, n_leaves, saved_tokens: each node's values summed at itself and all its ancestors."""
    zero = F.lit(0).cast("long")
    own = nodes.select("conv_id", "depth", F.lit(None).cast("binary").alias("digest"), (F.col("n_ends") == F.col("n_convs")).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    rows = paths.select("conv_id", "depth", "digest", zero.alias("leaf"), zero.alias("saved")).union(own)
    below = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("leaf", F.sum("leaf").over(below)).withColumn("saved", F.sum("saved").over(below))
    return rows.filter("digest is not null and (leaf != 0 or saved != 0)").groupBy("depth", "digest").agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def trie(conversations: DataFrame) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    paths = prefixes(conversations)
    nodes = paths.groupBy("depth", "digest").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("parent").alias("parent"), F.min("chars").alias("chars"), F.sum(F.col("last").cast("long")).alias("n_ends"))
    nodes = written(nodes, "trie-nodes")
    kids = nodes.filter("depth > 0").groupBy(F.col("depth") - 1, "parent").agg(F.count(F.lit(1)).alias("n_children")).toDF("depth", "digest", "n_children")
    # All that is known of a node meets in one grouping; each of the four gives a node one row at most.
    names = ["conv_id", "n_convs", "parent", "n_children", "n_leaves", "saved_tokens", "ends"]
    kinds = {"parent": "binary", "ends": "string"}
    wide = lambda df: df.select("depth", "digest", *(F.col(c) if c in df.columns else F.lit(None).cast(kinds.get(c, "long")).alias(c) for c in names))
    known = wide(nodes).union(wide(kids)).union(wide(subtree_sums(paths, nodes))).union(wide(end_lists(paths)))
    known = known.groupBy("depth", "digest").agg(*(F.max(c).alias(c) for c in names))
    # A parent may have any number of children: they are not grouped after the join, so that its partition can be split.
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = written(known, "trie-known").join(parents, ["depth", "parent"], "left")
    none = hashlib.sha256(b"").hexdigest()
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    return out.select("conv_id", "depth", "parent_conv_id", *counts, F.coalesce("ends", F.lit(none)).alias("ends_sha256"))
