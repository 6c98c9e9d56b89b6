"""Operator 2, mixing sources to target weights: hash-threshold histograms, in DataFrame operations only.

Words are summed by source and hash bucket; the bucket in which a source's budget ends is refined twice, the others are
decided by their place alone. A document is then taken by comparing its hash with its source's threshold: nothing is sorted,
and a larger budget takes a superset of a smaller one.

Nulls and edges: a null text has size 0 and is never counted as taken; null sources form one source of their own, the last;
a null doc_id is hashed by its text; repeated rows share their hash and are taken alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftwork.llm.common import BROADCAST_ROWS, WORD, written

#: Hex digits of the hash for each level: 4,096 buckets, refined twice, so 36 bits in all.
DIGITS, LEVELS = 3, 3


def hash_digits(seed: str = "mix") -> Column:
    """The first 36 bits of the md5 of doc_id (of the text where it is null), as hex digits."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")))
    return F.substring(F.md5(key.cast("binary")), 1, DIGITS * LEVELS)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words) and the hash digits key of each document."""
    return docs.select("doc_id", "source", F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long").alias("size"), hash_digits().alias("key"))


def targets(sizes: DataFrame, share: float = 1.5, weights: tuple[int, ...] = (5, 2, 1), most: int = 2) -> DataFrame:
    """source, source_size, target. One row a source, so the two windows below order sources, never documents.

    The caps bind in order of cap over weight: a source is capped if, with all before it at their caps, an equal level for
    the rest would still lift it above its own.
    """
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy("level", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(rank) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    t = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight)
    t = t.withColumns({"cap": F.lit(most) * F.col("source_size"), "level": F.lit(most) * F.col("source_size") / F.col("weight")})
    t = t.withColumns({"budget": F.lit(share) * F.sum("source_size").over(Window.partitionBy()), "held": F.coalesce(F.sum("cap").over(before), F.lit(0)), "left": F.sum("weight").over(rest)})
    t = t.withColumn("free", F.col("budget") - F.col("held") < F.col("level") * F.col("left"))
    # The first source that is not capped has the level of all after it.
    level = F.min(F.when(F.col("free"), F.struct(F.col("level").alias("at"), ((F.col("budget") - F.col("held")) / F.col("left")).alias("to")))).over(Window.partitionBy())
    t = t.withColumn("to", level["to"])
    return t.select("source", "source_size", F.when(F.col("free"), F.least(F.col("to") * F.col("weight"), F.col("cap").cast("double"))).otherwise(F.col("cap").cast("double")).alias("target"))


def _digit(level: int) -> Column:
    return F.substring("key", 1, DIGITS * (level + 1))


def thresholds(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """goals with whole (times that every document is taken) and below (hash digits under which one more copy is)."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    edge = goals.withColumn("whole", whole.cast("long")).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
    edge = edge.withColumn("prefix", F.lit(""))
    for level in range(LEVELS):
        inside = sizes if not level else _with(sizes.withColumn("at", _digit(level - 1)), edge.select(F.col("source").alias("s"), F.col("prefix").alias("p")), F.col("source").eqNullSafe(F.col("s")) & (F.col("at") == F.col("p"))).drop("s", "p", "at")
        sums = inside.filter("size > 0").groupBy("source", _digit(level).alias("bucket")).agg(F.sum("size").alias("mass"))
        upto = Window.partitionBy("source").orderBy("bucket")
        sums = sums.withColumn("upto", F.sum("mass").over(upto))
        sums = _with(sums, edge.select(F.col("source").alias("s"), "left"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        last = level == LEVELS - 1
        # The bucket in which the budget ends; at the last level it is taken if that comes nearer to the target.
        over = F.col("upto") - F.col("mass") / 2 > F.col("left") if last else F.col("upto") > F.col("left")
        found = sums.filter(over).groupBy(F.col("source").alias("f")).agg(F.min(F.struct("bucket", (F.col("upto") - F.col("mass")).alias("under"))).alias("b"))
        edge = edge.join(found, F.col("source").eqNullSafe(F.col("f")), "left")
        # None found: the budget takes every bucket of this level, and the threshold lies after the prefix ("g" follows all digits).
        edge = edge.select("source", "source_size", "target", "whole", F.coalesce(F.col("b.bucket"), F.concat("prefix", F.lit("g"))).alias("prefix"), (F.col("left") - F.coalesce(F.col("b.under"), F.lit(0))).alias("left"))
        edge = written(edge, "mix-edge")
    return edge.withColumnRenamed("prefix", "below")


def _with(big: DataFrame, few: DataFrame, on: Column) -> DataFrame:
    """big joined with a table of one row a source, broadcast where their count allows."""
    return big.join(F.broadcast(few) if few.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else few, on)


def copies(docs: DataFrame, share: float = 1.5, weights: tuple[int, ...] = (5, 2, 1), most: int = 2) -> DataFrame:
    """doc_id, source, size, key, source_size, target and copies: how often each row of docs is taken."""
    sizes = written(sized(docs), "mix-sizes")
    edge = thresholds(sizes, written(targets(sizes, share, weights, most), "mix-targets"))
    edge = edge.withColumnRenamed("source", "s")
    taken = F.when(F.col("size") > 0, F.col("whole") + (F.col("key") < F.col("below")).cast("long")).otherwise(F.col("whole").cast("long"))
    return _with(sizes, edge, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", "size", "key", "source_size", "target", taken.alias("copies"))


def mix_sources(docs: DataFrame, **kw) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken (words, repeats counted)."""
    return copies(docs, **kw).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, share: float = 1.5, weights: tuple[int, ...] = (5, 2, 1), most: int = 2) -> DataFrame:
    """The rows of docs that the mix takes, each as often as it is taken. docs is read again, its rows are not shuffled."""
    sizes = written(sized(docs), "mix-sizes")
    edge = thresholds(sizes, written(targets(sizes, share, weights, most), "mix-targets")).select(F.col("source").alias("s"), "whole", "below")
    some = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    row = docs.select(F.struct("*").alias("row"), F.col("source").alias("of"), hash_digits().alias("key"), some.alias("some"))
    row = _with(row, edge, F.col("of").eqNullSafe(F.col("s")))
    times = (F.col("whole") + (F.col("some") & (F.col("key") < F.col("below"))).cast("long")).cast("int")
    return row.select("row", F.explode(F.array_repeat(F.lit(0), times))).select("row.*")
