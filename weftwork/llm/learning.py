"""Bounded samples of labelled rows for the operators that learn; everything else in them covers all data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled(docs: DataFrame, labels: DataFrame, label: str, usable: Column, bound: int) -> DataFrame:
    """(doc_id, text, y): documents whose label is known and usable, at most `bound` of them, chosen by a hash of doc_id.

    usable is over doc_id. Labels that repeat are averaged (half counts as 1); rows with a null doc_id or label teach nothing.
    The chosen ids are at most `bound`, so they are broadcast; the sample is the same at every run.
    """
    known = labels.select("doc_id", F.col(label).alias("y")).filter(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & usable)
    known = known.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
