"""Operator 9, token counts: delta-maintained rollups with idempotent batch commits.

A log holds signed rows by source, language and tokenizer version: an insert adds a document's counts, a delete takes them
away, and a revision (the text or the tokenizer changed) is a delete of the old count and an insert of the new. Counts are
additive, so each batch is summed before it is committed and totals are the sum of all committed batches. A batch is written
to a new folder first; a row of the log's manifest then names that folder, and only folders that the manifest names count. A
batch that is committed again gets a later row, which takes the place of the earlier one: retries change no total, a crash
before the row leaves all as it was, and readers never see half a batch.

Nulls and edges: a null text has no tokens and no bytes but counts as a document; null sources and languages are groups of
their own; repeated rows each count; groups whose documents are all gone leave the totals; an empty batch commits nothing
and counts as committed.
"""

from __future__ import annotations

import base64
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import arrow_udf

from weftwork.llm.common import WORD, shared_dir

KEYS = ("source", "lang", "tokenizer")
SUMS = ("docs", "tokens", "bytes")
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long, bytes long"
MANIFEST = "batch string, path string, seq long"
#: Where the public vocabularies lie on the driver.
VOCABULARIES = "/opt/tokenizers"

# Fixed value: the split pattern that the byte-level vocabulary was made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(name: str, vocabulary: bytes):
    """The tokenizer of a vocabulary, once a Python worker."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def bpe(spark: SparkSession, name: str = "byte_bpe_50k", folder: str = VOCABULARIES):
    """Column function text -> tokens of a byte-level vocabulary. Whole texts; equal texts of a batch are encoded once.

    The vocabulary lies on the driver and is sent to the executors, under a megabyte.
    """
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())

    @arrow_udf(T.LongType())
    def count(texts: pa.Array) -> pa.Array:
        known = pa.compute.dictionary_encode(pa.compute.fill_null(texts, ""))
        sizes = np.array([len(encoding(name, sent.value).encode_ordinary(t)) for t in known.dictionary.to_pylist()], dtype=np.int64)
        return pa.array(sizes[np.asarray(known.indices)] if len(texts) else sizes)

    return count


def words_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


#: Tokenizer versions by name: a function (session, Column) -> Column of token counts.
TOKENIZERS = {"words-1": lambda spark, text: words_count(text), "byte_bpe_50k-1": lambda spark, text: bpe(spark, "byte_bpe_50k")(text)}


#: A version that is no longer counted: runs of letters and digits.
RETIRED = {"words-0": lambda spark, text: F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{Nd}]+")).cast("long")}


def deltas(docs: DataFrame, *tokenizers: str, sign: int = 1) -> DataFrame:
    """Summed signed counts of docs: one row a (source, lang, tokenizer), whatever the number of documents, which are read once."""
    counts = [(TOKENIZERS | RETIRED)[name](docs.sparkSession, F.col("text")).alias(f"t{i}") for i, name in enumerate(tokenizers)]
    rows = docs.select("source", "lang", F.coalesce(F.octet_length("text"), F.lit(0)).alias("b"), *counts)
    sums = rows.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("b").alias("bytes"), *[F.sum(f"t{i}").alias(f"t{i}") for i in range(len(tokenizers))])
    each = F.array(*[F.struct(F.lit(name).alias("tokenizer"), F.col(f"t{i}").alias("tokens")) for i, name in enumerate(tokenizers)])
    sums = sums.withColumn("e", F.explode(each))
    return sums.select("source", "lang", "e.tokenizer", (F.col("docs") * sign).alias("docs"), (F.col("e.tokens") * sign).alias("tokens"), (F.col("bytes") * sign).cast("long").alias("bytes"))


def revision(old: DataFrame, new: DataFrame, before: tuple[str, ...], after: tuple[str, ...]) -> DataFrame:
    """Deltas of documents that change from old rows under some tokenizer versions to new rows under others."""
    return summed(deltas(old, *before, sign=-1).union(deltas(new, *after)))


def summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(*[F.sum(c).cast("long").alias(c) for c in SUMS])


def commit(rows: DataFrame, log: str, batch: str) -> None:
    """Commits one batch as a whole, in place of an earlier commit of the same name."""
    spark, at = rows.sparkSession, f"{log}/data/{uuid.uuid4().hex}"
    summed(rows).coalesce(1).write.parquet(at)
    last = manifest(spark, log).agg(F.max("seq")).first()[0]
    spark.createDataFrame([(batch, at, 1 + (last or 0))], MANIFEST).coalesce(1).write.mode("append").parquet(f"{log}/manifest")


def manifest(spark: SparkSession, log: str) -> DataFrame:
    """(batch, path, seq): a row a commit. One writer at a time: seq puts commits of one batch in order."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{log}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def totals(spark: SparkSession, log: str) -> DataFrame:
    """The rollup of all committed batches: groups that still hold a document or a count. `compacted` keeps their number small."""
    paths = [r.path for r in manifest(spark, log).groupBy("batch").agg(F.max_by("path", "seq").alias("path")).orderBy("path").collect()]
    if not paths:
        return spark.createDataFrame([], SCHEMA)
    return summed(spark.read.schema(SCHEMA).parquet(*paths)).filter(" or ".join(f"{c} != 0" for c in SUMS))


def compacted(spark: SparkSession, log: str, to: str, batch: str = "all") -> None:
    """A new log whose one batch has the totals of an old one."""
    commit(totals(spark, log), to, batch)


def earlier(docs: DataFrame) -> DataFrame:
    """source, lang, text, draw of documents as they may have been before: a twentieth of the texts is not there yet, of a tenth only the
    first half is, and a twentieth is there once more. What becomes of a text goes by its hash."""
    draw = F.pmod(F.xxhash64(F.coalesce("text", F.lit("")), F.lit("counts")), F.lit(100))
    both = docs.select("source", "lang", "text", draw.alias("draw"))
    half = F.when(F.col("draw") < 15, F.expr("substring(text, 1, cast(char_length(text) div 2 as int))")).otherwise(F.col("text"))
    return both.filter("draw >= 5").withColumn("text", half).union(both.filter("draw >= 95"))


def roll_up(docs: DataFrame, log: str | None = None) -> DataFrame:
    """Rollups of all documents by source, language and tokenizer version, through the log, in two batches.

    load: the documents as they were, counted by a version that is retired since and by those of today. revise: texts that were
    added, texts that changed (their old counts go, their new ones come), copies that were deleted, and all that the retired
    version counted. The totals are those of all documents as they are.
    """
    spark, now = docs.sparkSession, tuple(TOKENIZERS)
    log = log or f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}"
    before = earlier(docs)
    commit(deltas(before, *RETIRED, *now), log, "load")
    draw = F.pmod(F.xxhash64(F.coalesce("text", F.lit("")), F.lit("counts")), F.lit(100))
    both = docs.select("source", "lang", "text", draw.alias("draw"))
    added, gone = deltas(both.filter("draw < 5"), *now), deltas(both.filter("draw >= 95"), *now, sign=-1)
    changed = revision(before.filter("draw < 15"), both.filter("draw >= 5 and draw < 15"), now, now)
    commit(added.union(gone).union(changed).union(deltas(before, *RETIRED, sign=-1)), log, "revise")
    return totals(spark, log)
