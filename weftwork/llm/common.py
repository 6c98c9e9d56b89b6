"""What the training-data operators share: the shared folder, byte-level word helpers, batch slicing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: A table is broadcast only if it was counted and has at most this many rows (each a few dozen bytes).
BROADCAST_ROWS = 20_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
LOWER_TABLE = _LOWER.tobytes()
#: Which bytes are part of a word: all but ASCII white space; or ASCII letters and bytes over 0x7F alone; or these and digits.
INK = np.ones(256, dtype=bool)
INK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
LETTERS = np.zeros(256, dtype=bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
LETTERS_DIGITS = LETTERS.copy()
LETTERS_DIGITS[48:58] = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session without one gets a temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="weftwork-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts the lineage and survives lost executors."""
    at = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the bound, else as it is (AQE then splits skewed joins)."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def doc_crc(doc_id):
    """crc32 of doc_id written as text; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(start, stop) of runs of rows with at most so many bytes of text, one row at least."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield at, to
        at = to


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after the other, and where each begins (with the end at last). Null is empty."""
    texts = pa.compute.fill_null(texts, "").cast(pa.large_string())
    _, at, data = texts.buffers()
    at = np.frombuffer(at, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return data, at - at[0]


def ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All whole numbers from each start to its end, one run after the other."""
    n = ends - starts
    return np.repeat(starts - np.cumsum(n) + n, n) + np.arange(n.sum())


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**j and its inverse modulo 2**64, for j up to n."""
    if len(_POWERS.get("up", ())) <= n:
        n = max(n + 1, 1 << 20)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n + 1, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[key] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def words(data: np.ndarray, at: np.ndarray, ink_bytes: np.ndarray = INK, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word of the texts begins and ends, and at which word each text begins (with the end at last).

    Words also end at `cuts`, places in data.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    ink = ink_bytes[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[at] = True
    if cuts is not None:
        edge[cuts] = True
    before = np.empty_like(ink)
    before[0], before[1:] = False, ink[:-1]
    begins = np.flatnonzero(ink & (~before | edge[:-1]))
    after = np.empty_like(ink)
    after[-1], after[:-1] = False, ink[1:]
    ends = np.flatnonzero(ink & (~after | edge[1:])) + 1
    return begins, ends, np.searchsorted(begins, at)


def word_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word with A-Z lowered."""
    if not len(begins):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(np.uint64))
