"""Operators over streams: the news store kept batch by batch, breakers and caches that outlive a batch. The batch forms are in
operators.news and operators.state."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from weftwork.operators import news
from weftwork.operators.state import DOUBLINGS, SUSPEND, SUSPEND_MOST
from weftwork.sources.store import Store


def news_store(spark: SparkSession, path: str) -> Store:
    """The news store: the entry of a URL as the last batch that named it left it."""
    return Store(spark, path, ("url",), "rev", "gone")


def news_upsert(store: Store, name: str) -> Callable[[DataFrame, int], None]:
    """What a stream's foreachBatch calls with a batch of actions (`news.folded`) and its number.

    The store knows batches by the stream's name and number, so a batch that is replayed after a failure changes nothing.
    """

    def upsert(actions: DataFrame, number: int) -> None:
        if f"{name}-{number}" in store.manifest()["known"]:
            return
        after = news.folded(store.read(), actions).filter("had or entry is not null")
        rows = after.select("url", "entry.*", F.col("entry").isNull().alias("gone"), F.lit(number).cast("long").alias("rev"))
        store.put(rows, f"{name}-{number}")

    return upsert


class _Breaker(StatefulProcessor):
    def __init__(self, by: str) -> None:
        self.by = by

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("breaker", "errors int, until double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        errors, until = self.state.get() if self.state.exists() else (0, -1.0)
        calls = pd.concat(list(rows)).sort_values(["at_s", "seq"])
        outcomes = []
        for at, failed in zip(calls.at_s, calls.failed):
            if at < until:
                outcomes.append("suspended")
                continue
            errors = errors + 1 if failed else 0
            until = at + min(SUSPEND_MOST, SUSPEND * 2 ** min(errors - 1, DOUBLINGS)) if failed else -1.0
            outcomes.append("error" if failed else "success")
        if errors:
            self.state.update((errors, float(until)))
        else:
            self.state.clear()
        yield pd.DataFrame({self.by: key[0], "seq": calls.seq, "outcome": outcomes})

    def close(self) -> None:
        pass


class _Cache(StatefulProcessor):
    def __init__(self, by: str) -> None:
        self.by = by

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entry = handle.getValueState("entry", "value string, until double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        entry = tuple(self.entry.get()) if self.entry.exists() else None
        found = []
        for r in pd.concat(list(rows)).sort_values(["at_s", "is_get", "seq"]).itertuples():
            if not r.is_get:
                entry = (None if pd.isna(r.value) else r.value, r.at_s + r.ttl_s if r.ttl_s > 0 else math.inf)
                continue
            if entry and r.at_s >= entry[1]:
                entry = None
            found.append((key[0], r.seq, entry[0] if entry else None))
        if entry:
            self.entry.update(entry)
        else:
            self.entry.clear()
        yield pd.DataFrame(found, columns=[self.by, "seq", "value"])

    def close(self) -> None:
        pass


def _stateful(rows: DataFrame, by: str, processor: StatefulProcessor, out: str) -> DataFrame:
    kind = rows.schema[by].dataType.simpleString()
    return rows.groupBy(by).transformWithStateInPandas(processor, f"{by} {kind}, seq long, {out} string", "append", "None")


def breaker(calls: DataFrame, by: str = "provider") -> DataFrame:
    """(by, seq, outcome) of a stream of calls (by, seq, at_s, failed): each provider's errors in a row and the end of its
    suspension are kept from batch to batch; a provider without errors keeps no state.

    A batch's calls of one provider are put in order in memory: the source's limit of rows a batch bounds them. This and
    `cached` need the state store to be RocksDB (spark.sql.streaming.stateStore.providerClass).
    """
    return _stateful(calls, by, _Breaker(by), "outcome")


def cached(rows: DataFrame, by: str = "cache_key") -> DataFrame:
    """(by, seq, value) of the gets in a stream of puts and gets (by, seq, at_s, is_get, value, ttl_s), null for a miss.

    A put replaces the entry; one with a ttl_s of 0 never ends; an entry that a get finds expired is deleted. Puts come before
    gets of the same instant. Times are those of the rows, so reruns give the same values.
    """
    return _stateful(rows, by, _Cache(by), "value")
