"""What depends on time: TTL caches as as-of lookups, circuit breakers and token buckets as ordered folds, cache keys.

Time is a column, never the wall clock, so a rerun gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Seconds of a suspension and its cap, doublings at most; seconds that a value stays promoted.
SUSPEND, SUSPEND_MOST, DOUBLINGS, PROMOTED = 30, 600, 8, 300


def cache_hits(puts: DataFrame, gets: DataFrame, by: str = "cache_key") -> DataFrame:
    """gets with the value of the last put before them that has not expired (a TTL of 0 never does), null for a miss. Of puts
    at one instant that of the greatest `seq` counts, if they have one.

    One window over puts and gets of a key carries the last put along: no join of every get with every put.
    """
    seq = F.col("seq").cast("long") if "seq" in puts.columns else F.lit(0).cast("long")
    p = puts.select(by, F.col("put_at").alias("at"), F.lit(0).alias("get"), seq.alias("seq"), F.struct("value", "ttl_seconds", "put_at").alias("put"), F.lit(None).cast("long").alias("get_id"))
    g = gets.select(by, F.col("get_at").alias("at"), F.lit(1).alias("get"), F.lit(0).cast("long").alias("seq"), F.lit(None).cast(p.schema["put"].dataType).alias("put"), "get_id")
    w = Window.partitionBy(by).orderBy("at", "get", "seq", "get_id").rowsBetween(Window.unboundedPreceding, 0)
    r = p.unionByName(g).withColumn("last", F.last("put", ignorenulls=True).over(w)).filter("get = 1")
    age = F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.col("last.put_at").cast("timestamp"))
    live = F.col("last").isNotNull() & ((F.col("last.ttl_seconds") == 0) | (age < F.col("last.ttl_seconds") * 1_000_000))
    return r.select("get_id", by, F.when(live, F.col("last.value")).alias("value"))


def folded(rows: DataFrame, by: str, order: list[str], start: tuple, step: Callable, out: dict[str, pa.DataType]) -> DataFrame:
    """Rows of each key through step(state, row) -> (state, what the row gives or None), in order. rows: by, then the columns
    that step takes.

    Spark deals the keys out and sorts, with spill; a task keeps one state and no rows, however many a key has.
    """
    names = [by, *out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = object(), start
        for batch in batches:
            given: list[tuple] = []
            for k, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if k != key:
                    key, state = k, start
                state, made = step(state, row)
                if made is not None:
                    given.append((k, *made))
            types = [batch.schema.field(0).type, *out.values()]
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in given], t) for i, t in enumerate(types)], names)

    kinds = {pa.int64(): "long", pa.float64(): "double", pa.string(): "string"}
    schema = ", ".join([f"{by} {rows.schema[by].dataType.simpleString()}", *(f"{n} {kinds[t]}" for n, t in out.items())])
    return rows.repartition(by).sortWithinPartitions(by, *order).mapInArrow(run, schema)


def _micros(at: str) -> Column:
    return F.unix_micros(F.col(at).cast("timestamp"))


def tiered_hits(local: DataFrame, shared: DataFrame, gets: DataFrame, by: str = "cache_key") -> DataFrame:
    """by, get_id, value, level: from the first tier, else from the second; a value found there is put into the first for five
    minutes. What a get finds depends on the gets before it: an ordered fold. Puts come before gets of the same instant."""
    none = F.lit(None).cast("long")

    def puts(rows: DataFrame, kind: int) -> DataFrame:
        seq = F.col("seq").cast("long") if "seq" in rows.columns else F.lit(0).cast("long")
        return rows.select(by, _micros("put_at").alias("at"), F.lit(kind).alias("kind"), seq.alias("seq"), F.col("value").cast("string").alias("value"), (F.col("ttl_seconds") * 1_000_000).cast("long").alias("ttl"))

    asked = gets.select(by, _micros("get_at").alias("at"), F.lit(2).alias("kind"), F.col("get_id").cast("long").alias("seq"), F.lit(None).cast("string").alias("value"), none.alias("ttl"))

    def live(entry: tuple | None, at: int) -> bool:
        return entry is not None and (entry[1] is None or at < entry[1])

    def step(state: tuple, row: list) -> tuple:
        (one, two), (at, kind, seq, value, ttl) = state, row
        if kind < 2:
            entry = value, (at + ttl if ttl else None)
            return ((entry, two) if kind == 0 else (one, entry)), None
        if live(one, at):
            return state, (seq, one[0], "first")
        if live(two, at):
            return ((two[0], at + PROMOTED * 1_000_000), two), (seq, two[0], "second")
        return state, (seq, None, "miss")

    rows = puts(local, 0).unionByName(puts(shared, 1)).unionByName(asked)
    return folded(rows, by, ["at", "kind", "seq"], (None, None), step, {"get_id": pa.int64(), "value": pa.string(), "level": pa.string()})


def suspension(errors: Column) -> Column:
    """Seconds of suspension after so many errors in a row."""
    return F.least(F.lit(SUSPEND_MOST), (F.lit(SUSPEND) * F.pow(F.lit(2), F.least(errors - 1, F.lit(DOUBLINGS)))).cast("int"))


def error_streaks(calls: DataFrame, by: str, order: list[str], failed: Column) -> DataFrame:
    """calls with streak (errors in a row up to and with this call, 0 after a success) and the suspension that it causes."""
    w = Window.partitionBy(by).orderBy(*order)
    c = calls.withColumn("_run", F.sum((~failed).cast("int")).over(w))
    c = c.withColumn("streak", F.when(failed, F.sum(failed.cast("int")).over(Window.partitionBy(by, "_run").orderBy(*order))).otherwise(0)).drop("_run")
    return c.withColumn("suspend_s", F.when(F.col("streak") > 0, suspension(F.col("streak"))).otherwise(0))


def backend_calls(calls: DataFrame, timeout_s: float = 0) -> DataFrame:
    """calls (status, error, took_s, cancelled) with `failed` and `cancelled` as a breaker before a backend counts them.

    An error, a call over the time-out (0: none) and an answer without a status are failures; that a place was not found is
    none. Errors of a caller who had given up are not charged to the backend.
    """
    late = F.coalesce(F.col("took_s") > timeout_s, F.lit(False)) if timeout_s > 0 else F.lit(False)
    wrong = F.col("error").isNotNull() | late
    return calls.withColumns({"failed": wrong | F.col("status").isNull(), "cancelled": wrong & F.coalesce("cancelled", F.lit(False))})


def breaker(calls: DataFrame, by: str, at: str, failed: str, cancelled: str | None = None) -> DataFrame:
    """(by, seq, outcome): each call through a circuit breaker, suspended while an earlier error's suspension lasts.

    A suspended call does not reach the provider, so what later calls meet depends on it: an ordered fold. A call for which
    `cancelled` holds counts neither as an error nor as a success.
    """

    def step(state: tuple, row: list) -> tuple:
        (errors, until), (at, seq, failed, cancelled) = state, row
        if at < until:
            return state, (seq, "suspended")
        if cancelled:
            return state, (seq, "cancelled")
        if not failed:
            return (0, -1), (seq, "success")
        wait = min(SUSPEND_MOST, SUSPEND * 2 ** min(errors, DOUBLINGS))
        return (errors + 1, at + wait * 1_000_000), (seq, "error")

    flags = [(F.coalesce(F.col(f), F.lit(False)) if f else F.lit(False)).alias(n) for f, n in ((failed, "failed"), (cancelled, "cancelled"))]
    rows = calls.select(by, _micros(at).alias("at"), F.col("seq").cast("long").alias("seq"), *flags)
    return folded(rows, by, ["at", "seq"], (0, -1), step, {"seq": pa.int64(), "outcome": pa.string()})


def throttled(calls: DataFrame, by: str, at: str, per_second: float, burst: int) -> DataFrame:
    """(by, seq, start_s): when each call may start under a token bucket: an ordered fold."""

    def step(state: tuple, row: list) -> tuple:
        (tokens, seen), (at, seq) = state, row
        now = max(at / 1_000_000, seen)
        have = tokens if seen < 0 else min(float(burst), tokens + (now - seen) * per_second)
        wait = max(0.0, (1 - have) / per_second)
        return (have + wait * per_second - 1, now + wait), (seq, now + wait)

    rows = calls.select(by, _micros(at).alias("at"), F.col("seq").cast("long").alias("seq"))
    return folded(rows, by, ["at", "seq"], (float(burst), -1.0), step, {"seq": pa.int64(), "start_s": pa.float64()})


def once_each(requests: DataFrame, keys: list[str]) -> DataFrame:
    """Equal requests in flight are one."""
    return requests.dropDuplicates(keys)


def seed_print(*fields: Column) -> Column:
    """A short stable hash of the operator's values, "none" if all are empty. Values are quoted as plain ASCII texts are."""
    empty = F.concat(*[F.coalesce(f, F.lit("")) for f in fields]) == ""
    quoted = F.concat_ws("|", *[F.concat(F.lit('"'), F.replace(F.replace(F.coalesce(f, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')) for f in fields])
    return F.when(empty, "none").otherwise(F.substring(F.sha2(quoted, 256), 1, 16))


def cache_key(url: Column, name: Column, seed: Column, skip_maps: Column, version: str = "v1", strict: Column | None = None) -> Column:
    """A record's identity in the cache: its URL (else its name), its seed, whether maps were skipped. City, mode and limits
    are no part of it, as they are none of the format's; `strict` adds what else tells records apart."""
    u = F.coalesce(url, F.lit(""))
    base = F.when(u == "", F.concat(F.lit(f"item:search:{version}:"), name)).otherwise(F.concat(F.lit(f"item:{version}:"), u))
    key = F.concat(base, F.lit(":seed:"), seed, F.when(skip_maps, ":nomaps").otherwise(""))
    return key if strict is None else F.concat(key, F.lit(":"), strict)
