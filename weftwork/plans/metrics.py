"""What an enrichment did, as counts: observed while its rows pass, or as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from weftwork.operators.resolve import RANK
from weftwork.plans.enrich import LEGS

SOURCES = tuple(RANK)


def _times(cond: Column, name: str) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False))).alias(name)


def observed(enriched: DataFrame, into: Observation) -> DataFrame:
    """enriched, unchanged; once an action has run, into.get has the counts of records, cache hits and misses, of each leg's
    events (`LEGS`: failed fetches, renders by reason, failed and skipped ones, contacts pages found and used, blocked targets,
    conflicts), plain-HTTP fallbacks, and of each source that gave the phone. Cached records did nothing."""
    hit = F.col("cache_hit") if "cache_hit" in enriched.columns else F.lit(False)
    by_source = [_times(F.col("phone_source") == s, f"phone_{s}") for s in SOURCES]
    went = [F.coalesce(F.sum(F.when(~hit, F.col(f"legs.{c}"))), F.lit(0)).alias(c) for c in LEGS]
    return enriched.observe(into, F.count(F.lit(1)).alias("records"), _times(hit, "cache_hits"), _times(~hit, "cache_misses"), _times(F.col("tls_fallback_used"), "tls_fallback"), *went, *by_source)


def totals(enriched: DataFrame) -> DataFrame:
    """(metric, n): the records and the sum of each leg's events."""
    sums = enriched.agg(F.count(F.lit(1)).alias("records"), *[F.coalesce(F.sum(f"legs.{c}"), F.lit(0)).cast("long").alias(c) for c in LEGS])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("n")) for c in ("records", *LEGS)])).alias("m")).select("m.*")


def phone_sources(enriched: DataFrame) -> DataFrame:
    """(phone_source, records) of records with a phone."""
    return enriched.filter("phone is not null").groupBy("phone_source").agg(F.count(F.lit(1)).alias("records"))
