"""Conflicting values of one record by a fixed priority of sources, with provenance and confidence.

Every candidate value is a claim (item_pos, field, value, source, seq, confidence); a pick is one ordered aggregate over the
claims of (item_pos, field). Among claims of equal rank the last wins, but the longer one for `address` and the first one for
`place_type` and `event_date`; a poison verdict is
a claim on the phone without a value, which outranks sites but not the operator, and comes too late after a site's phone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.functions import patterns as P

RANK = {name: i for i, name in enumerate(P.SOURCES)}
POISON = RANK["poison_lock"]
LONGER, FIRST = ("address",), ("place_type", "event_date")


def rank_of(source: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv]), source), F.lit(0))


def confidence(source: Column, rich_card: Column | None = None) -> Column:
    """high for the operator and official sites, medium for a map card with phone and website, low for the rest."""
    card = F.lit(False) if rich_card is None else F.coalesce(rich_card, F.lit(False))
    return F.when(source.isin("operator_verified", "official_site"), "high").when((source == "maps") & card, "medium").otherwise("low")


def claims(facts: DataFrame, source: str, seq: int, fields: list[str], rich_card: Column | None = None) -> DataFrame:
    """A row for each non-empty field of a table of facts (item_pos, fields...)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    rows = facts.select("item_pos", (confidence(F.lit(source), rich_card)).alias("confidence"), pairs.alias("p"))
    return rows.select("item_pos", "p.field", "p.value", F.lit(source).alias("source"), F.lit(seq).alias("seq"), "confidence").filter("value is not null and value != ''")


def poison(items: DataFrame, seq: int) -> DataFrame:
    """Poison verdicts on the phones of items (item_pos)."""
    return items.select("item_pos", F.lit("phone").alias("field"), F.lit(None).cast("string").alias("value"), F.lit("poison_lock").alias("source"), F.lit(seq).alias("seq"), F.lit("low").alias("confidence"))


def resolve(rows: DataFrame, keys: tuple[str, ...] = ("item_pos", "field")) -> DataFrame:
    """(keys, value, source, confidence, poisoned): the winner of each field. One shuffle; partial maxima on the map side.

    Poison verdicts with a claim of a site or the operator before them are dropped first; that takes only the least seq of
    such claims, summed in the same way.
    """
    c = rows.withColumn("rank", rank_of(F.col("source")))
    strong = F.min(F.when((F.col("rank") >= RANK["official_site"]) & (F.col("rank") != POISON), F.col("seq")))
    longer = F.col("field").isin(*LONGER) & (F.col("rank") == RANK["official_site"])
    first = longer | F.col("field").isin(*FIRST)
    order = F.struct("rank", F.when(longer, F.length("value")).otherwise(0).alias("a"), F.when(first, -F.col("seq")).otherwise(F.col("seq")).alias("b"))
    value = F.struct("value", "source", "confidence")
    plain, verdict = F.col("rank") != POISON, F.col("rank") == POISON
    g = c.groupBy(*keys).agg(
        strong.alias("strong"),
        F.min(F.when(verdict, F.col("seq"))).alias("poison"),
        F.max(F.when(plain, F.struct(order.alias("o"), value.alias("v")))).alias("best"),
    )
    holds = F.col("poison").isNotNull() & (F.col("strong").isNull() | (F.col("poison") < F.col("strong")))
    operator = F.coalesce(F.col("best.o.rank") == RANK["operator_verified"], F.lit(False))
    locked = holds & ~operator
    return g.select(*keys, F.when(~locked, F.col("best.v.value")).alias("value"), F.when(locked, "poison_locked").otherwise(F.col("best.v.source")).alias("source"), F.when(locked, "low").otherwise(F.col("best.v.confidence")).alias("confidence"), holds.alias("poisoned"))


def conflicts(rows: DataFrame, keys: tuple[str, ...] = ("item_pos", "field")) -> DataFrame:
    """(keys, conflicts): how often, in order of seq, a claim met another value from another source than the owner's, or a
    verdict took a value of lower rank away."""
    c = rows.withColumn("rank", rank_of(F.col("source"))).filter((F.col("value").isNotNull()) | (F.col("rank") == POISON))
    g = c.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", "rank", "value"))).alias("all"))
    start = F.struct(F.lit(None).cast("string").alias("value"), F.lit(0).alias("rank"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        verdict, site = x.rank == POISON, acc.rank >= RANK["official_site"]
        meets = acc.value.isNotNull() & (acc.rank > 0) & (x.rank > 0) & F.when(verdict, ~site).otherwise((acc.value != x.value) & (x.rank != acc.rank))
        wins = (x.rank >= acc.rank) & ~(verdict & site)
        return F.struct(F.when(wins, x.value).otherwise(acc.value).alias("value"), F.when(wins, x.rank).otherwise(acc.rank).alias("rank"), (acc.n + F.coalesce(meets, F.lit(False)).cast("int")).alias("n"))

    return g.select(*keys, F.aggregate("all", start, step).n.alias("conflicts"))


def provenance(resolved: DataFrame, fields: list[str]) -> DataFrame:
    """One row an item: each field's value, source and confidence. A locked phone keeps its provenance without a value."""
    agg = [F.max(F.when(F.col("field") == f, F.col(c))).alias(f if c == "value" else f"{f}_{c}") for f in fields for c in ("value", "source", "confidence")]
    return resolved.groupBy("item_pos").agg(*agg, F.coalesce(F.max(F.when(F.col("field") == "phone", F.col("poisoned"))), F.lit(False)).alias("phone_poisoned"))


def closed_status(site_status: Column, maps_status: Column, fetched: Column) -> Column:
    """A map's verdict, `closed` for a permanent one, stands unless the record's own site was fetched and is active."""
    closed = F.when(maps_status == "permanently_closed", "closed").when(maps_status == "temporarily_closed", "temporarily_closed")
    live = fetched & (F.coalesce(site_status, F.lit("")) == "active")
    return F.when(closed.isNotNull() & ~live, closed).otherwise(site_status)


def number_lists(numbers: DataFrame, membership: Column | None = None) -> DataFrame:
    """(item_pos, numbers) from the numbers of all pages of an item (item_pos, page_ord, place, key, value, source, trustworthy,
    anchored, dni, role, role_label_raw, and what membership asks for).

    Of several readings of a number the strongest counts, trust before anchor, first page first; but it is general if any
    reading is, with the first general reading's label. One aggregate by (item, number): maxima and minima that any number of
    partial readings can be merged into. The list goes by strength, then by digits.
    """
    member = membership if membership is not None else F.lit(None).cast("struct<match: boolean, foreign: boolean>")
    rank = F.col("trustworthy").cast("int") * 2 + F.col("anchored").cast("int")
    place = F.struct("page_ord", "place")
    best = F.min_by(F.struct("value", "source", "trustworthy", "anchored", "dni", "role", F.col("role_label_raw").alias("label"), "m.match", "m.foreign", rank.alias("rank")), F.struct((-rank).alias("r"), place.alias("p")))
    general = F.min(F.when(F.col("role") == "", F.struct(place.alias("p"), F.col("role_label_raw").alias("label"))))
    g = numbers.withColumn("m", member).filter("key != ''").groupBy("item_pos", "key").agg(best.alias("b"), general.alias("g"))
    label = F.when(F.col("g").isNotNull(), F.col("g.label")).otherwise(F.col("b.label"))
    number = F.struct("b.value", "b.source", "b.trustworthy", "b.anchored", "b.dni", F.when(F.col("g").isNotNull(), "").otherwise(F.col("b.role")).alias("role"), label.alias("role_label_raw"), "b.match", "b.foreign")
    rows = F.array_sort(F.collect_list(F.struct((-F.col("b.rank")).alias("r"), "key", number.alias("n"))))
    return g.groupBy("item_pos").agg(F.transform(rows, lambda x: x.n).alias("numbers"))


def legal_against_venue(rows: DataFrame) -> DataFrame:
    """(item_pos, legal_vs_venue): how many of a site's registered seats met another address that was there before."""
    c = rows.filter(F.col("field").isin("address", "legal_address"))
    venue = F.collect_list(F.when(F.col("field") == "address", F.struct("seq", "value")))
    seats = F.collect_list(F.when(F.col("field") == "legal_address", F.struct("seq", "value")))
    g = c.groupBy("item_pos").agg(venue.alias("venues"), seats.alias("seats")).filter(F.size("seats") > 0)
    met = F.filter("seats", lambda s: F.exists("venues", lambda v: (v.seq <= s.seq) & (v.value != s.value)))
    return g.select("item_pos", F.size(met).alias("legal_vs_venue"))
