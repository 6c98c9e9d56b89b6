"""Search results: building queries, removing repeats, merging and falling back between providers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftwork.functions import patterns as P
from weftwork.functions.urls import normal_url

#: Results of a provider at most; pages that are read for a record without one of its own.
RESULTS, PAGES = 8, 5


def query(mode: Column, name: Column, city: Column, year: int) -> Column:
    """struct(query, time_range) by mode: 0 news of the week, 1 places, 2 events of the month and year."""
    town = F.nullif(city, F.lit(""))
    q = F.when(mode == 1, F.concat_ws(" ", name, town)).when(mode == 2, F.concat_ws(" ", name, town, F.lit(str(year)))).otherwise(name)
    return F.struct(q.alias("query"), F.when(mode == 1, "").when(mode == 2, "month").otherwise("week").alias("time_range"))


def with_sites(q: Column, sites: list[str]) -> Column:
    """A query restricted to some sites."""
    return F.concat(q, F.lit(" " + " OR ".join(f"site:{s}" for s in sites))) if sites else q


def time_code(time_range: Column, provider: str) -> Column:
    codes = F.create_map(*[F.lit(x) for kv in P.TIME_RANGES[provider].items() for x in kv])
    return F.coalesce(F.try_element_at(codes, time_range), F.lit(""))


def line(title: Column, snippet: Column) -> Column:
    """A result's part of the context; null for one without title and snippet."""
    t, s = F.nullif(title, F.lit("")), F.nullif(snippet, F.lit(""))
    return F.when(t.isNotNull() & s.isNotNull(), F.concat(t, F.lit(": "), s)).otherwise(F.coalesce(s, t))


def distinct_results(results: DataFrame, by: list[str], order: list[str], most: int | None = RESULTS) -> DataFrame:
    """results with `place`: the first of each normalised URL, in order, the first `most` of each group."""
    norm = results.withColumn("norm", normal_url(F.col("url"))).filter("norm is not null and norm != ''")
    first = norm.withColumn("_rn", F.row_number().over(Window.partitionBy(*by, "norm").orderBy(*order))).filter("_rn = 1").drop("_rn")
    out = first.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out.filter(F.col("place") <= most) if most else out


def aggregate(results: DataFrame, by: list[str], order: list[str], most: int | None = RESULTS) -> DataFrame:
    """(by, context, sources, n): one row a group, sources in order joined by line ends."""
    kept = distinct_results(results, by, order, most).withColumn("line", line(F.col("title"), F.col("snippet")))
    rows = F.array_sort(F.collect_list(F.struct("place", "url", "line")))
    g = kept.groupBy(*by).agg(rows.alias("r"))
    return g.select(*by, F.array_join(F.filter(F.transform("r", lambda x: x.line), lambda x: x.isNotNull()), "\n\n").alias("context"), F.array_join(F.transform("r", lambda x: x.url), "\n").alias("sources"), F.size("r").alias("n"))


def merged(results: DataFrame, by: list[str]) -> DataFrame:
    """Several providers at once: contexts in the providers' order, sources without repeats, failed providers left out."""
    fine = results.filter("error is null")
    contexts = aggregate(fine, [*by, "provider_ord"], ["pos"]).filter("context != ''")
    joined = contexts.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("provider_ord", "context"))), lambda x: x.context), "\n\n").alias("context"))
    inside = distinct_results(fine, [*by, "provider_ord"], ["pos"])
    sources = aggregate(inside, by, ["provider_ord", "pos"], None).select(*by, "sources", "n")
    return sources.join(joined, by, "full").select(*by, F.coalesce("context", F.lit("")).alias("context"), F.coalesce("sources", F.lit("")).alias("sources"), F.coalesce("n", F.lit(0)).alias("n"))


def fallback(answers: DataFrame, by: list[str]) -> DataFrame:
    """The first provider that answered without an error, be its answer empty; else all errors joined.

    answers: one row a (by, provider_ord), with context and error.
    """
    ok = F.col("error").isNull()
    g = answers.groupBy(*by).agg(
        F.min(F.when(ok, F.struct("provider_ord", "provider", "context"))).alias("a"),
        F.array_sort(F.collect_list(F.when(~ok, F.struct("provider_ord", "error")))).alias("e"),
    )
    errors = F.array_join(F.transform("e", lambda x: x.error), "\n")
    return g.select(*by, F.col("a.provider").alias("provider"), F.col("a.context").alias("context"), F.when(F.col("a").isNull(), errors).alias("error"))


def source_pages(items: DataFrame, sources: DataFrame, pages: DataFrame, most: int = PAGES) -> DataFrame:
    """(item_pos, content, image): the first `most` source pages of each item, joined in order with a rule between them.

    items: item_pos. sources: item_pos, pos, url. pages: url, text, image. A page counts if it has text, whatever its status.
    """
    few = sources.withColumn("place", F.row_number().over(Window.partitionBy("item_pos").orderBy("pos"))).filter(F.col("place") <= most)
    got = items.select("item_pos").join(few, "item_pos").join(pages.dropDuplicates(["url"]), "url").filter("coalesce(text, '') != ''")
    g = got.groupBy("item_pos").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("t"), F.min(F.when(F.col("image").isNotNull(), F.struct("place", "image"))).alias("i"))
    return g.select("item_pos", F.array_join(F.transform("t", lambda x: x.text), "\n\n---\n\n").alias("content"), F.col("i.image").alias("image"))
