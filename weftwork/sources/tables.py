"""What a crawler or client left behind, as tables: fetches, search results, map cards, the news store and its config.

The engine makes no network calls. A fetch is a row; retries are rows of one URL with an attempt number; a plain-HTTP retry
after a failed certificate is one more row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftwork.functions import urls
from weftwork.sources.results import results_udf

#: Bytes of a body that are kept.
BODY = 2_000_000
TRANSIENT = (0, 502, 503, 504, 429)

NEWS = "news_id string, project string, url string, title string, snippet string, source string, topic string, score int, engine_count int, discovered_at string, status string"
NEWS_CONFIG = (
    "projects map<string, struct<queries: array<struct<q: string, topic: string, engines: string, categories: string, time_range: string>>, "
    "taboo_words: array<string>, positive_words: array<string>, good_sources: array<string>, city_names: array<string>, rival_cities: array<string>>>"
)


def page_status(url: Column, final_url: Column, code: Column) -> Column:
    """A redirect to another host, a missing page, an unreachable one, or an active one."""
    moved = F.coalesce(urls.host_port(final_url) != urls.host_port(url), F.lit(False)) & (F.coalesce(final_url, F.lit("")) != "")
    return F.when(code.isNull() | (code == 0), "unreachable").when(moved, "redirect").when(code == 404, "not_found").when(code >= 400, "unreachable").otherwise("active")


def is_transient(status: Column, code: Column) -> Column:
    return (status == "unreachable") & F.coalesce(code, F.lit(0)).isin(*TRANSIENT)


def classified(fetches: DataFrame) -> DataFrame:
    """fetches (url, attempt, html, status_code, final_url, tls_error) with status and transient, the body capped by bytes.

    A letter that the cap cuts through goes. A certificate error is a status of its own.
    """
    cut = F.regexp_replace(F.make_valid_utf8(F.substring(F.encode("html", "UTF-8"), 1, BODY).cast("string")), "\uFFFD$", "")
    body = F.when(F.octet_length("html") <= BODY, F.col("html")).otherwise(cut)
    status = F.when(F.coalesce("tls_error", F.lit(False)), "tls_invalid").otherwise(page_status(F.col("url"), F.col("final_url"), F.col("status_code")))
    out = fetches.withColumn("status", status).withColumn("html", body)
    return out.withColumn("transient", is_transient(F.col("status"), F.col("status_code")))


def settled(fetches: DataFrame) -> DataFrame:
    """One row a URL: its first attempt that was not transient, else its last; equal calls collapse.

    After a certificate error a row of the same https URL without one is the plain-HTTP retry: it counts if it reached a page
    (`tls_fallback_used`); if it did not, or there is none, the status is `tls_invalid`.
    """
    c = classified(fetches)
    bad = F.coalesce("tls_error", F.lit(False))
    failed = F.max(bad).over(Window.partitionBy("url")) & F.col("url").startswith("https:")
    c = c.withColumns({"_failed": failed, "_bad": bad}).withColumn("_useless", F.col("_bad") | (F.col("_failed") & (F.col("status") == "unreachable")))
    rank = F.struct(F.col("_useless"), F.when(F.col("transient"), 1).otherwise(0), F.when(F.col("transient"), -F.col("attempt")).otherwise(F.col("attempt")))
    best = c.withColumn("_rn", F.row_number().over(Window.partitionBy("url").orderBy(rank))).filter("_rn = 1")
    invalid = F.col("_failed") & F.col("_useless")
    return best.withColumns({"status": F.when(invalid, "tls_invalid").otherwise(F.col("status")), "tls_fallback_used": F.col("_failed") & ~F.col("_useless")}).drop("_rn", "_failed", "_bad", "_useless")


# Where engines that answer with a page keep it.
RESULT_PAGES = {"ddg": "https://html.duckduckgo.com/html/", "startpage": "https://www.startpage.com/sp/search"}


def searched(raw: DataFrame, provider: str, order: int = 0) -> DataFrame:
    """search_results rows (query, provider, provider_ord, pos, url, title, snippet) from raw payloads (query, payload).

    Payloads of ddg and startpage are result pages, those of proxy envelopes with a page of ddg in them; the others are JSON.
    """
    named = [F.lit(provider).alias("provider"), F.lit(order).alias("provider_ord")]
    if provider == "proxy":
        return searched(unwrapped(raw).select("query", F.col("body").alias("payload")), "ddg", order).withColumn("provider", F.lit("proxy"))
    if provider in RESULT_PAGES:
        rows = raw.withColumn("r", results_udf(RESULT_PAGES[provider])("payload")).select("query", F.posexplode("r").alias("pos", "r"))
        return rows.select("query", *named, "pos", "r.url", "r.title", "r.snippet")
    schema, path, link, snippet = {
        "brave": ("struct<web: struct<results: array<struct<url: string, title: string, description: string>>>>", ("web", "results"), "url", "description"),
        "google": ("struct<items: array<struct<link: string, title: string, snippet: string>>>", ("items",), "link", "snippet"),
        "searxng": ("struct<results: array<struct<url: string, title: string, content: string>>>", ("results",), "url", "content"),
    }[provider]
    found = F.from_json("payload", schema)
    for part in path:
        found = found.getField(part)
    rows = raw.select("query", F.posexplode(found).alias("pos", "r"))
    return rows.select("query", *named, "pos", F.col(f"r.{link}").alias("url"), "r.title", F.col(f"r.{snippet}").alias("snippet"))


def links(rows: DataFrame, most: int) -> DataFrame:
    """(query, place, url, title): the first addresses and titles of each query's results, for lookups that need no more."""
    w = Window.partitionBy("query").orderBy("provider_ord", "pos")
    return rows.filter("coalesce(url, '') != ''").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).select("query", "place", "url", "title")


def unwrapped(proxied: DataFrame) -> DataFrame:
    """Bodies out of a fetch proxy's envelopes {body, status, error}: only those of status 200 without an error."""
    e = F.from_json("payload", "struct<body: string, status: int, error: string>")
    return proxied.withColumn("e", e).filter("e.status = 200 and coalesce(e.error, '') = ''").withColumn("body", F.col("e.body")).drop("e", "payload")


def read_news(spark: SparkSession, path: str) -> DataFrame:
    """A project's news file: an array of entries, or an envelope {"items": [...]}; an empty table if there is none."""
    entries = f"array<struct<{', '.join(f'{c.split()[0]}: {c.split()[1]}' for c in NEWS.split(', '))}>>"
    try:
        text = spark.read.text(path, wholetext=True)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], NEWS)
        raise
    bare, wrapped = F.from_json("value", entries), F.from_json("value", f"struct<items: {entries}>")["items"]
    rows = F.when(F.ltrim(F.col("value")).startswith("["), bare).otherwise(wrapped)
    return text.select(F.explode(rows).alias("r")).select("r.*")


def write_news(entries: DataFrame, path: str) -> None:
    """The store, a folder a project; the committer swaps each in as a whole."""
    entries.write.partitionBy("project").mode("overwrite").option("partitionOverwriteMode", "dynamic").json(path)


def read_news_config(spark: SparkSession, path: str) -> DataFrame:
    """A row a project of a config file; none if it has no projects."""
    rows = spark.read.schema(NEWS_CONFIG).json(path, multiLine=True)
    return rows.select(F.explode("projects").alias("project", "c")).select("project", "c.*")
