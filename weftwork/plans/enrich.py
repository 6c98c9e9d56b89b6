"""The whole enrichment of a table of records from already collected material, as one plan over tables.

Pages are read in two waves, each one parse of one table that is written to the shared folder without the markup. The first
wave holds the homepages, their renders and the pages that a search found for records without a page; the second the contacts
pages that the first has links to, and their renders. What is taken of them is decided per record over the written facts:
renders where a page tells too little and its render tells more, contacts pages that tell more than the homepage. All facts
become claims, and one aggregate by (item, field) picks among them. `enrich_cached` serves records from a store of earlier
results and enriches the others.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftwork.functions import urls, validate
from weftwork.functions.once import built_once
from weftwork.functions.text import truncate
from weftwork.operators import extract, facts, phones, resolve, search, state
from weftwork.sources import dom, tables
from weftwork.sources.shared import shared_path, spread, written  # noqa: F401  (shared_path: for callers)
from weftwork.sources.store import Store

FIELDS = ["place_name", "place_type", "address", "legal_address", "phone", "website", "hours", "price", "email", "event_date"]
SEED = ["place_name", "address", "phone", "website", "hours", "email", "price"]
#: What a page that a search found may say of a record. A registered seat is not among it.
FOUND = [f for f in FIELDS if f != "legal_address"]
META = ["title", "author", "description", "site_name", "language"]
#: A render under so many bytes is an error page.
LEAST_RENDER = 512
#: Counts of what happened to a record, summed by `plans/metrics.py`.
LEGS = ["fetch_error", "render_thin_content", "render_absent_contacts", "render_contacts_page", "render_error", "render_skipped_homepage", "render_skipped_contacts", "contacts_discovered", "contacts_resolved", "site_resolved", "target_blocked", "legal_vs_venue", "conflicts"]


@dataclass(frozen=True)
class Config:
    """most_content: characters of content, 0 for all. search_pages: pages read for a record without one. markdown: whether
    content is markdown, not plain text."""

    most_content: int = 0
    search_pages: int = search.PAGES
    render_skip_disabled: bool = False
    markdown: bool = False


@dataclass(frozen=True)
class Sources:
    """Collected material. fetches: url, attempt, html, status_code, final_url, tls_error. renders: url, html and, it may be,
    attempt. cards: item_pos, status, name, address, phone, website, hours and, it may be, pos, latitude, longitude. results:
    item_pos, pos, url, title, snippet. readability: url, content, title, author, excerpt, one row a url. Any but fetches may
    be None."""

    fetches: DataFrame
    renders: DataFrame | None = None
    cards: DataFrame | None = None
    results: DataFrame | None = None
    readability: DataFrame | None = None


def _read(pages: DataFrame, name: str, config: Config) -> DataFrame:
    """Facts, texts, metadata, contacts link, vendor and candidate numbers of pages (page_id, leg, item_pos, url, asked, html,
    city), written. Links go by `url`, where the page was found in the end; `asked` is the address that was asked for."""
    read = facts.page_facts(dom.with_pages(spread(pages)).withColumns(_texts(config.markdown)).withColumnRenamed("article", "text"), numbers=True)
    first, more = F.coalesce("text", F.lit("")), F.coalesce("second", F.lit(""))
    text = F.when(extract.is_thin(first, config.markdown) & extract.second_is_better(first, more), more).otherwise(first)
    read = read.withColumns({"published": F.coalesce("published", "article_date", extract.date_in_url(F.col("asked"))), "text": text, "poisoned": F.col("phone_poisoned") | F.col("vendor").isNotNull()})
    return written(read.drop("html", "article_date", "second"), name)


@built_once
def _texts(markdown: bool) -> dict[str, Column]:
    n = F.col("nodes")
    second = extract.markdown(n) if markdown else extract.main_text(n)
    return {**extract.metadata(n), "second": second, "image": extract.image(n), "published": extract.stated_date(n), "contacts_url": extract.contacts_page(n, F.col("url"))}


def _wave(legs: list[DataFrame], name: str, config: Config) -> tuple[DataFrame, DataFrame]:
    """The pages of some legs, read, and their numbers, written. A render is poisoned if the page that it is of is."""
    pages = reduce(DataFrame.unionByName, legs)
    read = _read(pages, name, config)
    # Found pages are no record's: each is a group of its own, not all of them one.
    owner = F.coalesce(F.col("item_pos").cast("string"), F.col("page_id"))
    raw = F.max(F.when(~F.col("leg").endswith("_render"), F.col("poisoned"))).over(Window.partitionBy(owner))
    read = read.withColumn("poisoned", F.when(F.col("leg").endswith("_render"), F.coalesce(raw, F.lit(False))).otherwise(F.col("poisoned")))
    found = phones.numbers(read.filter("item_pos is not null").select("page_id", "vendor", "all", "poisoned"))
    return read.drop("all"), written(found, f"{name}-numbers")


def _leg(pages: DataFrame, leg: str) -> DataFrame:
    """Pages of one leg (item_pos, url, asked, html, city); a page of no record is known by its address and city."""
    own = F.coalesce(F.col("item_pos").cast("string"), F.concat_ws("|", "city", "asked"))
    return pages.select(F.concat_ws("|", F.lit(leg), own).alias("page_id"), F.lit(leg).alias("leg"), "item_pos", "url", "asked", "html", "city")


def _side_by_side(raw: DataFrame, render: DataFrame, numbers: DataFrame) -> DataFrame:
    """item_pos, a and b: what was read of a page and of its render, as structs; each with whether any number is anchored."""
    anchored = numbers.groupBy("page_id").agg(F.max("anchored").alias("anchored"))
    one = lambda df, to: df.join(anchored, "page_id", "left").withColumn("anchored", F.coalesce("anchored", F.lit(False))).select("item_pos", F.struct(*[c for c in df.columns if c != "item_pos"], "anchored", facts.contact_count().alias("n"), facts.has_contacts().alias("told")).alias(to))
    return one(raw, "a").join(one(render, "b"), "item_pos", "full")


def _adopted(adopt: Column) -> Column:
    """The render's reading where it is adopted, its phone dropped if the page itself is poisoned; else the page's own."""
    poisoned = F.col("b.poisoned") | F.col("b.phone_poisoned")
    render = F.col("b").withField("phone_poisoned", poisoned).withField("phone", F.when(~poisoned, F.col("b.phone")))
    return F.when(adopt, render).otherwise(F.col("a"))


def _longer(text: Column, other: Column) -> Column:
    return F.length(F.coalesce(other, F.lit(""))) > F.length(F.coalesce(text, F.lit("")))


def enrich(items: DataFrame, src: Sources, config: Config = Config()) -> DataFrame:
    """items (item_pos, name, url, city, mode, skip_maps_check, seed_*, latitude, longitude...) with resolved facts, provenance,
    status and content.

    Content is the densest text of the page, or of its content element where that is too short; or the text of its render or of
    a readability service where these are longer; with title, author, description, site name and language. A page that was never
    fetched stands on the readability text alone. Beside these: url (where the page was in the end), numbers (every number of
    the item's pages, strongest first, with its trust, role and city), search_context and search_sources, coordinates (the
    record's own, else the map card's), the flags render_skipped and tls_fallback_used, and `legs`, counts of what was done.
    Addresses that may point inside are never read.
    """
    can_render = src.renders is not None
    got = tables.settled(src.fetches).filter(~urls.private_target(F.col("url"))).select("url", "html", "status", F.coalesce(F.nullif("final_url", F.lit("")), "url").alias("final_url"), "tls_fallback_used")
    got = written(got, "enrich-fetches")
    shown = None
    if can_render:
        tried = F.col("attempt") if "attempt" in src.renders.columns else F.lit(0)
        whole = src.renders.filter((F.octet_length("html") >= LEAST_RENDER) & ~urls.private_target(F.col("url")))
        shown = whole.groupBy("url").agg(F.min_by("html", F.struct(tried, "html")).alias("html"))
    own = items.filter("coalesce(url, '') != ''").select("item_pos", F.col("url").alias("asked"), "city")
    home = own.join(got.withColumnRenamed("url", "asked"), "asked", "left")
    home = written(home.select("item_pos", "asked", "city", "status", "html", F.coalesce("final_url", "asked").alias("url"), "tls_fallback_used"), "enrich-homes")
    active = home.filter("status = 'active'")
    legs = [_leg(active.filter("coalesce(html, '') != ''"), "home")]
    if can_render:
        legs.append(_leg(active.drop("html").join(shown.withColumnRenamed("url", "asked"), "asked"), "home_render"))
    leads = None
    if src.results is not None:
        bare = items.filter("coalesce(url, '') = ''").select("item_pos", F.coalesce("city", F.lit("")).alias("city"))
        leads = search.distinct_results(src.results, ["item_pos"], ["pos"]).join(bare, "item_pos").filter(F.col("place") <= config.search_pages)
        leads = written(leads.select("item_pos", F.col("url").alias("asked"), "city", "place"), "enrich-leads")
        found = leads.select("asked", "city").distinct().join(got.filter("coalesce(html, '') != ''").withColumnRenamed("url", "asked"), "asked")
        legs.append(_leg(found.select(F.lit(None).cast(items.schema["item_pos"].dataType).alias("item_pos"), F.col("asked").alias("url"), "asked", "html", "city"), "search"))
    read, numbers = _wave(legs, "enrich-first", config)

    # The homepage and its render.
    j = _side_by_side(read.filter("leg = 'home'"), read.filter("leg = 'home_render'"), numbers)
    j = active.select("item_pos", "asked", F.col("url").alias("final_url"), "city").join(j, "item_pos", "left")
    none = F.lit(False)
    thin = F.length(truncate(F.coalesce("a.text", F.lit("")), config.most_content)) < extract.THIN
    told = F.coalesce("a.told", none)
    enough = F.coalesce(facts.raw_is_sufficient(told, F.col("a.poisoned"), F.col("a.anchored"), F.lit(config.render_skip_disabled)), none)
    wanted = F.lit(can_render) & (thin | ~enough)
    j = j.withColumns({"thin": thin, "enough": enough, "wanted": wanted}).withColumn("shown", F.col("wanted") & F.col("b").isNotNull())
    j = j.withColumn("adopt", F.col("shown") & F.coalesce(F.col("b.n") > F.coalesce("a.n", F.lit(0)), none))
    trusted = F.lit(can_render) & ~F.col("thin") & ~told & F.col("enough")
    j = j.withColumns({"skip": trusted, "render_failed": F.col("wanted") & ~F.col("shown"), "f": _adopted(F.col("adopt")), "page": F.when(F.col("shown"), F.col("b.contacts_url")).otherwise(F.col("a.contacts_url"))})
    lacking = facts.lacks_rich_field(F.col("f.hours"), F.col("f.email"), F.col("f.address"), F.col("f.anchored"))
    elsewhere = (F.col("page") != F.col("asked")) & (F.col("page") != F.col("final_url"))
    j = written(j.withColumn("page", F.when(lacking & elsewhere, F.col("page"))), "enrich-home-decided")

    # The contacts page and its render.
    contacts = j.filter("page is not null").select("item_pos", F.col("page").alias("asked"), "city")
    raw = contacts.join(got.filter("status = 'active' and coalesce(html, '') != ''").select(F.col("url").alias("asked"), "html"), "asked").withColumn("url", F.col("asked"))
    legs = [_leg(raw, "contacts")]
    if can_render:
        legs.append(_leg(contacts.join(shown.withColumnRenamed("url", "asked"), "asked").withColumn("url", F.col("asked")), "contacts_render"))
    second, more_numbers = _wave(legs, "enrich-second", config)
    k = _side_by_side(second.filter("leg = 'contacts'"), second.filter("leg = 'contacts_render'"), more_numbers)
    there = got.select(F.col("url").alias("asked"), F.col("tls_fallback_used").alias("tls2"))
    k = contacts.join(k, "item_pos", "left").join(there, "asked", "left")
    inside = urls.private_target(F.col("asked"))
    enough2 = F.coalesce(facts.raw_is_sufficient(F.col("a.told"), F.col("a.poisoned"), F.col("a.anchored"), F.lit(config.render_skip_disabled)), none)
    k = k.withColumns({"skip2": F.lit(can_render) & enough2 & ~F.coalesce("a.told", none), "blocked2": F.lit(can_render) & ~enough2 & inside, "wanted2": F.lit(can_render) & ~enough2 & ~inside})
    k = k.withColumn("failed2", F.col("wanted2") & F.col("b").isNull()).withColumn("adopt2", F.col("wanted2") & F.coalesce(F.col("b.n") > F.coalesce("a.n", F.lit(0)), none))
    k = k.select("item_pos", "skip2", "blocked2", "wanted2", "failed2", "tls2", _adopted(F.col("adopt2")).alias("g"))
    n1 = F.coalesce("f.n", F.lit(0))
    k = k.join(j.select("item_pos", n1.alias("n1")), "item_pos").withColumn("better", F.coalesce((F.col("g.n") > F.col("n1")) | F.col("g.phone_poisoned"), none))
    k = written(k, "enrich-contacts-decided")

    # Claims of all sources, in the order in which they are heard.
    def site(f: DataFrame, seq: int) -> DataFrame:
        return resolve.claims(f, "official_site", seq, FIELDS).unionByName(resolve.poison(f.filter("phone_poisoned").select("item_pos"), seq))

    first_site, second_site = j.filter("f is not null").select("item_pos", "f.*"), k.filter("better").select("item_pos", "g.*")
    seeds = items.select("item_pos", *[F.col(f"seed_{f}").alias(f) if f"seed_{f}" in items.columns else F.lit(None).cast("string").alias(f) for f in SEED])
    claims = [resolve.claims(seeds, "operator_verified", 0, SEED), site(first_site, 2), site(second_site, 3)]
    empty = lambda kind, name: F.lit(None).cast(kind).alias(name)
    card = items.select("item_pos", empty("string", "maps_status"), empty("double", "card_latitude"), empty("double", "card_longitude"))
    if src.cards is not None:
        allowed = items.filter("mode = 'places' and not coalesce(skip_maps_check, false)").select("item_pos")
        order = F.struct(*[F.col(c) for c in ("pos", "status", "name", "address", "phone", "website", "hours") if c in src.cards.columns])
        cards = src.cards.join(allowed, "item_pos").groupBy("item_pos").agg(F.min_by(F.struct(*[c for c in src.cards.columns if c != "item_pos"]), order).alias("c")).select("item_pos", "c.*")
        rich = (F.coalesce("phone", F.lit("")) != "") & (F.coalesce("website", F.lit("")) != "")
        point = lambda c: F.when(F.col("latitude") != 0, F.col(c)).alias(f"card_{c}") if {"latitude", "longitude"} <= set(cards.columns) else empty("double", f"card_{c}")
        cards = written(cards.withColumn("place_name", F.col("name")).withColumn("rich", rich), "enrich-cards")
        claims.append(resolve.claims(cards, "maps", 1, ["place_name", "address", "phone", "website", "hours"], F.col("rich")))
        card = cards.select("item_pos", F.col("status").alias("maps_status"), point("latitude"), point("longitude"))

    # Text: of the page, of its render, of a readability service; each counts where it is longer.
    t = j.select("item_pos", "asked", *[F.col(f"a.{c}").alias(c) for c in META], F.coalesce("a.text", F.lit("")).alias("text"), "a.image", "a.published", F.when(F.col("shown"), F.col("b.text")).alias("r_text"), F.col("b.title").alias("r_title"))
    wins = _longer(F.col("text"), F.col("r_text"))
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    t = t.withColumns({"title": F.when(wins & blank("title"), F.coalesce("r_title", "title")).otherwise(F.col("title")), "text": F.when(wins, F.col("r_text")).otherwise(F.col("text"))})
    lost = home.filter("status is null").select("item_pos", "asked", *[empty("string", c) for c in [*META, "text", "image", "published"]])
    t = t.drop("r_text", "r_title").unionByName(lost)
    if src.readability is not None:
        service = src.readability.select(F.col("url").alias("asked"), F.col("content").alias("s_text"), F.col("title").alias("s_title"), F.col("author").alias("s_author"), F.col("excerpt").alias("s_description")).filter(~urls.private_target(F.col("asked")))
        t = t.join(service, "asked", "left")
        wins = _longer(F.col("text"), F.col("s_text"))
        t = t.withColumns({**{c: F.when(wins & blank(c), F.coalesce(f"s_{c}", c)).otherwise(F.col(c)) for c in ("title", "author", "description")}, "text": F.when(wins, F.col("s_text")).otherwise(F.col("text"))})
    content = t.filter("text is not null").select("item_pos", *META, truncate(F.col("text"), config.most_content).alias("content"), "image", "published")
    saved = content.join(lost.select("item_pos"), "item_pos").select("item_pos", F.lit("active").alias("saved"))

    context = items.select("item_pos", empty("string", "search_context"), empty("string", "search_sources"))
    heard = items.select("item_pos", empty("boolean", "heard")).limit(0)
    if src.results is not None:
        context = search.aggregate(src.results, ["item_pos"], ["pos"]).select("item_pos", F.col("context").alias("search_context"), F.col("sources").alias("search_sources"))
        snippet = context.select("item_pos", facts.snippet_facts(F.col("search_context")).alias("f")).select("item_pos", "f.*")
        claims.append(resolve.claims(snippet, "search", 4, ["address", "phone", "price"]))
        texts = read.filter("leg = 'search'").select("asked", "city", "text", "image", *FOUND)
        if src.readability is not None:
            texts = texts.join(service.select("asked", "s_text"), "asked", "left").withColumn("text", F.when(_longer(F.col("text"), F.col("s_text")), F.col("s_text")).otherwise(F.col("text"))).drop("s_text")
        # A page of which anything was read counts; of each fact that several pages have, the last page's stands.
        told = leads.join(texts, ["asked", "city"]).filter((F.coalesce("text", F.lit("")) != "") | F.coalesce(*FOUND).isNotNull())
        told = written(told, "enrich-told")
        pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in FOUND]))
        rows = told.select("item_pos", (F.col("place") + 4).cast("int").alias("seq"), pairs.alias("p")).filter("p.value != ''")
        claims.append(rows.select("item_pos", "p.field", "p.value", F.lit("search").alias("source"), "seq", F.lit("low").alias("confidence")))
        g = told.groupBy("item_pos").agg(F.array_sort(F.collect_list(F.when(F.coalesce("text", F.lit("")) != "", F.struct("place", "text")))).alias("t"), F.min(F.when(F.col("image").isNotNull(), F.struct("place", "image"))).alias("i"))
        joined = F.array_join(F.transform("t", lambda x: x.text), "\n\n---\n\n")
        content = content.unionByName(g.select("item_pos", F.when(F.size("t") > 0, truncate(joined, config.most_content)).alias("content"), F.col("i.image").alias("image")), allowMissingColumns=True)
        heard = g.select("item_pos", F.lit(True).alias("heard"))
    claims = written(reduce(DataFrame.unionByName, claims), "enrich-claims")
    resolved = resolve.provenance(resolve.resolve(claims), FIELDS)

    # Numbers of the pages whose facts count, and of every contacts page.
    pages = j.filter("f is not null").select("item_pos", "f.page_id", F.lit(0).alias("page_ord")).union(k.filter("g is not null").select("item_pos", "g.page_id", F.lit(1).alias("page_ord")))
    every = resolve.number_lists(pages.join(numbers.unionByName(more_numbers), "page_id").join(items.select("item_pos", "city"), "item_pos"), validate.city_membership(F.col("value"), F.col("city")))

    tls = F.coalesce("tls_fallback_used", none)
    fetched = home.select("item_pos", "url", F.coalesce("status", F.lit("unreachable")).alias("site_status"), tls.alias("tls1"))
    done = j.select("item_pos", "skip", "render_failed", F.when(F.col("shown"), F.when(F.col("thin"), "thin_content").otherwise("absent_contacts")).alias("reason"), F.col("page").isNotNull().alias("discovered"), *[F.coalesce(F.coalesce(*[F.col(f"f.{c}") for c in FOUND]).isNotNull(), none).alias("site1")])
    done2 = k.select("item_pos", "skip2", "failed2", "blocked2", F.coalesce("tls2", none).alias("tls2"), (F.col("wanted2") & ~F.col("failed2")).alias("shown2"), "better", F.coalesce(F.coalesce(*[F.col(f"g.{c}") for c in FOUND]).isNotNull(), none).alias("site2"))
    legal = resolve.legal_against_venue(claims)
    conflicts = resolve.conflicts(claims).groupBy("item_pos").agg(F.sum("conflicts").alias("conflicts"))
    out = items.select("item_pos", F.coalesce("url", F.lit("")).alias("asked"), *[F.col(c).cast("double").alias(f"own_{c}") if c in items.columns else empty("double", f"own_{c}") for c in ("latitude", "longitude")])
    for part in (fetched, done, done2, legal, conflicts, saved, heard, every, context, card, content, resolved):
        out = out.join(part, "item_pos", "left")
    closed = resolve.closed_status(F.coalesce("saved", "site_status", F.lit("")), F.col("maps_status"), F.col("site_status").isNotNull())
    stands = F.coalesce(F.col("maps_status").isin("permanently_closed", "temporarily_closed"), none) & (closed != "active")
    given = F.col("own_latitude").isNotNull() & F.col("own_longitude").isNotNull()
    flag = lambda *cs: reduce(lambda x, y: x | y, [F.coalesce(F.col(c) if isinstance(c, str) else c, none) for c in cs])
    count = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    is_reason = lambda r: count(F.col("reason") == r)
    went = {
        "fetch_error": count(F.col("site_status") == "unreachable"), "render_thin_content": is_reason("thin_content"), "render_absent_contacts": is_reason("absent_contacts"), "render_contacts_page": count(F.col("shown2")),
        "render_error": count(F.col("render_failed")) + count(F.col("failed2")), "render_skipped_homepage": count(F.col("skip")), "render_skipped_contacts": count(F.col("skip2")), "contacts_discovered": count(F.col("discovered")),
        "contacts_resolved": count(F.col("better")), "site_resolved": count(F.col("site1")) + count(F.col("better") & F.col("site2")), "target_blocked": count(F.col("blocked2")), "legal_vs_venue": F.coalesce("legal_vs_venue", F.lit(0)).cast("int"), "conflicts": F.coalesce("conflicts", F.lit(0)).cast("int"),
    }
    return out.select(
        "item_pos",
        F.coalesce("url", "asked").alias("url"),
        flag("skip", "render_failed", "skip2", "failed2").alias("render_skipped"),
        F.when(F.col("site_status").isNotNull(), flag("tls1", "tls2")).alias("tls_fallback_used"),
        "numbers", "search_context", "search_sources",
        F.when(given, F.col("own_latitude")).otherwise(F.col("card_latitude")).alias("latitude"),
        F.when(given, F.col("own_longitude")).otherwise(F.col("card_longitude")).alias("longitude"),
        *META, "content", "image", "published",
        *[c for c in resolved.columns if c != "item_pos"],
        F.when(F.coalesce("heard", none) & ~stands, "active").otherwise(closed).alias("status"),
        F.struct(*[went[c].alias(c) for c in LEGS]).alias("legs"),
    )


def result_store(spark: SparkSession, path: str) -> Store:
    """Where enriched records are kept: the newest result of each cache key counts."""
    return Store(spark, path, ("cache_key",), "stored_at")


def enrich_cached(items: DataFrame, src: Sources, store: Store, now: Column, batch: str, ttl: str = "7 days", config: Config = Config()) -> DataFrame:
    """enrich's rows with cache_key, stored_at and cache_hit: records with a result in the store no older than ttl have that, the
    others are enriched, each key once, and put into the store as one batch of a given name. A run that is repeated under its
    name finds its batch there: it gives the same rows, puts nothing and enriches nothing.
    """
    seed = state.seed_print(*[F.col(f"seed_{f}") if f"seed_{f}" in items.columns else F.lit(None).cast("string") for f in SEED if f != "email"])
    keyed = written(items.withColumn("cache_key", state.cache_key(F.col("url"), F.col("name"), seed, F.coalesce("skip_maps_check", F.lit(False)))), "cache-keys")

    def fresh() -> DataFrame | None:
        known = store.read(since=now - F.expr(f"interval {ttl}"))
        return None if known is None else known.filter((F.col("stored_at") > now - F.expr(f"interval {ttl}")) & (F.col("stored_at") <= now))

    known = fresh()
    missing = keyed if known is None else keyed.join(known.select("cache_key"), "cache_key", "left_anti")
    # Equal keys are one record: the first of them is enriched, all of them get its result.
    first = missing.groupBy("cache_key").agg(F.min_by(F.struct(*[c for c in missing.columns if c != "cache_key"]), "item_pos").alias("r")).select("cache_key", "r.*")
    if batch not in store.manifest()["known"]:
        first = written(first, "cache-missing")
        new = enrich(first.drop("cache_key"), src, config).join(first.select("item_pos", "cache_key"), "item_pos")
        store.put(new.drop("item_pos").withColumns({"stored_at": now, "batch": F.lit(batch)}), batch)
    out = fresh()
    return keyed.select("item_pos", "cache_key").join(out, "cache_key").withColumn("cache_hit", F.col("batch") != batch).drop("batch")
