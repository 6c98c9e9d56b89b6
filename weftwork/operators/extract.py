"""Text and small facts of a page from its nodes: title, main text, hours, e-mail, image, date, contacts page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.functions import patterns as P
from weftwork.functions.text import clean_hours, clean_lines, let, one_spaced, trimmed
from weftwork.functions.urls import host_port, path, scheme, slug_class
from weftwork.operators import structured
from weftwork.sources import dom

#: Text under so many characters is thin; markdown over so many times the first text is taken for noise.
THIN, RATIO = 200, 3


def first(nodes: Column, pred) -> Column:
    return F.try_element_at(F.filter(nodes, pred), F.lit(1))


def meta(nodes: Column, *names: str) -> Column:
    """Content of the first meta element of a property or name, null if empty."""
    hit = first(nodes, lambda n: (n.tag == "meta") & (dom.attr(n, "property").isin(*names) | dom.attr(n, "name").isin(*names)))
    return F.nullif(trimmed(dom.attr(hit, "content")), F.lit(""))


def title(nodes: Column) -> Column:
    t = first(nodes, lambda n: n.tag == "title")
    return F.coalesce(F.nullif(let(t, lambda x: dom.whole(nodes, x)), F.lit("")), dom.attr(first(nodes, lambda n: (n.tag == "meta") & (dom.attr(n, "property") == "og:title")), "content"), F.lit(""))


def content_root(nodes: Column) -> Column:
    """The first content container that is no boilerplate, else the body, else all."""
    return F.coalesce(first(nodes, lambda n: n.content & ~n.boiler), first(nodes, lambda n: (n.tag == "body") & ~n.boiler), F.try_element_at(nodes, F.lit(1)))


def main_text(nodes: Column) -> Column:
    """Text of the main container without boilerplate, white space collapsed."""
    return F.coalesce(clean_lines(one_spaced(dom.text_of(nodes, content_root(nodes)))), F.lit(""))


def markdown(nodes: Column) -> Column:
    """The main container as markdown: headings, paragraphs, list items, emphasis and links."""
    root = content_root(nodes)
    inside = F.filter(F.slice(nodes, root.id + 1, root.last - root.id + 1), lambda n: ~n.boiler & ~n.tag.isin("head", "title", "#comment"))

    def written(n: Column) -> Column:
        t = F.regexp_replace(n.own, r"\s+", " ")
        bare = trimmed(t)
        t = F.when(bare == "", t).when(n.strong, F.concat(F.lit("**"), bare, F.lit("**"))).when(n.em, F.concat(F.lit("*"), bare, F.lit("*"))).otherwise(t)
        t = F.when(n.href.isNotNull() & (bare != ""), F.concat(F.lit("["), t, F.lit("]("), n.href, F.lit(")"))).otherwise(t)
        heading = F.when(n.tag.rlike("^h[1-6]$"), F.concat(F.lit("\n\n"), F.repeat(F.lit("#"), F.substring(n.tag, 2, 1).try_cast("int")), F.lit(" ")))
        block = F.when(n.tag == "li", "\n- ").when(n.tag == "br", "\n").when(n.tag.isin(*dom.BLOCKS), "\n\n").otherwise("")
        return F.when(n.tag == "#text", t).otherwise(F.coalesce(heading, block))

    return trimmed(F.regexp_replace(F.array_join(F.transform(inside, written), ""), r"[ \t]*\n(?:[ \t]*\n)+[ \t]*", "\n\n"))


def is_thin(text: Column, as_markdown: bool = False) -> Column:
    """Whether the first extraction is too little: under THIN characters, or markdown without a link."""
    t = F.coalesce(text, F.lit(""))
    return (F.length(t) < THIN) | (~F.contains(t, F.lit("](")) if as_markdown else F.lit(False))


def second_is_better(one: Column, two: Column) -> Column:
    """Whether the second text replaces the first: longer if that is thin; else with links, no shorter, at most RATIO times."""
    a, b = F.length(one), F.length(two)
    return F.when(a < THIN, b > a).otherwise(F.contains(two, F.lit("](")) & (b >= a) & ((a == 0) | (F.floor(b / F.greatest(a, F.lit(1))) <= RATIO)))


def visible_hours(nodes: Column) -> Column:
    """The value beside or inside the first node that is labelled with opening hours; null if none is usable."""

    def value(n: Column) -> Column:
        inline = F.regexp_replace(trimmed(F.regexp_replace(trimmed(n.own), P.HOURS_LABEL, "")), r"^[ :—–\-\t\n]+", "")
        return F.coalesce(clean_hours(inline), let(dom.node(nodes, n.next), lambda x: let(trimmed(dom.whole(nodes, x)), clean_hours)))

    labelled = F.filter(nodes, lambda n: ~n.tag.startswith("#") & n.own.rlike(P.HOURS_LABEL))
    return F.try_element_at(F.filter(F.transform(labelled, value), lambda v: v.isNotNull()), F.lit(1))


def email(nodes: Column) -> Column:
    """The first mailto address, without its query."""
    address = lambda n: trimmed(F.regexp_replace(F.regexp_replace(dom.attr(n, "href"), "^(?:mailto:|MAILTO:)", ""), r"(?s)\?.*$", ""))
    found = F.filter(F.transform(F.filter(nodes, lambda n: (n.tag == "a") & dom.attr(n, "href").rlike("^(?:mailto:|MAILTO:)")), address), lambda a: F.contains(a, F.lit("@")))
    return F.try_element_at(found, F.lit(1))


def image(nodes: Column) -> Column:
    return meta(nodes, "og:image")


def metadata(nodes: Column) -> dict[str, Column]:
    """Title, author, description, site name and language of a page."""
    page = first(nodes, lambda n: n.tag == "html")
    return {
        "title": title(nodes),
        "author": meta(nodes, "author", "article:author"),
        "description": meta(nodes, "description", "og:description"),
        "site_name": meta(nodes, "og:site_name"),
        "language": F.nullif(trimmed(dom.attr(page, "lang")), F.lit("")),
    }


def stated_date(nodes: Column) -> Column:
    """The publication date that a page's meta family or its first time element states, as text."""
    when = first(nodes, lambda n: (n.tag == "time") & dom.attr(n, "datetime").isNotNull())
    return F.coalesce(meta(nodes, "article:published_time", "datePublished", "date", "pubdate", "dc.date"), dom.attr(when, "datetime"))


def date_in_url(url: Column) -> Column:
    found = F.regexp_extract(url, r"/((?:19|20)[0-9]{2})[/-]([01]?[0-9])[/-]([0-3]?[0-9])(?:/|$|-)", 0)
    return F.nullif(F.regexp_replace(F.regexp_replace(found, "^/|[/-]$", ""), "/", "-"), F.lit(""))


def published(nodes: Column, url: Column) -> Column:
    """A publication date as text: meta family, then time elements, then the first article item, then a date in the URL."""
    article = let(structured.first_of(structured.items(nodes), P.ARTICLE_TYPES), structured.article)
    return F.coalesce(stated_date(nodes), article["published"], date_in_url(url))


def contacts_page(nodes: Column, base: Column) -> Column:
    """The same-origin link that best looks like a contacts page: by slug, then by its text, then the first."""

    def candidate(n: Column) -> Column:
        text = F.lower(trimmed(dom.whole(nodes, n))).isin(*P.CONTACT_TEXTS)
        decoded = F.coalesce(F.try_url_decode(F.regexp_replace(path(n.link), r"\+", "%2B")), path(n.link))
        return F.struct(slug_class(decoded).alias("slug"), text.alias("labelled"), (-n.id).alias("place"), n.link.alias("url"))

    plain = lambda u: F.regexp_replace(path(u), "^/+|/+$", "")
    same = lambda n: n.link.isNotNull() & scheme(n.link).isin("http", "https") & (host_port(n.link) == host_port(base)) & (host_port(base) != "") & (plain(n.link) != plain(base))
    found = F.filter(F.transform(F.filter(nodes, same), candidate), lambda c: (c.slug > 0) | c.labelled)
    return F.array_max(found).url


def pages(pages: DataFrame) -> DataFrame:
    """page_id, url, title, text, thin of each page: parsed once, everything else in expressions."""
    out = dom.with_nodes(pages.select("page_id", "url", "html"))
    out = out.select("page_id", "url", title(F.col("nodes")).alias("title"), main_text(F.col("nodes")).alias("text"))
    return out.withColumn("thin", is_thin(F.col("text")))
