"""schema.org items of a page, JSON-LD and microdata alike: JSON texts, each parsed once into a VARIANT that expressions project from.

An item that names a property twice is no VARIANT and has no properties.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftwork.functions import patterns as P
from weftwork.functions.text import let, trimmed
from weftwork.sources import dom

_TEXTS = "array<string>"


def _listed(value: Column) -> Column:
    """A JSON value as an array of its elements' texts; a single value is one element; null is none."""
    return F.coalesce(let(value, lambda v: F.when(v.rlike(r"^\s*\["), F.from_json(v, _TEXTS)).when(v.isNotNull(), F.array(v))), F.array().cast(_TEXTS))


def _get(v: Column, key: str, more: str = "", kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$['{key}']{more}", kind)


def first_text(v: Column, key: str) -> Column:
    """A property of a VARIANT as text; of several values the first."""
    return F.when(F.startswith(_get(v, key), F.lit("[")), _get(v, key, "[0]")).otherwise(_get(v, key))


def texts(v: Column, key: str) -> Column:
    """A property of a VARIANT as an array of texts; none is empty."""
    one = _get(v, key)
    return F.when(one.isNull(), F.array().cast(_TEXTS)).when(F.startswith(one, F.lit("[")), F.coalesce(_get(v, key, kind=_TEXTS), F.array().cast(_TEXTS))).otherwise(F.array(one))


def prop(v: Column, *keys: str) -> Column:
    """The first of the properties that has a non-empty text, trimmed; of several values the first."""
    return F.coalesce(*[F.nullif(trimmed(first_text(v, k)), F.lit("")) for k in keys])


def nested(v: Column, key: str) -> Column:
    """The first nested item of a property as a VARIANT, null if it is not one. Microdata has them as texts."""
    return let(F.ltrim(first_text(v, key)), lambda t: F.when(F.startswith(t, F.lit("{")), F.try_parse_json(t)))


def kinds(item: Column) -> Column:
    """The types of an item's text: one property alone needs no whole parse."""
    return F.transform(_listed(F.get_json_object(item, "$['@type']")), lambda t: F.regexp_replace(t, "^https?://schema.org/", ""))


def microdata(nodes: Column) -> Column:
    """Items of itemscope elements that lie in no other, as JSON texts; the items nested in them are objects of theirs."""
    kept = F.filter(nodes, lambda n: dom.attr(n, "itemscope").isNotNull() | dom.attr(n, "itemprop").isNotNull())
    text = lambda n: F.coalesce(dom.attr(n, "content"), F.when(n.tag.isin("a", "link", "area"), dom.attr(n, "href")), F.when(n.tag.isin("img", "source"), dom.attr(n, "src")), dom.attr(n, "datetime"), trimmed(dom.whole(nodes, n)))
    slim = F.transform(kept, lambda n: F.struct(n.id.alias("id"), n.scope.alias("scope"), dom.attr(n, "itemscope").isNotNull().alias("item"), dom.attr(n, "itemprop").alias("name"), F.when(dom.attr(n, "itemscope").isNull(), text(n)).alias("value"), F.coalesce(dom.attr(n, "itemtype"), F.lit("")).alias("type")))
    # Sorted by scope, then place, the properties of a scope are one slice: no scope looks at all others' properties.
    order = F.transform(slim, lambda x: F.struct(F.coalesce(x.scope, F.lit(-1)).alias("of"), x.id.alias("id"), x["item"].alias("item"), x["name"].alias("name"), x["value"].alias("value"), x["type"].alias("type")))
    return let(F.array_sort(order), _items)


def _items(rows: Column) -> Column:
    """Items from rows (of: the scope that each lies in, id, item, name, value, type), sorted by scope and place."""
    scopes = F.transform(rows, lambda x: x.of)
    # One map from scope to where its slice begins and how long it is.
    groups = F.map_from_entries(F.transform(F.array_distinct(scopes), lambda s: F.struct(s.alias("k"), F.array_position(scopes, s).cast("int").alias("v"))))
    ends = F.map_from_entries(F.transform(F.array_distinct(scopes), lambda s: F.struct(s.alias("k"), (F.size(rows) - F.array_position(F.reverse(scopes), s) + 1).cast("int").alias("v"))))
    none = F.slice(rows, 1, 0)

    def inside(at: Column) -> Column:
        begin = F.try_element_at(groups, at)
        return F.coalesce(F.slice(rows, begin, F.try_element_at(ends, at) - begin + 1), none)

    as_json = lambda pairs: F.to_json(F.map_from_entries(pairs))

    def flat(of: Column, kind: Column) -> Column:
        """Plain properties of one scope; the first value of a name."""
        props = F.filter(inside(of), lambda x: ~x["item"] & x["name"].isNotNull())
        names = F.transform(props, lambda x: x["name"])
        once = F.filter(props, lambda x, i: F.array_position(names, x["name"]) == i + 1)
        return F.concat(F.array(F.struct(F.lit("@type").alias("k"), kind.alias("v"))), F.transform(once, lambda x: F.struct(x["name"].alias("k"), x["value"].alias("v"))))

    def whole(s: Column) -> Column:
        inner = F.filter(inside(s.id), lambda x: x["item"] & x["name"].isNotNull())
        return as_json(F.concat(flat(s.id, s["type"]), F.transform(inner, lambda x: F.struct(x["name"].alias("k"), as_json(flat(x.id, x["type"])).alias("v")))))

    return F.transform(F.filter(inside(F.lit(-1)), lambda x: x["item"]), whole)


def items(nodes: Column) -> Column:
    """All top-level items: of JSON-LD scripts, then of microdata."""
    scripts = F.filter(nodes, lambda n: (n.tag == "script") & F.lower(trimmed(dom.attr(n, "type"))).eqNullSafe("application/ld+json"))
    return F.concat(F.flatten(F.transform(scripts, lambda n: _listed(trimmed(n.own)))), microdata(nodes))


def of_kind(item: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(kinds(item), F.array(*map(F.lit, names)))


def first_of(all_items: Column, names: tuple[str, ...]) -> Column:
    """The first item of the first type that any item has: types go before document order."""
    known = F.array(*map(F.lit, names))
    ranked = F.transform(all_items, lambda i, at: F.struct(F.array_min(F.transform(kinds(i), lambda k: F.nullif(F.array_position(known, k), F.lit(0).cast("long")))).alias("rank"), at.alias("at"), i.alias("item")))
    return F.array_min(F.filter(ranked, lambda r: r["rank"].isNotNull()))["item"]


def address(v: Column) -> Column:

    def joined(inner: Column) -> Column:
        parts = F.concat_ws(", ", *[prop(inner, k) for k in ("streetAddress", "addressLocality", "addressRegion", "postalCode")])
        return F.coalesce(F.nullif(parts, F.lit("")), F.when(inner.isNull(), prop(v, "address")))

    return let(nested(v, "address"), joined)


def price(v: Column) -> Column:
    return F.coalesce(prop(nested(v, "offers"), "price"), prop(v, "priceRange"))


def hours(v: Column) -> Column:
    """Clauses "days opens-closes" of the specification joined by "; ", else the plain opening hours joined alike."""

    def clause(spec: Column) -> Column:
        days = F.array_join(F.filter(F.transform(texts(spec, "dayOfWeek"), lambda d: F.regexp_replace(trimmed(d), "^.*/", "")), lambda d: d != ""), ",")
        return F.ltrim(F.concat(days, F.lit(" "), prop(spec, "opens"), F.lit("-"), prop(spec, "closes")))

    specs = F.transform(F.filter(texts(v, "openingHoursSpecification"), lambda s: s.rlike(r"^\s*\{")), lambda s: let(F.try_parse_json(s), clause))
    clauses = F.filter(specs, lambda c: c.isNotNull())
    plain = F.filter(F.transform(texts(v, "openingHours"), trimmed), lambda h: h != "")
    return F.coalesce(F.nullif(F.array_join(clauses, "; "), F.lit("")), F.nullif(F.array_join(plain, "; "), F.lit("")))


def _kind(v: Column) -> Column:
    return F.regexp_replace(first_text(v, "@type"), "^https?://schema.org/", "")


def _named(v: Column, key: str) -> Column:
    """The name of a nested item, or the property's own text."""
    return let(nested(v, key), lambda inner: F.when(inner.isNotNull(), prop(inner, "name")).otherwise(prop(v, key)))


def place(item: Column) -> Column:
    """struct(name, kind, address, phone, website, hours, price) of an item's text."""
    return let(F.try_parse_json(item), lambda v: F.struct(prop(v, "name").alias("name"), _kind(v).alias("kind"), address(v).alias("address"), prop(v, "telephone").alias("phone"), prop(v, "url").alias("website"), hours(v).alias("hours"), price(v).alias("price")))


def article(item: Column) -> Column:
    return let(F.try_parse_json(item), lambda v: F.struct(prop(v, "headline", "name").alias("headline"), _named(v, "author").alias("author"), prop(v, "description").alias("description"), prop(v, "datePublished").alias("published")))


def event(item: Column) -> Column:
    return let(F.try_parse_json(item), lambda v: F.struct(prop(v, "name").alias("name"), prop(v, "startDate").alias("start"), prop(v, "endDate").alias("end"), _named(v, "location").alias("location"), price(v).alias("price")))


def organization(item: Column) -> Column:
    return let(F.try_parse_json(item), lambda v: F.struct(prop(v, "name").alias("name"), prop(v, "legalName").alias("legal_name"), address(v).alias("address"), prop(v, "telephone").alias("phone"), prop(v, "url").alias("website"), hours(v).alias("hours"), has_legal_id(item).alias("legal_id")))


def has_legal_id(item: Column) -> Column:
    """Whether any key of an item, nested ones too, is a tax or registry number, or any text holds the label of one."""
    keys = F.regexp_extract_all(item, F.lit(r'"([^"\\]+)"\s*:'), F.lit(1))
    values = F.regexp_extract_all(item, F.lit(r'"((?:[^"\\]++|\\.)*+)"'), F.lit(1))
    return F.exists(keys, lambda k: trimmed(k).rlike(P.LEGAL_ID_KEY)) | F.exists(values, lambda v: v.rlike(P.LEGAL_ID))


def places(all_items: Column) -> Column:
    """Every place of a page: top-level items and those of an item's @graph."""
    everything = F.flatten(F.transform(all_items, lambda i: F.concat(F.array(i), _listed(F.get_json_object(i, "$['@graph']")))))
    return F.transform(F.filter(everything, lambda i: of_kind(i, P.PLACE_TYPES)), place)


