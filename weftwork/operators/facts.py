"""The facts of a page by a fixed cascade of sources: structured data, labelled text, phones, elements, visible hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.functions import patterns as P
from weftwork.functions.once import built_once
from weftwork.functions.text import first_group, first_match, let, trimmed
from weftwork.functions.validate import area_code, city_codes, legal_address, valid_address, valid_phone, valid_price
from weftwork.operators import extract, phones, structured
from weftwork.sources import dom

FIELDS = ("place_name", "place_type", "address", "legal_address", "phone", "website", "hours", "price", "email", "event_date")


def _if(test, value: Column) -> Column:
    return let(value, lambda v: F.when(test(v), v))


def venue(address: Column) -> Column:
    return _if(lambda a: valid_address(a) & ~legal_address(a), address)


def legal(address: Column) -> Column:
    return _if(lambda a: valid_address(a) & legal_address(a), address)


def snippet_facts(text: Column) -> Column:
    """struct(address, phone, price) of a search snippet, each valid or null."""
    a, p, c = first_group(text, P.SNIPPET_ADDRESS), first_match(text, P.PHONE), first_group(text, P.SNIPPET_PRICE)
    return F.struct(_if(valid_address, a).alias("address"), _if(valid_phone, p).alias("phone"), _if(valid_price, c).alias("price"))


def markup_facts(html: Column) -> Column:
    """The same from markup without noise elements: a value ends at a tag."""
    a, p, c = first_group(html, P.ADDRESS), first_match(html, P.PHONE), first_group(html, P.PRICE)
    return F.struct(_if(valid_address, a).alias("address"), _if(valid_phone, p).alias("phone"), _if(valid_price, c).alias("price"))


def organization_is_legal(org: Column, address: Column, element: Column) -> Column:
    """Whether an organization's address is its registered seat: a legal id, name or marker, or a venue elsewhere."""
    own = trimmed(org.address)
    other = lambda a: F.coalesce(trimmed(a) != own, F.lit(False))
    return F.coalesce(org.legal_id | org.legal_name.isNotNull() | legal_address(org.address) | (org.address.isNotNull() & (other(address) | other(element))), F.lit(False))


@built_once
def _layers(city: str) -> list[dict[str, Column]]:
    """What a page with nodes, clean, items, vendor and near gets, layer by layer."""
    c, i = F.col, F.col("items")
    first = {"pl": structured.place(structured.first_of(i, P.PLACE_TYPES)), "ar": structured.article(structured.first_of(i, P.ARTICLE_TYPES)), "ev": structured.event(structured.first_of(i, ("Event",))), "og": structured.organization(structured.first_of(i, P.ORGANIZATION_TYPES)), "rx": markup_facts(c("clean"))}
    elements = F.transform(F.filter(c("nodes"), lambda n: n.tag == "address"), lambda n: trimmed(dom.whole(c("nodes"), n)))
    second = {"venues": F.filter(elements, lambda a: valid_address(a) & ~legal_address(a)), "seats": F.filter(elements, lambda a: valid_address(a) & legal_address(a))}
    element = F.try_element_at("venues", F.lit(1))
    before = F.coalesce(venue(c("pl.address")), venue(c("ev.location")))
    third = {"seat": organization_is_legal(c("og"), before, element), "before": before}
    fourth = {
        "address": F.coalesce(c("before"), F.when(~c("seat"), venue(c("og.address"))), venue(c("rx.address")), element),
        "legal_address": F.coalesce(legal(c("pl.address")), legal(c("ev.location")), F.when(c("seat"), _if(valid_address, c("og.address"))), legal(c("og.address")), legal(c("rx.address")), F.try_element_at(c("seats"), F.lit(1))),
        "prior": F.coalesce(_if(valid_phone, c("pl.phone")), _if(valid_phone, c("og.phone")), c("rx.phone")),
    }
    fifth = {"pick": phones.pick(F.concat(phones.valid(F.array(phones.candidate(c("prior"), phones.MICRODATA))), c("near")), c(city), c("vendor"))}
    value, local = c("pick.value"), F.coalesce(F.array_contains(city_codes(c(city)), area_code(c("pick.value"))), F.lit(False))
    last = {
        "place_name": F.coalesce(c("pl.name"), c("ev.name"), c("og.name")),
        "place_type": c("pl.kind"),
        "address": c("address"),
        "legal_address": c("legal_address"),
        "phone": F.when(c("pick.poisoned"), F.lit(None)).when(value.isNotNull() & (local | c("pick.region").isin("contacts", "microdata")), value).otherwise(F.coalesce("prior", value)),
        "website": F.coalesce(c("pl.website"), c("og.website")),
        "hours": F.coalesce(c("pl.hours"), c("og.hours"), extract.visible_hours(c("nodes"))),
        "price": F.coalesce(_if(valid_price, c("pl.price")), _if(valid_price, c("ev.price")), c("rx.price")),
        "email": extract.email(c("nodes")),
        "event_date": F.coalesce(c("ar.published"), c("ev.start")),
        "phone_poisoned": c("pick.poisoned"),
        "vendor": c("vendor"),
        "article_date": c("ar.published"),
    }
    return [first, second, third, fourth, fifth, last]


@built_once
def _items() -> Column:
    return structured.items(F.col("nodes"))


def page_facts(pages: DataFrame, city: str = "city", numbers: bool = False) -> DataFrame:
    """pages (page_id, url, html, city; or what `dom.with_pages` made of them) with one column a fact, phone_poisoned and vendor;
    with `numbers`, also `all`, the candidates of every finder.

    Each layer only fills what the ones before it left open, but for the phone, which the best-placed candidate may replace.
    """
    p = pages if "clean" in pages.columns else dom.with_pages(pages)
    cols = [c for c in pages.columns if c not in ("nodes", "clean")]
    found, every = phones.found_columns()
    *layers, last = _layers(city)
    for layer in ({"items": _items()}, found, *layers):
        p = p.withColumns(layer)
    return p.select(*cols, *[v.alias(k) for k, v in last.items()], *([every["all"].alias("all")] if numbers else []))


def has_contacts(poisoned: str = "phone_poisoned") -> Column:
    return F.col("phone").isNotNull() | F.col(poisoned) | F.col("address").isNotNull() | F.col("hours").isNotNull() | F.col("email").isNotNull()


def contact_count(poisoned: str = "phone_poisoned") -> Column:
    """How many of phone (or its poison), address, legal address, hours and e-mail there are."""
    parts = [F.col("phone").isNotNull() | F.col(poisoned), *(F.col(c).isNotNull() for c in ("address", "legal_address", "hours", "email"))]
    return sum((x.cast("int") for x in parts), F.lit(0))


def lacks_rich_field(hours: Column, email: Column, address: Column, anchored: Column) -> Column:
    """Whether a homepage leaves something for a contacts page to tell: hours, e-mail, address, or a number that is anchored."""
    return hours.isNull() | email.isNull() | address.isNull() | ~F.coalesce(anchored, F.lit(False))


def has_any_fact() -> Column:
    return F.coalesce(*[F.col(c) for c in FIELDS if c != "legal_address"]).isNotNull()


def raw_is_sufficient(contacts: Column, poisoned: Column, anchored: Column, skip_disabled: Column | None = None) -> Column:
    """Whether a page need not be rendered. The only definition; with the switch thrown, anchored numbers do not count."""
    return contacts | (~poisoned & anchored & ~(F.lit(False) if skip_disabled is None else skip_disabled))


def render_reason(thin: Column, sufficient: Column) -> Column:
    return F.when(thin, "thin_content").when(~sufficient, "absent_contacts")
