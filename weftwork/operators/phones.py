"""Phones of a page: finders, call-tracking detection, the single pick, and the set of all numbers with roles.

A candidate has its value, its natural tier (how much the place it was found in tells) and the text that names its role.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftwork.functions import patterns as P
from weftwork.functions.once import built_once
from weftwork.functions.text import any_of, digits, is_department, let, trimmed
from weftwork.functions.validate import area_code, canonical_phone, city_codes, geographic_code, toll_free, valid_phone
from weftwork.operators import structured
from weftwork.sources import dom

# The ladder of tiers.
DEMOTED, MICRODATA, BODY, CONTACTS, BRANCH, PLACE, SOCIAL = range(7)


def candidate(value: Column, tier: Column | int, role: Column | None = None) -> Column:
    natural = F.lit(tier) if isinstance(tier, int) else tier
    return F.struct(trimmed(F.coalesce(value, F.lit(""))).alias("value"), natural.cast("int").alias("natural"), F.coalesce(role if role is not None else F.lit(""), F.lit("")).alias("label"))


def tier(c: Column) -> Column:
    """The tier that counts for a pick: a toll-free number has the lowest wherever it stands."""
    return F.when(toll_free(area_code(c.value)), F.lit(DEMOTED)).otherwise(c.natural)


def valid(candidates: Column) -> Column:
    return F.filter(candidates, lambda c: valid_phone(c.value))


def tel(nodes: Column) -> Column:
    """tel: links; demoted in a tracking part, unless that holds the whole contact area; else by region."""

    def one(n: Column) -> Column:
        demoted = n.tracking.isNotNull() & (n.region.isNull() | dom.node(nodes, n.tracking).region.isNotNull())
        value = let(trimmed(dom.whole(nodes, n)), lambda shown: F.when(valid_phone(shown), shown).otherwise(F.regexp_replace(dom.attr(n, "href"), "^(?:tel:)?(?:TEL:)?", "")))
        return candidate(value, F.when(demoted, DEMOTED).when(n.region.isNotNull(), CONTACTS).otherwise(BODY), n.role)

    return valid(F.transform(F.filter(nodes, lambda n: (n.tag == "a") & dom.attr(n, "href").rlike("^(?:tel:|TEL:)")), one))


def social_phone(href: Column) -> Column:
    """The number in a chat link, + and digits; "" if it has none."""
    query = F.regexp_replace(href, r"(?s)^[^?]*\?", "")
    from_query, from_path = F.regexp_extract(query, r"(?s)phone=([^&#?/\\\"' \t\n]*)", 1), F.regexp_extract(href, r"(?s)wa\.me/([^&#?/\\\"' \t\n]*)", 1)
    seg = F.when(F.contains(query, F.lit("phone=")), from_query).otherwise(from_path)
    d = digits(F.coalesce(F.try_url_decode(seg), seg))
    return F.when(d == "", d).otherwise(F.concat(F.lit("+"), d))


def social(nodes: Column) -> Column:
    links = F.filter(nodes, lambda n: (n.tag == "a") & (F.contains(dom.attr(n, "href"), F.lit("wa.me/")) | F.contains(dom.attr(n, "href"), F.lit("api.whatsapp.com/send"))))
    return valid(F.transform(links, lambda n: candidate(social_phone(dom.attr(n, "href")), SOCIAL)))


def microdata(nodes: Column) -> Column:
    value = lambda n: F.coalesce(F.nullif(trimmed(dom.attr(n, "content")), F.lit("")), trimmed(dom.whole(nodes, n)))
    return valid(F.transform(F.filter(nodes, lambda n: dom.attr(n, "itemprop") == "telephone"), lambda n: candidate(value(n), MICRODATA, n.role)))


def meta_phone(nodes: Column) -> Column:
    props = dict(property=("business:contact_data:phone_number", "og:phone_number"), name=("og:phone_number",))
    hit = lambda n: (n.tag == "meta") & F.coalesce(any_of(F.coalesce(dom.attr(n, a).isin(*v), F.lit(False)) for a, v in props.items()), F.lit(False))
    return valid(F.transform(F.filter(nodes, hit), lambda n: candidate(dom.attr(n, "content"), MICRODATA)))


def branches(nodes: Column) -> Column:
    """Phones of JSON string literals assigned in inline scripts (a chain's list of branches), of scripts of any length and all of
    them: flat objects, text values only. The work is in proportion to the scripts' length."""

    def literals(n: Column) -> Column:
        # Possessive, since a repeated alternation recurses once a character and overflows the stack on a long literal.
        found = F.regexp_extract_all(n.own, F.lit(r"""=[ \t\n\r]*('(?:[^'\\]++|\\.)*+'|"(?:[^"\\]++|\\.)*+")"""), F.lit(1))
        plain = F.transform(found, lambda x: F.when(F.substring(x, 1, 1) == "'", F.replace(F.substr(x, F.lit(2), F.length(x) - 2), F.lit("\\'"), F.lit("'"))).otherwise(F.replace(F.substr(x, F.lit(2), F.length(x) - 2), F.lit('\\"'), F.lit('"'))))
        return F.filter(plain, lambda x: x.rlike(r"^\s*[\[{]"))

    def values(o: Column) -> Column:
        keys = F.array(*map(F.lit, ("=phone", "=phonelink", "=telephone", "=tel")))
        entries = F.flatten(F.transform(keys, lambda k: F.filter(F.map_entries(o), lambda e: (F.lower(e.key) == k) & F.startswith(e.value, F.lit("=")))))
        return F.transform(entries, lambda e: F.substr(e.value, F.lit(2)))

    def found(x: Column) -> Column:
        # Marked, texts differ from numbers and nested values once they are parsed; elements that are no objects do not stand in the way.
        marked = F.regexp_replace(x, r'"((?:[^"\\]++|\\.)*+)"', '"=$1"')
        objects = F.when(x.rlike(r"^\s*\["), F.from_json(marked, "array<string>")).otherwise(F.array(marked))
        parsed = F.transform(F.filter(objects, lambda o: o.rlike(r"^\s*\{")), lambda o: F.from_json(o, "map<string, string>"))
        return F.coalesce(F.flatten(F.transform(F.filter(parsed, lambda o: o.isNotNull()), values)), F.array().cast("array<string>"))

    scripts = F.filter(nodes, lambda n: (n.tag == "script") & dom.attr(n, "src").isNull() & F.lower(trimmed(F.coalesce(dom.attr(n, "type"), F.lit("")))).isin("", "text/javascript", "application/javascript"))
    return valid(F.transform(F.flatten(F.transform(F.flatten(F.transform(scripts, literals)), found)), lambda v: candidate(v, BRANCH)))


def places(items: Column) -> Column:
    """Phones of pages whose items describe two places or more, one each."""
    several = F.filter(F.array(structured.places(items)), lambda p: F.size(p) >= 2)
    return F.flatten(F.transform(several, lambda ps: valid(F.transform(ps, lambda p: candidate(p.phone, PLACE)))))


def plain(nodes: Column) -> Column:
    """Phones printed near a phone label."""
    return valid(F.transform(F.filter(nodes, lambda n: n.tag == "#phone"), lambda n: candidate(n.own, CONTACTS, n.role)))


_KIND = "array<struct<value: string, natural: int, label: string>>"


def vendor(nodes: Column) -> Column:
    """The first call-tracking vendor whose script address or inline configuration is on the page, null for none."""
    src = F.lower(F.array_join(F.transform(F.filter(nodes, lambda n: n.tag == "script"), lambda n: F.coalesce(dom.attr(n, "src"), F.lit(""))), "\n"))
    inline = F.lower(F.array_join(F.transform(F.filter(nodes, lambda n: (n.tag == "script") & dom.attr(n, "src").isNull()), lambda n: n.own), "\n"))
    return F.coalesce(*[F.when(any_of([*(F.contains(src, F.lit(t)) for t in s), *(F.contains(inline, F.lit(t)) for t in c)]), F.lit(name)) for name, s, c in P.VENDORS])


@built_once
def found_columns() -> list[dict[str, Column]]:
    """What pages with nodes and items get, in turn: `vendor`, and the candidates `near` of four finders, which the pick and the
    set of all numbers share; then `all`."""
    n = F.col("nodes")
    return [{"vendor": vendor(n), "near": F.concat(social(n), tel(n), microdata(n), meta_phone(n))}, {"all": _every(F.col("near"), n, F.col("items"))}]


def with_candidates(pages: DataFrame, prior: Column | None = None) -> DataFrame:
    """pages with nodes, plus vendor and candidates in the finders' order (it breaks ties)."""
    n = F.col("nodes")
    out = pages.withColumn("vendor", vendor(n))
    before = valid(F.array(candidate(prior, MICRODATA))) if prior is not None else F.array().cast(_KIND)
    return out.withColumn("candidates", F.concat(before, social(n), tel(n), microdata(n), meta_phone(n)))


def region(tier: Column) -> Column:
    return F.when(tier.isin(SOCIAL, CONTACTS), "contacts").when(tier == MICRODATA, "microdata").otherwise("other")


def pick(candidates: Column, city: Column, vendor_name: Column) -> Column:
    """struct(value, region, poisoned): with a vendor active only a chat link's number holds; else the best candidate, first
    of the city's area codes, then of the tier (a chat link counts as body text), then the first."""
    codes = city_codes(city)

    def ranked(c: Column, i: Column) -> Column:
        near = F.coalesce(F.array_contains(codes, area_code(c.value)), F.lit(False))
        return let(tier(c), lambda t: F.struct(near.alias("near"), F.when(t == SOCIAL, F.lit(BODY)).otherwise(t).alias("pick"), (-i).alias("place"), c.value.alias("value"), t.alias("tier")))

    def chosen(r: Column) -> Column:
        best = F.array_max(r)
        chat = F.array_max(F.transform(F.filter(r, lambda x: x.tier == SOCIAL), lambda x: F.struct(x.place, x.value.alias("value"), x.tier.alias("tier"))))
        some, tracked = F.size(r) > 0, vendor_name.isNotNull()
        value = F.when(some & tracked, chat.value).when(some, best.value)
        return F.struct(value.alias("value"), F.when(value.isNotNull(), region(F.when(tracked, chat.tier).otherwise(best.tier))).alias("region"), (some & tracked & chat.isNull()).alias("poisoned"))

    return let(F.transform(candidates, ranked), chosen)


def site_contacts(nodes: Column) -> Column:
    """struct(phone, region): a contact-area link, a chat link, any other link (tracked ones last), microdata."""
    return let(F.struct(tel(nodes).alias("links"), social(nodes).alias("chats"), microdata(nodes).alias("data")), _contacts)


def _contacts(found: Column) -> Column:
    links, chats, data = found.links, found.chats, found.data
    one = lambda a: F.try_element_at(a, F.lit(1))
    area, other = one(F.filter(links, lambda c: c.natural == CONTACTS)), F.coalesce(one(F.filter(links, lambda c: c.natural != DEMOTED)), one(links))
    which = F.when(area.isNotNull(), F.struct(area.value.alias("phone"), F.lit("contacts").alias("region"))).when(F.size(chats) > 0, F.struct(one(chats).value.alias("phone"), F.lit("contacts").alias("region")))
    return which.when(other.isNotNull(), F.struct(other.value.alias("phone"), F.lit("other").alias("region"))).when(F.size(data) > 0, F.struct(one(data).value.alias("phone"), F.lit("microdata").alias("region")))


def keep_strongest(rows: DataFrame, key: Column, rank: Column, seq: Column, within: list[str] | None = None) -> DataFrame:
    """One row a key: the greatest rank, the first of equals. Rows with an empty key go; `first_seen` orders the output."""
    by = [*(within or []), key]
    w = Window.partitionBy(*by)
    out = rows.filter(key.isNotNull() & (key != "")).withColumns({"first_seen": F.min(seq).over(w), "_rn": F.row_number().over(w.orderBy(rank.desc(), seq))})
    return out.filter("_rn = 1").drop("_rn")


# The names of the tiers as sources.
NAMES = {SOCIAL: "social_link", BRANCH: "branch_json", PLACE: "schema_place", CONTACTS: "contacts", MICRODATA: "microdata", BODY: "body", DEMOTED: "demoted"}
ANCHORED = (MICRODATA, CONTACTS, BRANCH, PLACE, SOCIAL)


def every(nodes: Column) -> Column:
    """All candidates of all finders in their order, each as struct(c, plain): plain ones count only where no other finder has them."""
    return _every(F.concat(social(nodes), tel(nodes), microdata(nodes), meta_phone(nodes)), nodes, structured.items(nodes))


def _every(near: Column, nodes: Column, items: Column) -> Column:
    tagged = lambda a, is_plain: F.transform(a, lambda c: F.struct(c.alias("c"), F.lit(is_plain).alias("plain")))
    return F.concat(tagged(F.concat(near, branches(nodes), places(items)), False), tagged(plain(nodes), True))


def site_numbers(pages: DataFrame, poisoned: Column | None = None) -> DataFrame:
    """`numbers` of parsed pages (page_id, nodes)."""
    n = F.col("nodes")
    return numbers(pages.select("page_id", vendor(n).alias("vendor"), every(n).alias("all"), (poisoned if poisoned is not None else F.lit(False)).alias("poisoned")))


def numbers(found: DataFrame) -> DataFrame:
    """(page_id, place, value, key, source, anchored, dni, trustworthy, role_label_raw, role): every number of each page once.

    A number found by several finders keeps its strongest reading; it is departmental only if every labelled reading is.
    """
    dni = F.col("vendor").isNotNull() | F.coalesce("poisoned", F.lit(False))
    rows = found.select("page_id", dni.alias("dni"), F.posexplode("all").alias("seq", "f")).select("page_id", "dni", "seq", "f.plain", "f.c.*")
    # A plainly printed number counts only where no other finder has it, and once.
    same = Window.partitionBy("page_id", canonical_phone(F.col("value")))
    rows = rows.withColumn("first", F.min("seq").over(same)).filter(~F.col("plain") | (F.col("first") == F.col("seq")))
    rows = rows.withColumns({"key": digits(F.col("value")), "department": is_department(F.col("label"))})
    w = Window.partitionBy("page_id", "key")
    rows = rows.withColumns({"general": F.min(F.when(~F.col("department"), F.struct("seq", "label"))).over(w)})
    best = keep_strongest(rows, F.col("key"), F.col("natural"), F.col("seq"), ["page_id"])
    general = F.col("general").isNotNull()
    names = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])
    anchored = F.col("natural").isin(*ANCHORED)
    best = best.withColumns({"source": names[F.col("natural")], "anchored": anchored, "trustworthy": F.when(F.col("dni"), F.col("natural") == SOCIAL).otherwise(anchored), "role": F.when(general, "").otherwise("departmental"), "role_label_raw": F.when(F.col("department") & general, F.col("general.label")).otherwise(F.col("label"))})
    return best.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("natural"), "key"))).select("page_id", "place", "value", "key", "source", "anchored", "dni", "trustworthy", "role_label_raw", "role")


def reduce_roles(rows: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """(keys, role, label): general if any reading is, with the first general reading's label."""
    general = F.min(F.when(F.col("role") == "", F.struct(seq, "label")))
    return rows.groupBy(*keys).agg(general.alias("g"), F.min(F.struct(seq, "label")).alias("f")).select(*keys, F.when(F.col("g").isNotNull(), "").otherwise("departmental").alias("role"), F.coalesce("g.label", "f.label").alias("label"))


def is_landline(phone: Column) -> Column:
    return geographic_code(area_code(phone))
