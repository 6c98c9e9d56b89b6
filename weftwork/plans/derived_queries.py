"""Queries over inputs built from columns of the star tables.

Pages of the driver carry no phones, addresses or structured data, so these operators run on markup, snippets and cards that
an expression builds from a row; the SQL works the expected answer out from the row, never by parsing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.functions import validate as V
from weftwork.functions.text import let
from weftwork.operators import extract, facts, maps, phones, resolve, state, structured
from weftwork.plans.registry import query, table
from weftwork.sources import dom, tables
from weftwork.sources.shared import spread

c = F.col


def _phone(key: str, nation: str) -> Column:
    """+7, an area code by nation (some not valid), seven digits of the key."""
    code = F.element_at(F.array(*map(F.lit, ("812", "495", "800", "921", "550", "804", "383"))), (c(nation) % 7 + 1).cast("int"))
    return F.concat(F.lit("+7"), code, F.lpad(c(key).cast("string"), 7, "0"))


_PHONE = "'+7' || ['812', '495', '800', '921', '550', '804', '383'][{1} % 7 + 1] || lpad({0}::varchar, 7, '0')"
_CP = _PHONE.format("c_custkey", "c_nationkey")
_VALID = "c_nationkey % 7 <> 4"


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name", "c_mktsegment", _phone("c_custkey", "c_nationkey").alias("phone"))


def _page(df: DataFrame, html: Column, key: str) -> DataFrame:
    """Parsed pages with `page_id` and `nodes`."""
    pages = spread(df).select(c(key).alias("page_id"), F.concat(F.lit("https://site"), c(key), F.lit(".example.com/")).alias("url"), html.alias("html"))
    return dom.with_nodes(pages)


def _html(*parts) -> Column:
    return F.concat(F.lit("<html><body>"), *[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit("</body></html>"))


@query(f"""select c_custkey, {_VALID} as valid, case when {_VALID} then [812, 495, 800, 921, 550, 804, 383][c_nationkey % 7 + 1] else -1 end as code,
  {_VALID} and c_nationkey % 7 = 3 as mobile, {_VALID} and c_nationkey % 7 = 2 as toll_free, {_VALID} and c_nationkey % 7 = 5 as service, c_nationkey % 7 in (0, 1, 6) as landline,
  regexp_replace({_CP}, '[^0-9]', '', 'g') as key from customer""")
def phone_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validity and class of phones, by area code."""
    p = _customers(spark, sf_dir).withColumn("code", V.area_code(c("phone")))
    return p.select("c_custkey", V.valid_phone(c("phone")).alias("valid"), "code", V.mobile_code(c("code")).alias("mobile"), V.toll_free(c("code")).alias("toll_free"), V.service_code(c("code")).alias("service"), phones.is_landline(c("phone")).alias("landline"), V.canonical_phone(c("phone")).alias("key"))


@query(f"""with t as (select c_custkey, c_nationkey, ['г. Москва', ' Санкт-Петербург ', 'Nowhere'][c_custkey % 3 + 1] as city from customer)
select c_custkey, lower(replace(trim(city), 'г. ', '')) as city_key,
  (c_custkey % 3 = 0 and c_nationkey % 7 = 1) or (c_custkey % 3 = 1 and c_nationkey % 7 = 0) as match,
  c_custkey % 3 < 2 and c_nationkey % 7 in (0, 1, 6) and not ((c_custkey % 3 = 0 and c_nationkey % 7 = 1) or (c_custkey % 3 = 1 and c_nationkey % 7 = 0)) as foreign from t""")
def city_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a landline is of the record's city or of another place."""
    city = F.element_at(F.array(*map(F.lit, ("г. Москва", " Санкт-Петербург ", "Nowhere"))), (c("c_custkey") % 3 + 1).cast("int"))
    p = _customers(spark, sf_dir).withColumn("city", city)
    return p.select("c_custkey", V.city_key(c("city")).alias("city_key"), V.city_membership(c("phone"), c("city")).alias("m")).select("c_custkey", "city_key", "m.*")


@query("""select p_partkey, p_partkey % 5 in (0, 3) as valid from part""")
def price_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.element_at(F.array(F.concat(F.lit("от "), c("p_retailprice").cast("string"), F.lit(" ₽")), F.lit("width: 10px;"), F.concat(F.lit("https://a.example/"), c("p_partkey").cast("string")), F.lit(" Бесплатно "), F.repeat(F.lit("1"), 61)), (c("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", V.valid_price(price).alias("valid"))


@query("""select s_suppkey, s_suppkey % 5 in (0, 1, 4) as valid, s_suppkey % 5 in (1, 3) as legal from supplier""")
def address_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Street addresses, registered seats, and what only looks like one."""
    k = c("s_suppkey").cast("string")
    a = F.element_at(F.array(F.concat(F.lit("ул. Садовая, д. "), k), F.concat(F.lit("ООО Ромашка, пр. Мира, "), k), F.concat(F.lit("меню, ул. Цветная "), k), F.concat(F.lit("ИНН 78"), k), F.concat(k, F.lit(" Long Street"))), (c("s_suppkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", V.valid_address(a).alias("valid"), V.legal_address(a).alias("legal"))


@query(f"""select c_custkey, 'ул. Лесная, д. ' || c_custkey as address, case when {_VALID} then {_CP} end as phone, (c_custkey + 100) || ' руб.' as price from customer""")
def snippet_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Address, phone and price out of a search snippet."""
    k = c("c_custkey").cast("string")
    text = F.concat(F.lit("Адрес: ул. Лесная, д. "), k, F.lit("\nтел "), c("phone"), F.lit("\nЦена: "), (c("c_custkey") + 100).cast("string"), F.lit(" руб.\n"))
    return _customers(spark, sf_dir).select("c_custkey", facts.snippet_facts(text).alias("f")).select("c_custkey", "f.*")


@query(f"""select s_suppkey, {_PHONE.format('s_suppkey', '0')} as phone, (s_suppkey + 5) || ' ₽' as price from supplier""")
def regex_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phone and price from text; digits in styles and scripts are none."""
    k = c("s_suppkey").cast("string")
    html = _html("<style>p{margin:8.1234567890em}</style><script>var x='+74950000000'</script><div class='widget'>Звоните ", _phone("s_suppkey", "zero"), "<br>Стоимость: ", (c("s_suppkey") + 5).cast("string"), " ₽</div>")
    s = table(spark, sf_dir, "supplier").withColumn("zero", F.lit(0))
    return s.select("s_suppkey", facts.markup_facts(dom.noise_free_html(html)).alias("f")).select("s_suppkey", "f.phone", "f.price")


@query("""select s_suppkey, case s_suppkey % 4 when 0 then 'Пн-Пт 10:00-' || (11 + s_suppkey % 10) || ':00' when 1 then '9:00-' || (11 + s_suppkey % 10) || ':00' when 2 then 'ежедневно; 10:00-20:00' end as hours from supplier""")
def hours_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opening hours beside or after their label."""
    end = (F.lit(11) + c("s_suppkey") % 10).cast("string")
    kind = c("s_suppkey") % 4
    block = F.when(kind == 0, F.concat(F.lit("<p>Часы работы: Пн-Пт 10:00-"), end, F.lit(":00</p>")))
    block = block.when(kind == 1, F.concat(F.lit("<dl><dt>Режим работы</dt><dd>9:00-"), end, F.lit(":00</dd></dl>")))
    block = block.when(kind == 2, F.lit("<div><b>Время работы</b><span>ежедневно\n10:00-20:00\nООО «Ромашка»</span></div>")).otherwise(F.lit("<p>Часы работы уточняйте</p>"))
    p = _page(table(spark, sf_dir, "supplier"), _html("<div>", block, "</div>"), "s_suppkey")
    return p.select(c("page_id").alias("s_suppkey"), extract.visible_hours(c("nodes")).alias("hours"))


def _contact_html() -> Column:
    """The phone in one of six places, by key: footer link, body link, tracking part, microdata, chat link, meta."""
    ph, d = c("phone"), F.regexp_replace("phone", r"\+", "")
    kinds = (
        ("<footer><a href='tel:", ph, "'>call</a></footer>"),
        ("<p><a href='tel:", ph, "'>", ph, "</a></p>"),
        ("<div class='calltouch-box'><a href='tel:", ph, "'>x</a></div>"),
        ("<span itemprop='telephone'>", ph, "</span>"),
        ("<a href='https://wa.me/", d, "?text=hi'>chat</a>"),
        ("<meta property='og:phone_number' content='", ph, "'>"),
    )
    out = None
    for i, parts in enumerate(kinds):
        part = F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
        out = F.when(c("c_custkey") % 6 == i, part) if out is None else out.when(c("c_custkey") % 6 == i, part)
    return _html("<div>", out, "</div>")


_TIERS = "[3, 2, 0, 1, 6, 1][c_custkey % 6 + 1]"


@query(f"""select c_custkey, {_CP} as value, case when c_nationkey % 7 = 2 then 0 else {_TIERS} end as tier, {_TIERS} as natural from customer where {_VALID}""")
def phone_finders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every structured finder: links, chat links, microdata, meta."""
    p = phones.with_candidates(_page(_customers(spark, sf_dir), _contact_html(), "c_custkey"))
    return p.select(c("page_id").alias("c_custkey"), F.explode("candidates").alias("x")).select("c_custkey", "x.value", phones.tier(c("x")).alias("tier"), "x.natural")


@query(f"""select c_custkey, {_CP} as phone, ['contacts', 'other', 'other', 'microdata', 'contacts', null][c_custkey % 6 + 1] as region from customer where {_VALID} and c_custkey % 6 < 5""")
def site_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _page(_customers(spark, sf_dir), _contact_html(), "c_custkey")
    return p.select(c("page_id").alias("c_custkey"), phones.site_contacts(c("nodes")).alias("s")).select("c_custkey", "s.*").filter("phone is not null")


def _vendor_html() -> Column:
    """A page with one of six call-tracking scripts, or none, by key; its number in the footer, and for some in a chat link."""
    tags = ("<script src='https://cloud.roistat.com/x.js'></script>", "<script>window.ct('init')</script>", "<script src='//app.comagic.ru/s.js'></script>", "<script>MangoObject=1</script>", "<script src='//cdn.callibri.ru/c.js'></script>", "<script>__uis.load()</script>", "<p>roistat.com</p>")
    tag = F.element_at(F.array(*map(F.lit, tags)), (c("c_custkey") % 7 + 1).cast("int"))
    chat = F.when(c("c_custkey") % 2 == 0, F.concat(F.lit("<a href='https://api.whatsapp.com/send?phone=7999"), F.lpad(c("c_custkey").cast("string"), 7, "0"), F.lit("'>chat</a>"))).otherwise("")
    return _html(tag, "<footer><a href='tel:", c("phone"), "'>call</a></footer>", chat)


@query("select c_custkey, ['roistat', 'calltouch', 'comagic', 'mango', 'callibri', 'uis', null][c_custkey % 7 + 1] as vendor from customer")
def dni_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The call-tracking vendor that is active on a page."""
    p = _page(_customers(spark, sf_dir), _vendor_html(), "c_custkey")
    return p.select(c("page_id").alias("c_custkey"), phones.vendor(c("nodes")).alias("vendor"))


@query(f"""with t as (select *, c_custkey % 7 < 6 as tracked, c_custkey % 2 = 0 as chat, {_VALID} as ok, '+7999' || lpad(c_custkey::varchar, 7, '0') as other from customer)
select c_custkey, case when tracked and chat then other when tracked then null when not ok and chat then other when c_nationkey % 7 = 2 and chat then other when ok then {_CP} end as value,
  (tracked and not chat and ok) as poisoned from t""")
def phone_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one phone of a page: with a tracker active only a chat link's number holds."""
    p = phones.with_candidates(_page(_customers(spark, sf_dir), _vendor_html(), "c_custkey"))
    return p.select(c("page_id").alias("c_custkey"), phones.pick(c("candidates"), F.lit(""), c("vendor")).alias("p")).select("c_custkey", "p.value", "p.poisoned")


@query(f"""with t as (select *, c_custkey % 7 < 6 as dni, {_VALID} as ok from customer),
n as (select c_custkey, {_CP} as value, 'contacts' as source, true as anchored, dni, not dni as trustworthy, 3 as r from t where ok
  union all select c_custkey, '+7999' || lpad(c_custkey::varchar, 7, '0'), 'social_link', true, dni, true, 6 from t where c_custkey % 2 = 0)
select c_custkey, (row_number() over (partition by c_custkey order by r desc))::int as place, value, source, anchored, dni, trustworthy, '' as role from n""")
def site_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All numbers of a page with their source and trust."""
    n = phones.site_numbers(_page(_customers(spark, sf_dir), _vendor_html(), "c_custkey"))
    return n.select(c("page_id").alias("c_custkey"), "place", "value", "source", "anchored", "dni", "trustworthy", "role")


@query(f"""select c_custkey // 50 as chain, {_CP} as value, 'branch_json' as source from customer where {_VALID}
union all select c_custkey // 50, '+7812' || lpad((c_custkey + 9000000)::varchar, 7, '0'), 'schema_place' from customer where c_custkey // 50 in (select c_custkey // 50 from customer group by 1 having count(*) > 1)""")
def branch_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain's branches from a script's JSON text and from several schema.org places; fifty customers make a chain."""
    b = _customers(spark, sf_dir).groupBy(F.expr("c_custkey div 50").alias("chain")).agg(F.sort_array(F.collect_list(F.struct("c_custkey", "phone"))).alias("b"))
    flat = F.array_join(F.transform("b", lambda x: F.concat(F.lit('{"id": '), x.c_custkey.cast("string"), F.lit(', "phone": "'), x.phone, F.lit('", "tel": 78125550000}'))), ", ")
    graph = F.array_join(F.transform("b", lambda x: F.concat(F.lit('{"@type": "Store", "telephone": "+7812'), F.lpad((x.c_custkey + 9000000).cast("string"), 7, "0"), F.lit('"}'))), ", ")
    html = _html("<script>var branches = '[", flat, "]';</script><script type='application/ld+json'>{\"@graph\": [", graph, "]}</script>")
    n = phones.site_numbers(_page(b, html, "chain"))
    return n.select(c("page_id").alias("chain"), "value", "source")


@query(f"""select c_custkey, {_CP} as value, 'contacts' as source from customer where {_VALID} and c_custkey % 3 < 2""")
def plain_text_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phones printed near a phone label; numbers in a block of identifiers are none."""
    kinds = F.element_at(F.array(F.concat(F.lit("<div><b>Телефон:</b> <span>"), c("phone"), F.lit("</span></div>")), F.concat(F.lit("<div><p>тел.</p></div><div>"), c("phone"), F.lit("</div>")), F.concat(F.lit("<div>Телефон, ИНН "), c("phone"), F.lit("</div>"))), (c("c_custkey") % 3 + 1).cast("int"))
    n = phones.site_numbers(_page(_customers(spark, sf_dir), _html("<section>", kinds, "</section>"), "c_custkey"))
    return n.select(c("page_id").alias("c_custkey"), "value", "source")


@query(f"""select s_suppkey, {_PHONE.format('s_suppkey', '1')} as value, ['departmental', '', 'departmental', ''][s_suppkey % 4 + 1] as role,
  ['Бухгалтерия', 'Общий отдел', 'Факс:', ''][s_suppkey % 4 + 1] as role_label_raw from supplier""")
def phone_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a number is a department's, by the text before it."""
    s = table(spark, sf_dir, "supplier").withColumn("one", F.lit(1))
    link = F.concat(F.lit("<a href='tel:"), _phone("s_suppkey", "one"), F.lit("'>call</a>"))
    kind = c("s_suppkey") % 4
    block = F.when(kind == 0, F.concat(F.lit("<h3>Бухгалтерия</h3><p>"), link, F.lit("</p>"))).when(kind == 1, F.concat(F.lit("<h3>Общий  отдел</h3><p>"), link, F.lit("</p>"))).when(kind == 2, F.concat(F.lit("<p>Факс: "), link, F.lit("</p>"))).otherwise(F.concat(F.lit("<nav>Бухгалтерия</nav><p>"), link, F.lit("</p>")))
    n = phones.site_numbers(_page(s, _html("<footer>", block, "</footer>"), "s_suppkey"))
    return n.select(c("page_id").alias("s_suppkey"), "value", "role", "role_label_raw")


@query("""select s_suppkey, 'https://site' || s_suppkey || '.example.com' || ['/contacts', '/about', '/page/5', '/%D0%BA%D0%BE%D0%BD%D1%82%D0%B0%D0%BA%D1%82%D1%8B', null][s_suppkey % 5 + 1] as contacts from supplier""")
def contacts_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The link that best looks like a contacts page."""
    links = ("<a href='/about'>About</a><a href='contacts#x'>c</a>", "<a href='https://other.example.com/contacts'>x</a><a href='/about'>x</a>", "<a href='/news'>n</a><a href='/page/5'> Контакты </a>", "<a href='/контакты'>тут</a><a href='/about'>Контакты</a>", "<a href='#contacts'>Контакты</a><a href='mailto:a@b.example'>contact</a>")
    block = F.element_at(F.array(*map(F.lit, links)), (c("s_suppkey") % 5 + 1).cast("int"))
    p = _page(table(spark, sf_dir, "supplier"), _html("<nav>", block, "</nav>"), "s_suppkey")
    return p.select(c("page_id").alias("s_suppkey"), extract.contacts_page(c("nodes"), c("url")).alias("contacts"))


def _ld(body: Column) -> Column:
    return _html("<script type='application/ld+json'>", body, "</script>")


@query("""select s_suppkey, s_name as name, 'Museum' as kind, 'ул. Мира, ' || s_suppkey || ', Город' as address, 'Monday,Friday 10:00-22:00' as hours, s_suppkey || ' EUR' as price from supplier""")
def jsonld_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("s_suppkey").cast("string")
    body = F.concat(F.lit('[{"@type": "Article", "name": "x"}, {"@type": "https://schema.org/Museum", "name": " '), c("s_name"), F.lit(' ", "address": {"streetAddress": "ул. Мира, '), k, F.lit('", "addressLocality": "Город"}, "offers": {"price": "'), k, F.lit(' EUR"}, "openingHoursSpecification": [{"dayOfWeek": ["https://schema.org/Monday", "Friday"], "opens": "10:00", "closes": "22:00"}]}]'))
    p = _page(table(spark, sf_dir, "supplier"), _ld(body), "s_suppkey")
    return p.select(c("page_id").alias("s_suppkey"), let(structured.first_of(structured.items(c("nodes")), dom.P.PLACE_TYPES), structured.place).alias("p")).select("s_suppkey", "p.name", "p.kind", "p.address", "p.hours", "p.price")


@query("""select p_partkey, p_name as headline, p_brand as author, '2024-05-0' || (p_partkey % 9 + 1) as published from part""")
def jsonld_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit('{"@type": ["NewsArticle"], "name": "'), c("p_name"), F.lit('", "author": {"@type": "Person", "name": "'), c("p_brand"), F.lit('"}, "datePublished": "2024-05-0'), (c("p_partkey") % 9 + 1).cast("string"), F.lit('"}'))
    p = _page(table(spark, sf_dir, "part"), _ld(body), "p_partkey")
    return p.select(c("page_id").alias("p_partkey"), let(structured.first_of(structured.items(c("nodes")), dom.P.ARTICLE_TYPES), structured.article).alias("a")).select("p_partkey", "a.headline", "a.author", "a.published")


@query("""select s_suppkey, s_name as name, '2025-01-01' as start, 'Hall ' || s_suppkey as location, '10' as price from supplier""")
def jsonld_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit('{"@type": "Event", "name": "'), c("s_name"), F.lit('", "startDate": "2025-01-01", "location": {"name": "Hall '), c("s_suppkey").cast("string"), F.lit('"}, "offers": [{"price": 10}]}'))
    p = _page(table(spark, sf_dir, "supplier"), _ld(body), "s_suppkey")
    return p.select(c("page_id").alias("s_suppkey"), structured.event(structured.first_of(structured.items(c("nodes")), ("Event",))).alias("e")).select("s_suppkey", "e.name", "e.start", "e.location", "e.price")


@query("""select s_suppkey, s_name as name, s_suppkey % 2 = 0 as legal_id, 'ул. Мира, ' || s_suppkey as address from supplier""")
def jsonld_org(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("s_suppkey").cast("string")
    extra = F.when(c("s_suppkey") % 2 == 0, F.lit(', "taxID": "7812"')).otherwise(F.lit(', "slogan": "инновация"'))
    body = F.concat(F.lit('{"@type": "Organization", "name": "'), c("s_name"), F.lit('", "address": "ул. Мира, '), k, F.lit('"'), extra, F.lit("}"))
    p = _page(table(spark, sf_dir, "supplier"), _ld(body), "s_suppkey")
    return p.select(c("page_id").alias("s_suppkey"), let(structured.first_of(structured.items(c("nodes")), dom.P.ORGANIZATION_TYPES), structured.organization).alias("o")).select("s_suppkey", "o.name", "o.legal_id", "o.address")


@query("""select s_suppkey, s_name as name, 'ул. Мира, ' || s_suppkey as address, '+7812555' || lpad(s_suppkey::varchar, 4, '0') as phone from supplier""")
def microdata_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("s_suppkey").cast("string")
    html = _html("<div itemscope itemtype='http://schema.org/Store'><b itemprop='name'>", c("s_name"), "</b><div itemprop='address' itemscope itemtype='http://schema.org/PostalAddress'><i itemprop='streetAddress'>ул. Мира, ", k, "</i></div><meta itemprop='telephone' content='+7812555", F.lpad(k, 4, "0"), "'></div>")
    p = _page(table(spark, sf_dir, "supplier"), html, "s_suppkey")
    return p.select(c("page_id").alias("s_suppkey"), let(structured.first_of(structured.items(c("nodes")), dom.P.PLACE_TYPES), structured.place).alias("p")).select("s_suppkey", "p.name", "p.address", "p.phone")


def _supplier_page() -> Column:
    k = c("s_suppkey").cast("string")
    org = F.concat(F.lit('{"@type": "Organization", "name": "'), c("s_name"), F.lit('", "legalName": "ООО", "address": "пр. Ленина, д. '), k, F.lit('", "telephone": "+74950000000"}'))
    return _html("<script type='application/ld+json'>", org, "</script><p>Цена: ", k, " руб.</p><footer><address>ул. Садовая, д. ", k, "</address><a href='tel:+7812555", F.lpad(k, 4, "0"), "'>x</a><a href='mailto:a", k, "@b.example?subject=x'>m</a><p>Часы работы: 10:00-20:00</p></footer>")


_SUPPLIER_FACTS = "select s_suppkey, s_name as place_name, 'ул. Садовая, д. ' || s_suppkey as address, 'пр. Ленина, д. ' || s_suppkey as legal_address, '+7812555' || lpad(s_suppkey::varchar, 4, '0') as phone, '10:00-20:00' as hours, s_suppkey || ' руб.' as price, 'a' || s_suppkey || '@b.example' as email, false as phone_poisoned from supplier"


def _supplier_facts(spark: SparkSession, sf_dir: str, html: Column | None = None) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    html = _supplier_page() if html is None else html
    pages = s.select(c("s_suppkey").alias("page_id"), F.concat(F.lit("https://site"), c("s_suppkey"), F.lit(".example.com/")).alias("url"), html.alias("html"), F.lit("").alias("city"))
    return facts.page_facts(pages).withColumnRenamed("page_id", "s_suppkey")


@query(_SUPPLIER_FACTS)
def facts_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All facts of a page by the cascade: the footer's phone replaces the structured one, seats and venues are told apart."""
    return _supplier_facts(spark, sf_dir).select("s_suppkey", "place_name", "address", "legal_address", "phone", "hours", "price", "email", "phone_poisoned")


@query("""select s_suppkey, [5, 0, 0, 1][s_suppkey % 4 + 1] as n, s_suppkey % 4 in (0, 3) as contacts, s_suppkey % 4 <> 2 as any_fact, s_suppkey % 4 in (0, 3) or s_suppkey % 8 = 2 as sufficient,
  case when s_suppkey % 8 = 3 then 'thin_content' when s_suppkey % 4 = 1 or s_suppkey % 8 = 6 then 'absent_contacts' end as reason from supplier""")
def render_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much a page tells and whether it need be rendered: whole pages, a bare name, nothing (half with a number that
    stands in a contact area), an address of e-mail alone (half with a thin text)."""
    name = F.concat(F.lit("<script type='application/ld+json'>{\"@type\": \"Organization\", \"name\": \""), c("s_name"), F.lit("\"}</script>"))
    page = F.element_at(F.array(_supplier_page(), _html(name), _html("<p>hello</p>"), _html("<footer><a href='mailto:a@b.example'>m</a></footer>")), (c("s_suppkey") % 4 + 1).cast("int"))
    f = _supplier_facts(spark, sf_dir, page).withColumn("enough", facts.raw_is_sufficient(facts.has_contacts(), c("phone_poisoned"), c("s_suppkey") % 8 == 2))
    return f.select("s_suppkey", facts.contact_count().alias("n"), facts.has_contacts().alias("contacts"), facts.has_any_fact().alias("any_fact"), c("enough").alias("sufficient"), facts.render_reason(c("s_suppkey") % 8 == 3, c("enough")).alias("reason"))


@query("select p_partkey, case when p_partkey % 3 = 0 then 'https://img.example/' || p_partkey end as image, case p_partkey % 3 when 0 then '2024-02-03' when 1 then '2023-01-02T03:04' else '2022-11-09' end as published from part")
def og_image_and_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("p_partkey").cast("string")
    kind = c("p_partkey") % 3
    head = F.when(kind == 0, F.concat(F.lit("<meta property='og:image' content=' https://img.example/"), k, F.lit(" '><meta property='article:published_time' content='2024-02-03'>"))).when(kind == 1, F.lit("<time datetime='2023-01-02T03:04'>x</time>")).otherwise(F.lit("<meta property='og:image' content=''>"))
    pages = spread(table(spark, sf_dir, "part").select("p_partkey")).select(c("p_partkey").alias("page_id"), F.concat(F.lit("https://a.example/2022/11/09/"), k).alias("url"), _html(head).alias("html"))
    return dom.with_nodes(pages).select(c("page_id").alias("p_partkey"), extract.image(c("nodes")).alias("image"), extract.published(c("nodes"), c("url")).alias("published"))


@query("select user_id, event_id, value from (select *, row_number() over (partition by user_id order by value desc, event_id) as k from events) where k = 1")
def keep_strongest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest reading of each key, the first of equals."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return phones.keep_strongest(e, c("user_id").cast("string"), c("value"), c("event_id")).select("user_id", "event_id", "value")


@query("""select user_id, case when count(*) filter (where event_type <> 'error') > 0 then '' else 'departmental' end as role,
  coalesce(arg_min(event_type, event_id) filter (where event_type <> 'error'), arg_min(event_type, event_id)) as label from events group by 1""")
def role_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number is general if any reading of it is."""
    e = table(spark, sf_dir, "events").select("user_id", c("event_id").alias("seq"), c("event_type").alias("label"), F.when(c("event_type") == "error", "departmental").otherwise("").alias("role"))
    return phones.reduce_roles(e, ["user_id"])


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as claims on two fields of their customer: the source by order key."""
    o = table(spark, sf_dir, "orders")
    source = F.element_at(F.array(*map(F.lit, ("search", "maps", "official_site", "operator_verified"))), (c("o_orderkey") % 4 + 1).cast("int"))
    return o.select(c("o_custkey").alias("item_pos"), F.when(c("o_orderkey") % 2 == 0, "hours").otherwise("address").alias("field"), c("o_orderpriority").alias("value"), source.alias("source"), c("o_orderkey").alias("seq"), resolve.confidence(source, c("o_orderstatus") == "F").alias("confidence"))


_CLAIMS = """claims as (select o_custkey as item_pos, case when o_orderkey % 2 = 0 then 'hours' else 'address' end as field, o_orderpriority as value, o_orderkey as seq,
  ['search', 'maps', 'official_site', 'operator_verified'][o_orderkey % 4 + 1] as source, [1, 2, 4, 6][o_orderkey % 4 + 1] as rank,
  case when o_orderkey % 4 >= 2 then 'high' when o_orderkey % 4 = 1 and o_orderstatus = 'F' then 'medium' else 'low' end as confidence from orders)"""


@query(f"""with {_CLAIMS}, r as (select *, row_number() over (partition by item_pos, field order by rank desc, case when field = 'address' and rank = 4 then length(value) else 0 end desc, case when field = 'address' and rank = 4 then -seq else seq end desc) as k from claims)
select item_pos, field, value, source, confidence from r where k = 1""")
def resolve_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The winner of each field by rank, then the last (for addresses of a site: the longer)."""
    return resolve.resolve(_claims(spark, sf_dir)).select("item_pos", "field", "value", "source", "confidence")


@query(f"""with {_CLAIMS}, r as (select *, row_number() over (partition by item_pos, field order by rank desc, case when field = 'address' and rank = 4 then length(value) else 0 end desc, case when field = 'address' and rank = 4 then -seq else seq end desc) as k from claims),
w as (select * from r where k = 1)
select item_pos, max(value) filter (where field = 'hours') as hours, max(source) filter (where field = 'hours') as hours_source, max(confidence) filter (where field = 'hours') as hours_confidence,
  max(value) filter (where field = 'address') as address, max(source) filter (where field = 'address') as address_source, max(confidence) filter (where field = 'address') as address_confidence, false as phone_poisoned from w group by 1""")
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an item with the source and confidence of each field."""
    return resolve.provenance(resolve.resolve(_claims(spark, sf_dir)), ["hours", "address"])


@query("""with p as (select p_size as item_pos, p_name || ' ' || p_type as value, p_partkey as seq from part), r as (select *, row_number() over (partition by item_pos order by length(value) desc, seq) as k from p)
select item_pos, value from r where k = 1""")
def resolve_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of one site rank: the longest, the first of equals."""
    p = table(spark, sf_dir, "part").select(c("p_size").alias("item_pos"), F.lit("address").alias("field"), F.concat_ws(" ", "p_name", "p_type").alias("value"), F.lit("official_site").alias("source"), c("p_partkey").alias("seq"), F.lit("high").alias("confidence"))
    return resolve.resolve(p).select("item_pos", "value")


@query("""select c_custkey as item_pos, case c_custkey % 4 when 0 then c_name when 3 then c_name end as value, case c_custkey % 4 when 0 then 'operator_verified' when 3 then 'official_site' else 'poison_locked' end as source, c_custkey % 4 <> 3 as poisoned from customer""")
def resolve_poison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A poison verdict locks the phone against sites and maps, not against the operator, and not after a site's phone."""
    k = table(spark, sf_dir, "customer").select(c("c_custkey").alias("item_pos"), "c_name", (c("c_custkey") % 4).alias("kind"))
    source = F.element_at(F.array(*map(F.lit, ("operator_verified", "maps", "official_site", "official_site"))), (c("kind") + 1).cast("int"))
    seq = F.when(c("kind") == 3, 0).otherwise(2)
    one = k.select("item_pos", F.lit("phone").alias("field"), c("c_name").alias("value"), source.alias("source"), seq.alias("seq"), F.lit("high").alias("confidence"))
    return resolve.resolve(one.unionByName(resolve.poison(k, 1))).select("item_pos", "value", "source", "poisoned")


@query("""with two as (select o_custkey, o_orderkey % 2 as side, arg_max(o_orderpriority, o_orderkey) as v from orders group by 1, 2)
select a.o_custkey as item_pos, (a.v <> b.v)::int as conflicts from two a join two b on a.o_custkey = b.o_custkey where a.side = 0 and b.side = 1""")
def resolve_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of two sources that disagree."""
    two = table(spark, sf_dir, "orders").groupBy("o_custkey", (c("o_orderkey") % 2).alias("side")).agg(F.max_by("o_orderpriority", "o_orderkey").alias("value"))
    rows = two.select(c("o_custkey").alias("item_pos"), F.lit("hours").alias("field"), "value", F.when(c("side") == 0, "maps").otherwise("official_site").alias("source"), c("side").alias("seq"))
    both = rows.groupBy("item_pos").count().filter("count = 2").select("item_pos")
    return resolve.conflicts(rows.join(both, "item_pos")).select("item_pos", "conflicts")


@query("""select o_orderkey, case when o_orderkey % 3 = 0 and not (o_orderkey % 2 = 0 and o_orderstatus = 'F') then 'closed' else case when o_orderstatus = 'F' then 'active' else 'unreachable' end end as status from orders""")
def closed_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A live site refutes a map's closed verdict."""
    site = F.when(c("o_orderstatus") == "F", "active").otherwise("unreachable")
    verdict = F.when(c("o_orderkey") % 3 == 0, "permanently_closed").otherwise("open")
    return table(spark, sf_dir, "orders").select("o_orderkey", resolve.closed_status(site, verdict, c("o_orderkey") % 2 == 0).alias("status"))


@query("""select s_suppkey, s_suppkey % 3 = 0 as same, case s_suppkey % 3 when 0 then 'невский' when 1 then 'литейный' else '' end as hint from supplier""")
def address_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two addresses share a distinctive word; the words themselves."""
    k = c("s_suppkey").cast("string")
    a = F.element_at(F.array(F.concat(F.lit("СПб, Невский пр., д. "), k), F.concat(F.lit("Литейный проспект, "), k), F.concat(F.lit("Большая ул., "), k)), (c("s_suppkey") % 3 + 1).cast("int"))
    b = F.concat(F.lit("Санкт Петербург, Невский проспект, "), k)
    return table(spark, sf_dir, "supplier").select("s_suppkey", maps.addresses_overlap(a, b, F.lit("Санкт-Петербург")).alias("same"), maps.street_hint(a, F.lit("Санкт-Петербург")).alias("hint"))


@query("""select s_suppkey, case when s_suppkey % 3 = 1 then s_name end as geo_name, case when s_suppkey % 3 = 1 then s_suppkey + 0.5 end::double as latitude, case when s_suppkey % 3 < 2 then 'addr ' || s_suppkey end as cleaned from supplier""")
def geocode_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only buildings with a point, only addresses exact to the house."""
    k = c("s_suppkey").cast("string")
    kind = F.element_at(F.array(*map(F.lit, ("street", "building", "adm_div"))), (c("s_suppkey") % 3 + 1).cast("int"))
    geo = F.concat(F.lit('{"result": {"items": [{"name": "zero", "type": "building", "point": {"lat": 0, "lon": 0}}, {"name": "'), c("s_name"), F.lit('", "type": "'), kind, F.lit('", "point": {"lat": '), k, F.lit('.5, "lon": 30}}]}}'))
    clean = F.concat(F.lit('[{"result": "addr '), k, F.lit('", "geo_lat": "59.9", "geo_lon": "30.3", "qc_geo": '), (c("s_suppkey") % 3).cast("string"), F.lit("}]"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", maps.geocoded(geo).alias("g"), maps.cleaned_address(clean).alias("d"))
    return s.select("s_suppkey", c("g.name").alias("geo_name"), "g.latitude", c("d.address").alias("cleaned"))


@query("""select s_suppkey, case when s_suppkey % 2 = 0 then 'open' else 'not_found' end as status, case when s_suppkey % 2 = 0 then s_name end as name, case when s_suppkey % 2 = 0 then '+7812' || s_suppkey end as phone,
  case when s_suppkey % 2 = 0 then 'http://shop' || s_suppkey || '.example' end as website from supplier""")
def catalogue_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue's card, refused where its street is another one."""
    k = c("s_suppkey").cast("string")
    body = F.concat(F.lit('{"result": {"items": [{"name": "'), c("s_name"), F.lit('", "address_name": "Невский проспект, 1", "contact_groups": [{"contacts": [{"type": "email", "value": "a@b"}, {"type": "phone", "value": "+7812'), k, F.lit('"}]}, {"contacts": [{"type": "website", "value": "http://link.2gis.ru/1?http://shop'), k, F.lit('.example"}]}]}]}}'))
    asked = F.when(c("s_suppkey") % 2 == 0, "Невский пр. 5").otherwise("Литейный пр. 5")
    return table(spark, sf_dir, "supplier").select("s_suppkey", maps.catalogue_card(body, asked, F.lit("Москва")).alias("m")).select("s_suppkey", "m.status", "m.name", "m.phone", "m.website")


@query("""select s_suppkey, ['open', 'permanently_closed'][s_suppkey % 2 + 1] as status, s_name as name, 'addr ' || s_suppkey as address, '+7' || s_suppkey as phone, 'http://s' || s_suppkey || '.example' as website, (s_suppkey % 5 + 0.5)::double as rating,
  case when s_suppkey % 2 = 0 then 60.0 else 30.0 end::double as latitude, 'Cafe, Bar' as categories from supplier""")
def org_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organization pages of the new format (read as JSON) and of the old one (read by patterns)."""
    k = c("s_suppkey").cast("string")
    rating = F.concat((c("s_suppkey") % 5).cast("string"), F.lit(".5"))
    new = F.concat(F.lit('<html><script>window.x = {"a": 1, "org": {"status": "open", "shortTitle": "'), c("s_name"), F.lit('", "fullAddress": "addr '), k, F.lit('", "phones": [{"number": "+7'), k, F.lit('"}], "urls": ["http://s'), k, F.lit('.example"], "ratingData": {"ratingValue": '), rating, F.lit('}, "coordinates": [30.0, 60.0], "categories": [{"name": "Cafe"}, {"name": "Bar"}, {"name": "Cafe"}], "note": "a } b"}};</script></html>'))
    old = F.concat(F.lit('<html><script>{"status": "permanent-closed", "name": "'), c("s_name"), F.lit('", "address": {"formatted": "addr '), k, F.lit('"}, "phones": [{"formatted": "+7'), k, F.lit('"}], "urls": [{"value": "http://s'), k, F.lit('.example"}], "rating": {"score": '), rating, F.lit('}, "coordinates": [30.0, 60.0], "rubrics": [{"name": "Cafe"}, {"name": "Bar"}]}</script></html>'))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(c("s_suppkey") % 2 == 0, new).otherwise(old).alias("html"))
    return maps.organization(s).select("s_suppkey", "org.status", "org.name", "org.address", "org.phone", "org.website", "org.rating", "org.latitude", "org.categories")


@query("""with p as (select o_custkey as item_pos, o_orderkey as ord, case when o_orderstatus = 'F' then 'open' when o_orderstatus = 'O' then 'permanently_closed' else 'temporarily_closed' end as status from orders)
select item_pos, coalesce(arg_min(status, ord) filter (where status <> 'permanently_closed'), arg_min(status, ord)) as status, 'u' || coalesce(min(ord) filter (where status <> 'permanently_closed'), min(ord)) as page from p group by 1""")
def org_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of an item's organization pages the first that is not closed for good."""
    status = F.when(c("o_orderstatus") == "F", "open").when(c("o_orderstatus") == "O", "permanently_closed").otherwise("temporarily_closed")
    p = table(spark, sf_dir, "orders").select(c("o_custkey").alias("item_pos"), c("o_orderkey").alias("ord"), status.alias("status"), F.concat(F.lit("u"), "o_orderkey").alias("url"))
    return maps.preferred_page(p)


@query("""with k as (select o_custkey as item_pos, o_orderkey as o, case when o_orderkey % 5 = 0 then 'timeout' end as error, case when o_orderkey % 3 = 0 then 'open' else 'not_found' end as status, 'b' || o_orderkey as backend from orders)
select item_pos, coalesce(arg_min(backend, o) filter (where error is null and status = 'open'), arg_max(backend, o) filter (where error is null)) as backend,
  case when count(*) filter (where error is null and status = 'open') > 0 then 'open' else 'not_found' end as status from k group by 1""")
def composite_checker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first backend that found the place; failed ones are passed over."""
    o = table(spark, sf_dir, "orders")
    return maps.first_answer(o.select(c("o_custkey").alias("item_pos"), c("o_orderkey").alias("backend_ord"), F.concat(F.lit("b"), "o_orderkey").alias("backend"), F.when(c("o_orderkey") % 3 == 0, "open").otherwise("not_found").alias("status"), F.when(c("o_orderkey") % 5 == 0, "timeout").alias("error")))


def _puts_gets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events")
    puts = e.filter("event_type in ('click', 'error')").select(c("user_id").cast("string").alias("cache_key"), c("ts").alias("put_at"), F.when(c("event_type") == "error", 0).otherwise(3600).cast("long").alias("ttl_seconds"), c("event_id").cast("string").alias("value"))
    return puts, e.filter("event_type = 'view'").select(c("event_id").alias("get_id"), c("user_id").cast("string").alias("cache_key"), c("ts").alias("get_at"))


@query("""with g as (select event_id as get_id, user_id, ts from events where event_type = 'view'), p as (select event_id, user_id, ts, case when event_type = 'error' then 0 else 3600 end as ttl from events where event_type in ('click', 'error'))
select get_id, g.user_id::varchar as cache_key, case when p.ttl = 0 or g.ts - p.ts < to_seconds(p.ttl) then p.event_id::varchar end as value from g asof left join p on g.user_id = p.user_id and g.ts >= p.ts""")
def cache_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cache with expiry gives for each get."""
    return state.cache_hits(*_puts_gets(spark, sf_dir))


@query("""with recursive e as (select user_id::varchar as cache_key, event_id, epoch_us(ts) as us, case event_type when 'click' then 0 when 'error' then 1 else 2 end as kind from events where event_type in ('click', 'error', 'view')),
o as (select *, row_number() over (partition by cache_key order by us, kind, case when kind = 2 then event_id else 0 end) as k from e),
f as (select cache_key, 0::bigint as k, null::varchar as v1, 0::bigint as until, null::varchar as v2, null::bigint as get_id, null::varchar as value, null::varchar as level from (select distinct cache_key from o)
  union all select o.cache_key, o.k, case when kind = 0 then event_id::varchar when kind = 2 and not (v1 is not null and us < until) and v2 is not null then v2 else v1 end,
    case when kind = 0 then us + 3600000000 when kind = 2 and not (v1 is not null and us < until) and v2 is not null then us + 300000000 else until end,
    case when kind = 1 then event_id::varchar else v2 end, case when kind = 2 then event_id end,
    case when kind = 2 then case when v1 is not null and us < until then v1 else v2 end end,
    case when kind = 2 then case when v1 is not null and us < until then 'first' when v2 is not null then 'second' else 'miss' end end
  from f join o on o.cache_key = f.cache_key and o.k = f.k + 1)
select cache_key, get_id, value, level from f where get_id is not null""")
def cache_tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tiers with promotion."""
    puts, gets = _puts_gets(spark, sf_dir)
    return state.tiered_hits(puts.filter("ttl_seconds > 0"), puts.filter("ttl_seconds = 0"), gets)


@query("""with r as (select event_id, user_id, event_type = 'error' as failed, sum(case when event_type = 'error' then 0 else 1 end) over (partition by user_id order by event_id rows unbounded preceding) as run from events),
s as (select *, case when failed then sum(failed::int) over (partition by user_id, run order by event_id rows unbounded preceding) else 0 end::bigint as streak from r)
select event_id, streak, case when streak > 0 then least(600, 30 * pow(2, least(streak - 1, 8)))::int else 0 end as suspend_s from s""")
def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors in a row and the suspension that each causes."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", (c("event_type") == "error").alias("failed"))
    return state.error_streaks(e, "user_id", ["event_id"], c("failed")).select("event_id", "streak", "suspend_s")


@query("""with recursive e as (select user_id, event_id, ts, epoch_us(ts) as us, event_type, row_number() over (partition by user_id order by epoch_us(ts), event_id) as k from events),
f as (select user_id, 0::bigint as k, null::bigint as seq, 0 as errors, -1::bigint as until, '' as outcome from (select distinct user_id from e)
  union all select e.user_id, e.k, e.event_id, case when us < until then errors when event_type = 'error' then errors + 1 else 0 end,
    case when us < until then until when event_type = 'error' then us + least(600, 30 * (1 << least(errors, 8))) * 1000000 else -1 end,
    case when us < until then 'suspended' when event_type = 'error' then 'error' else 'success' end
  from f join e on e.user_id = f.user_id and e.k = f.k + 1)
select user_id, seq, outcome from f where seq is not null""")
def breaker_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls through a breaker, suspended ones told."""
    e = table(spark, sf_dir, "events").select("user_id", c("event_id").alias("seq"), "ts", (c("event_type") == "error").alias("failed"))
    return state.breaker(e, "user_id", "ts", "failed")


@query("""with recursive e as (select user_id, event_id, ts, epoch_us(ts) as us, event_type, row_number() over (partition by user_id order by epoch_us(ts), event_id) as k from events),
f as (select user_id, 0::bigint as k, null::bigint as seq, 2.0::double as tokens, -1.0::double as seen from (select distinct user_id from e)
  union all select user_id, k, event_id, have + wait * 0.01 - 1, now + wait from (select *, greatest(0.0, (1 - have) / 0.01::double) as wait from (
    select e.user_id, e.k, e.event_id, greatest(us / 1000000.0::double, seen) as now, case when seen < 0 then tokens else least(2.0, tokens + (greatest(us / 1000000.0::double, seen) - seen) * 0.01::double) end as have
    from f join e on e.user_id = f.user_id and e.k = f.k + 1)))
select user_id, seq, round(seen, 3) as start_s from f where seq is not null""")
def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When calls may start under a rate limit."""
    e = table(spark, sf_dir, "events").select("user_id", c("event_id").alias("seq"), "ts")
    return state.throttled(e, "user_id", "ts", 0.01, 2).withColumn("start_s", F.round("start_s", 3))


@query("""select c_custkey, case when c_custkey % 3 = 0 then 'item:search:v1:' || c_name else 'item:v1:https://a.example/' || c_custkey end || ':seed:' ||
  case when c_custkey % 2 = 0 then 'none' else substr(sha256('"' || c_name || '"|""|""|""|"' || c_mktsegment || '"|""'), 1, 16) end || case when c_custkey % 5 = 0 then ':nomaps' else '' end as cache_key from customer""")
def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record's identity in the cache."""
    odd = c("c_custkey") % 2 == 1
    none = F.lit("")
    seed = state.seed_print(F.when(odd, c("c_name")), none, none, none, F.when(odd, c("c_mktsegment")), none)
    url = F.when(c("c_custkey") % 3 != 0, F.concat(F.lit("https://a.example/"), c("c_custkey").cast("string")))
    return table(spark, sf_dir, "customer").select("c_custkey", state.cache_key(url, c("c_name"), seed, c("c_custkey") % 5 == 0).alias("cache_key"))


@query("""select o_orderkey, case o_orderkey % 6 when 0 then 'active' when 1 then 'redirect' when 2 then 'not_found' when 3 then 'unreachable' when 4 then 'unreachable' else 'unreachable' end as status, o_orderkey % 6 in (3, 5) as transient from orders""")
def page_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fetch's status from its code and final address; what is worth another try."""
    kind = (c("o_orderkey") % 6).cast("int")
    code = F.element_at(F.array(*map(F.lit, (200, 200, 404, 503, 500, 0))), kind + 1)
    f = table(spark, sf_dir, "orders").select("o_orderkey", F.lit("https://a.example/x").alias("url"), F.when(kind == 1, "https://b.example/").otherwise("https://a.example/y").alias("final_url"), code.alias("status_code"))
    f = f.withColumn("status", tables.page_status(c("url"), c("final_url"), c("status_code")))
    return f.select("o_orderkey", "status", tables.is_transient(c("status"), c("status_code")).alias("transient"))


@query("""with a as (select o_custkey, o_orderkey, o_orderkey % 3 = 0 as transient from orders)
select 'https://c' || o_custkey || '.example/' as url, coalesce(min(o_orderkey) filter (where not transient), max(o_orderkey)) as attempt from a group by o_custkey""")
def fetch_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attempt that counts of each address: the first that was not transient, else the last."""
    o = table(spark, sf_dir, "orders")
    f = o.select(F.concat(F.lit("https://c"), "o_custkey", F.lit(".example/")).alias("url"), c("o_orderkey").alias("attempt"), F.lit("<p>x</p>").alias("html"), F.when(c("o_orderkey") % 3 == 0, 503).otherwise(200).alias("status_code"), F.lit(None).cast("string").alias("final_url"), F.lit(False).alias("tls_error"))
    return tables.settled(f).select("url", "attempt")


@query("""with recursive e as (select user_id % 20 as backend, event_id, event_id * 7 as moment, event_type = 'error' or value > 100 as wrong, event_id % 5 = 0 as mute, event_id % 3 = 0 as gone,
    row_number() over (partition by user_id % 20 order by event_id) as k from events),
f as (select backend, 0::bigint as k, null::bigint as seq, 0 as errors, -1::bigint as until, '' as outcome from (select distinct backend from e)
  union all select e.backend, e.k, e.event_id, case when moment < until or wrong and gone then errors when wrong or mute then errors + 1 else 0 end,
    case when moment < until or wrong and gone then until when wrong or mute then moment + least(600, 30 * (1 << least(errors, 8))) else -1 end,
    case when moment < until then 'suspended' when wrong and gone then 'cancelled' when wrong or mute then 'error' else 'success' end
  from f join e on e.backend = f.backend and e.k = f.k + 1)
select backend, seq, outcome from f where seq is not null""")
def backend_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of map backends through breakers: late ones and answers without a status fail, callers who gave up are not charged."""
    status = F.when(c("event_id") % 5 != 0, F.when(c("event_id") % 2 == 0, "not_found").otherwise("open"))
    e = table(spark, sf_dir, "events").select((c("user_id") % 20).alias("backend"), c("event_id").alias("seq"), F.timestamp_seconds(c("event_id") * 7).alias("at"), status.alias("status"), F.when(c("event_type") == "error", "refused").alias("error"), c("value").alias("took_s"), (c("event_id") % 3 == 0).alias("cancelled"))
    return state.breaker(state.backend_calls(e, 100), "backend", "at", "failed", "cancelled")


@query("""select s_suppkey, i::int as pos, 'https://r' || s_suppkey || '-' || i || '.example' as url, 'T' || i as title from supplier, (select unnest([0, 1]) as i)""")
def search_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows out of a provider's JSON answer."""
    k = c("s_suppkey").cast("string")
    body = F.concat(F.lit('{"web": {"results": [{"url": "https://r'), k, F.lit('-0.example", "title": "T0", "description": "d"}, {"url": "https://r'), k, F.lit('-1.example", "title": "T1"}]}}'))
    raw = table(spark, sf_dir, "supplier").select(c("s_suppkey").alias("query"), body.alias("payload"))
    return tables.searched(raw, "brave").select(c("query").alias("s_suppkey"), "pos", "url", "title")


@query("""select s_suppkey, provider, i::int as pos, 'https://' || provider || s_suppkey || '-' || i || '.example' as url, 'T' || i as title, case when i = 0 then 'd' end as snippet
  from supplier, (select unnest(['google', 'searxng', 'proxy']) as provider), (select unnest([0, 1]) as i) where provider <> 'proxy' or s_suppkey % 3 = 0""")
def search_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows out of two providers' answers; a third's come in a fetch proxy's envelope, with errors and other codes."""
    s = table(spark, sf_dir, "supplier").select(c("s_suppkey").alias("query"))

    def answer(name: str, many: str, link: str, text: str) -> Column:
        row = lambda i: F.struct(F.concat(F.lit(f"https://{name}"), c("query"), F.lit(f"-{i}.example")).alias(link), F.lit(f"T{i}").alias("title"), F.lit(None if i else "d").cast("string").alias(text))
        return F.to_json(F.struct(F.array(row(0), row(1)).alias(many)))

    google = tables.searched(s.withColumn("payload", answer("google", "items", "link", "snippet")), "google")
    searxng = answer("searxng", "results", "url", "content")
    own = tables.searched(s.withColumn("payload", searxng), "searxng")
    kind = c("query") % 3
    envelope = F.to_json(F.struct(answer("proxy", "results", "url", "content").alias("body"), F.when(kind == 1, 403).otherwise(200).alias("status"), F.when(kind == 2, "timeout").alias("error")))
    proxied = tables.unwrapped(s.withColumn("payload", envelope)).select("query", c("body").alias("payload"))
    rows = google.unionByName(own).unionByName(tables.searched(proxied, "searxng").withColumn("provider", F.lit("proxy")))
    return rows.select(c("query").alias("s_suppkey"), "provider", "pos", "url", "title", "snippet")


@query("""select s_suppkey, 'https://yandex.ru/maps/org/a/' || s_suppkey || '/ https://yandex.com/maps/org/b/2/' || case when s_suppkey % 2 = 0 then ' https://yandex.ru/maps/org/c/3/' else '' end as links,
  s_suppkey % 2 = 0 as is_org, s_name || ' Москва' as query, ['open', 'permanently_closed', 'open'][s_suppkey % 3 + 1] as status from supplier""")
def org_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An organization's links on a page, told from other addresses; its search without the restriction; the status of a page
    that was not rendered."""
    k = c("s_suppkey").cast("string")
    first = F.concat(F.lit("<a href='https://yandex.ru/maps/org/a/"), k, F.lit("/?x=1'>"))
    more = F.when(c("s_suppkey") % 2 == 0, "<a href='https://yandex.ru/maps/org/c/3/'><a href='https://www.yandex.ru/maps/org/d/4/'>").otherwise("")
    html = _html(first, first, "<a href='https://yandex.ru/maps/2/x/'><a href='https://yandex.com/maps/org/b/2/'>", more)
    url = F.when(c("s_suppkey") % 2 == 0, "https://yandex.com/maps/org/x/1/").otherwise("https://yandex.ru/maps/2/x/")
    page = F.element_at(F.array(F.lit('{"status" : "open"}'), F.lit('{"status":"permanent-closed"}'), F.lit("<p>x</p>")), (c("s_suppkey") % 3 + 1).cast("int"))
    asked = maps.org_query(c("s_name"), F.lit("Москва"), F.lit(""))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(maps.org_links(html), " ").alias("links"), maps.is_org_link(url).alias("is_org"), F.regexp_replace(maps.maps_query(asked), " +", " ").alias("query"), maps.plain_status(page).alias("status"))


@query("""select c_custkey as item_pos, 'active' as status, case when c_custkey % 3 = 0 then 'Seed ' || c_custkey else 'ул. Мира, д. ' || c_custkey end as address, case when c_custkey % 3 = 0 then 'operator_verified' else 'official_site' end as address_source,
  '10:00-20:00' as hours, case when c_custkey % 2 = 0 then 'official_site' else 'maps' end as hours_source, '+7812' || lpad(c_custkey::varchar, 7, '0') as phone, false as phone_poisoned, 'hello ' || c_custkey as content from customer""")
def enrich_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records, their homepages and map cards through the whole plan."""
    from weftwork.plans.enrich import Sources, enrich

    k = c("c_custkey").cast("string")
    t = table(spark, sf_dir, "customer")
    url = F.concat(F.lit("https://s"), k, F.lit(".example/"))
    items = t.select(c("c_custkey").alias("item_pos"), "c_name", url.alias("url"), F.lit("").alias("city"), F.lit("places").alias("mode"), F.lit(False).alias("skip_maps_check"), F.when(c("c_custkey") % 3 == 0, F.concat(F.lit("Seed "), k)).alias("seed_address"))
    hours = F.when(c("c_custkey") % 2 == 0, F.lit("<p>Часы работы: 10:00-20:00</p>")).otherwise("")
    html = _html("<article>hello ", k, "</article><footer><a href='tel:+7812", F.lpad(k, 7, "0"), "'>x</a><address>ул. Мира, д. ", k, "</address>", hours, "</footer>")
    fetches = t.select(url.alias("url"), F.lit(1).alias("attempt"), html.alias("html"), F.lit(200).alias("status_code"), F.lit(None).cast("string").alias("final_url"), F.lit(False).alias("tls_error"))
    cards = t.select(c("c_custkey").alias("item_pos"), F.lit("permanently_closed").alias("status"), F.lit("Card").alias("name"), F.lit("ул. Иная, д. 1").alias("address"), F.lit("+78120000000").alias("phone"), F.lit("").alias("website"), F.lit("10:00-20:00").alias("hours"))
    out = enrich(items, Sources(fetches, cards=cards))
    return out.select("item_pos", "status", "address", "address_source", "hours", "hours_source", "phone", "phone_poisoned", "content")


@query("""select s_suppkey as item_pos, 'active' as status, '+7812555' || lpad(s_suppkey::varchar, 4, '0') as phone, 'ул. Садовая, д. ' || s_suppkey as address, 'a' || s_suppkey || '@b.example' as email,
  '+7812555' || lpad(s_suppkey::varchar, 4, '0') || ' contacts' as numbers, s_suppkey % 2 = 0 as tls_fallback_used, 1.5::double as latitude from supplier""")
def enrich_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Homepages that only link to a contacts page; half of them answered over plain HTTP alone."""
    from weftwork.plans.enrich import Sources, enrich

    k, t = c("s_suppkey").cast("string"), table(spark, sf_dir, "supplier")
    url = F.concat(F.lit("https://s"), k, F.lit(".example/"))
    items = t.select(c("s_suppkey").alias("item_pos"), url.alias("url"), F.lit("").alias("city"), F.lit("places").alias("mode"))
    items = items.withColumn("skip_maps_check", F.lit(False))
    home = _html("<article>hello</article><a href='/contacts'>Контакты</a>")
    page = _html("<footer><address>ул. Садовая, д. ", k, "</address><a href='tel:+7812555", F.lpad(k, 4, "0"), "'>x</a><a href='mailto:a", k, "@b.example'>m</a></footer>")

    def fetch(at: Column, attempt: int, html: Column, bad: Column) -> DataFrame:
        return t.select(at.alias("url"), F.lit(attempt).alias("attempt"), F.when(bad, "").otherwise(html).alias("html"), F.when(bad, 0).otherwise(200).alias("status_code"), F.lit(None).cast("string").alias("final_url"), bad.alias("tls_error"))

    fetches = fetch(url, 1, home, c("s_suppkey") % 2 == 0).unionByName(fetch(url, 2, home, F.lit(False))).unionByName(fetch(F.concat(url, F.lit("contacts")), 1, page, F.lit(False)))
    cards = t.select(c("s_suppkey").alias("item_pos"), F.lit("open").alias("status"), *[F.lit("").alias(f) for f in ("name", "address", "phone", "website", "hours")], F.lit(1.5).alias("latitude"), F.lit(2.5).alias("longitude"))
    out = enrich(items, Sources(fetches, cards=cards))
    return out.select("item_pos", "status", "phone", "address", "email", F.array_join(F.transform("numbers", lambda n: F.concat_ws(" ", n.value, n.source)), ";").alias("numbers"), "tls_fallback_used", "latitude")


@query("""select s_suppkey as item_pos, 'active' as status, case when s_suppkey % 3 < 2 then '+7812555' || lpad(s_suppkey::varchar, 4, '0') end as phone, case when s_suppkey % 3 < 2 then 'ул. Садовая, д. ' || s_suppkey end as address,
  case s_suppkey % 3 when 0 then repeat('word ', 119) || 'word' when 1 then 'hi' else 'readable ' || s_suppkey end as content, 'T' as title, case when s_suppkey % 3 = 2 then 'A' end as author, 'ru' as "language", s_suppkey % 3 <> 0 as render_skipped from supplier""")
def enrich_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Homepages that tell too little: a third has a render, a third a contacts page with one, a third a readability text.

    The renders of two thirds of the homepages are error pages: their records stand on the raw page, as if none had been tried.
    """
    from weftwork.plans.enrich import Sources, enrich

    k, t, kind = c("s_suppkey").cast("string"), table(spark, sf_dir, "supplier"), c("s_suppkey") % 3
    url = F.concat(F.lit("https://s"), k, F.lit(".example/"))
    items = t.select(c("s_suppkey").alias("item_pos"), url.alias("url"), F.lit("").alias("city"), F.lit("places").alias("mode"), F.lit(True).alias("skip_maps_check"))
    home = F.concat(F.lit("<html lang='ru'><head><title>T</title></head><body><article>hi</article>"), F.when(kind == 1, "<a href='/contacts'>Контакты</a>").otherwise(""), F.lit("</body></html>"))
    full = _html("<article>", F.repeat(F.lit("word "), 120), "</article><footer><address>ул. Садовая, д. ", k, "</address><a href='tel:+7812555", F.lpad(k, 4, "0"), "'>x</a></footer>")

    def fetch(at: Column, html: Column) -> DataFrame:
        return t.select(at.alias("url"), F.lit(1).alias("attempt"), html.alias("html"), F.lit(200).alias("status_code"), F.lit(None).cast("string").alias("final_url"), F.lit(False).alias("tls_error"))

    contacts = F.concat(url, F.lit("contacts"))
    renders = t.select(url.alias("url"), F.when(kind == 0, full).otherwise("<p>blocked</p>").alias("html")).unionByName(t.select(contacts.alias("url"), full.alias("html")))
    readable = t.filter(kind == 2).select(url.alias("url"), F.concat(F.lit("readable "), k).alias("content"), F.lit("").alias("title"), F.lit("A").alias("author"), F.lit(None).cast("string").alias("excerpt"))
    out = enrich(items, Sources(fetch(url, home).unionByName(fetch(contacts, F.lit("<p>x</p>"))), renders=renders, readability=readable))
    return out.select("item_pos", "status", "phone", "address", "content", "title", "author", "language", "render_skipped")


def _fetched(*rows: DataFrame) -> DataFrame:
    """fetches from tables of (url, html)."""
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.select("url", F.lit(1).alias("attempt"), "html", F.lit(200).alias("status_code"), F.lit(None).cast("string").alias("final_url"), F.lit(False).alias("tls_error"))


def _suppliers(spark: SparkSession, sf_dir: str, url: Column, city: str = "", mode: str = "places") -> DataFrame:
    """suppliers as records, s_suppkey and its text k beside them."""
    k = c("s_suppkey").cast("string")
    return table(spark, sf_dir, "supplier").select("s_suppkey", k.alias("k"), c("s_suppkey").alias("item_pos"), c("s_name").alias("name"), url.alias("url"), F.lit(city).alias("city"), F.lit(mode).alias("mode"), F.lit(False).alias("skip_maps_check"))


@query("""select s_suppkey as item_pos, case when s_suppkey % 4 = 0 then 'closed' else 'active' end as status, 'ул. Вторая, д. ' || s_suppkey as address, '+7812555' || lpad(s_suppkey::varchar, 4, '0') as phone,
  'https://w' || s_suppkey || '.example/' as website, null::varchar as legal_address, 'search' as phone_source, 'one' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'two' as content from supplier""")
def enrich_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without a page: of each fact that found pages have the last page's stands, the phone by the record's city; registered seats
    do not count; a record of which anything was read is active unless a map says that it is closed."""
    from weftwork.plans.enrich import Sources, enrich

    t = _suppliers(spark, sf_dir, F.lit(""), "Санкт-Петербург")
    page = lambda n: F.concat(F.lit("https://r"), c("k"), F.lit(f".example/{n}"))
    one = _html("<article>one</article><footer><address>ул. Первая, д. ", c("k"), "</address><address>ООО Ромашка, ул. Юридическая, д. 1</address><a href='tel:+74950000000'>x</a></footer>")
    place = F.concat(F.lit('<script type="application/ld+json">{"@type": "Restaurant", "name": "N", "url": "https://w'), c("k"), F.lit('.example/"}</script>'))
    two = _html(place, "<article>two</article><a href='tel:+74951111111'>y</a><a href='tel:+7812555", F.lpad(c("k"), 4, "0"), "'>x</a><footer><address>ул. Вторая, д. ", c("k"), "</address></footer>")
    fetches = _fetched(t.select(page(1).alias("url"), one.alias("html")), t.select(page(2).alias("url"), two.alias("html")), t.select(page(3).alias("url"), F.lit("").alias("html")))
    result = lambda pos, n: t.select("item_pos", F.lit(pos).alias("pos"), page(n).alias("url"), F.lit("T").alias("title"), F.lit("Адрес: ул. Снежная, д. 7").alias("snippet"))
    results = result(0, 1).unionByName(result(1, 3)).unionByName(result(2, 2))
    cards = t.filter("s_suppkey % 4 = 0").select("item_pos", F.lit("permanently_closed").alias("status"), *[F.lit("").alias(f) for f in ("name", "address", "phone", "website", "hours")])
    out = enrich(t.drop("s_suppkey", "k"), Sources(fetches, cards=cards, results=results))
    return out.select("item_pos", "status", "address", "phone", "website", "legal_address", "phone_source", "content")


@query("""select s_suppkey as item_pos, '+7812444' || lpad(s_suppkey::varchar, 4, '0') || ' contacts departmental Бухгалтерия true false;+7812555' || lpad(s_suppkey::varchar, 4, '0') || ' contacts   true false;+7495333' || lpad(s_suppkey::varchar, 4, '0') || ' body   false true' as numbers,
  '+7812555' || lpad(s_suppkey::varchar, 4, '0') as phone, 'https://s' || s_suppkey || '.example/ru/' as url from supplier""")
def enrich_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of three pages: of the homepage's render, for the raw page tells nothing, and of the contacts page that only the
    render links to. General where any page says so; strongest first, then by digits; the page where the record ended up."""
    from weftwork.plans.enrich import Sources, enrich

    url = F.concat(F.lit("https://s"), c("s_suppkey").cast("string"), F.lit(".example/"))
    t = _suppliers(spark, sf_dir, url, "Санкт-Петербург")
    far = F.concat(url, F.lit("ru/"))
    link = lambda code: F.concat(F.lit("<a href='tel:+7" + code), F.lpad(c("k"), 4, "0"), F.lit("'>x</a>"))
    shell = _html("<div id='app'></div>")
    full = _html("<footer>", link("812555"), "</footer><p>page of the house</p><a href='contacts'>Контакты</a><p>", F.repeat(F.lit("word "), 120), "</p>")
    contacts = _html("<main>", link("495333"), "</main><footer><p>Бухгалтерия</p>", link("812444"), link("812555"), "</footer>")
    fetches = _fetched(t.select("url", shell.alias("html")), t.select(F.concat(far, F.lit("contacts")).alias("url"), contacts.alias("html")))
    fetches = fetches.withColumn("final_url", F.when(~c("url").endswith("contacts"), F.concat("url", F.lit("ru/"))))
    renders = t.select("url", full.alias("html"))
    out = enrich(t.drop("s_suppkey", "k"), Sources(fetches, renders=renders))
    shown = F.array_join(F.transform("numbers", lambda n: F.concat_ws(" ", n.value, n.source, n.role, n.role_label_raw, n.match, n.foreign)), ";")
    return out.select("item_pos", shown.alias("numbers"), "phone", "url")


@query("""select s_suppkey as item_pos, case s_suppkey % 4 when 0 then 59.5 when 1 then 5.0 when 2 then 5.0 end::double as latitude, case s_suppkey % 4 when 0 then 30.5 when 1 then 6.0 when 2 then 6.0 end::double as longitude,
  case when s_suppkey % 4 = 3 then 'Other' else 'Near' end as place_name from supplier""")
def enrich_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record's own pair of coordinates, else those of its first card, unless they are zero. Half a pair is none."""
    from weftwork.plans.enrich import Sources, enrich

    t, kind = _suppliers(spark, sf_dir, F.lit("")), c("s_suppkey") % 4
    t = t.withColumns({"latitude": F.when(kind < 2, 59.5), "longitude": F.when(kind == 0, 30.5)})
    card = lambda pos, name, lat, lon: t.select("item_pos", F.lit(pos).alias("pos"), F.lit("open").alias("status"), name.alias("name"), *[F.lit("").alias(f) for f in ("address", "phone", "website", "hours")], lat.alias("latitude"), lon.alias("longitude"))
    zero = lambda v: F.when(kind == 3, 0.0).otherwise(v)
    cards = card(1, F.lit("Far"), F.lit(7.0), F.lit(8.0)).unionByName(card(0, F.when(kind == 3, "Other").otherwise("Near"), zero(5.0), zero(6.0)))
    return enrich(t.drop("s_suppkey", "k"), Sources(_fetched(t.select("url", F.lit("").alias("html")).limit(0)), cards=cards)).select("item_pos", "latitude", "longitude", "place_name")


@query("""with k as (select s_suppkey % 5 as kind from supplier)
select 'records' as metric, count(*)::bigint as n from k union all select 'fetch_error', count(*) filter (kind = 4) from k union all select 'render_thin_content', count(*) filter (kind = 0) from k
union all select 'render_absent_contacts', count(*) filter (kind = 1) from k union all select 'render_contacts_page', 0 union all select 'render_error', count(*) filter (kind = 2) from k
union all select 'render_skipped_homepage', count(*) filter (kind = 3) from k union all select 'render_skipped_contacts', 0 union all select 'contacts_discovered', count(*) filter (kind = 1) from k
union all select 'contacts_resolved', count(*) filter (kind = 1) from k union all select 'site_resolved', count(*) filter (kind = 0) + 2 * count(*) filter (kind = 1) from k union all select 'target_blocked', 0
union all select 'legal_vs_venue', count(*) filter (kind = 1) from k union all select 'conflicts', count(*) filter (kind in (0, 1)) from k""")
def enrich_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was done for records of five kinds: a thin page that a render helps; a page without contacts whose render links to a contacts
    page with a registered seat; a failed render; a page whose branches' numbers make a render needless; a page that is not reached."""
    from weftwork.plans import metrics
    from weftwork.plans.enrich import Sources, enrich

    url, kind = F.concat(F.lit("https://s"), c("s_suppkey").cast("string"), F.lit(".example/")), c("s_suppkey") % 5
    t = _suppliers(spark, sf_dir, url)
    long = F.concat(F.lit("<article>"), F.repeat(F.lit("word "), 120), F.lit("</article>"))
    branches = F.lit("""<script>var b = '[{"phone": "+78121110001"}, {"phone": "+78121110002"}]';</script>""")
    home = _html(F.when(kind == 3, F.concat(long, branches)).when(kind == 0, "<p>thin</p>").otherwise(long))
    tel = F.concat(F.lit("<footer><a href='tel:+7812555"), F.lpad(c("k"), 4, "0"), F.lit("'>x</a><address>ул. Садовая, д. 1</address></footer>"))
    render = _html(F.when(kind == 1, F.concat(tel, long, F.lit("<a href='/contacts'>Контакты</a>"))).otherwise(F.concat(tel, F.rpad(F.lit("<p>"), 600, "y"))))
    contacts = _html("<address>ООО Ромашка, ул. Юридическая, д. 1</address><footer><a href='tel:+7812555", F.lpad(c("k"), 4, "0"), "'>x</a><address>ул. Садовая, д. 1</address><a href='mailto:a@b.example'>m</a><p>Часы работы: 10:00-20:00</p></footer>")
    pages = _fetched(t.filter(kind < 4).select("url", home.alias("html")), t.filter(kind == 1).select(F.concat(url, F.lit("contacts")).alias("url"), contacts.alias("html")))
    # A contacts page of which everything is known is not rendered; the homepage of the third kind has a render of a few bytes.
    renders = t.filter(kind < 3).select("url", F.when(kind == 2, "<p>no</p>").otherwise(render).alias("html"))
    cards = t.select("item_pos", F.lit("open").alias("status"), F.lit("").alias("name"), F.lit("").alias("address"), F.when(kind < 2, "+78120000000").otherwise("").alias("phone"), F.lit("").alias("website"), F.lit("").alias("hours"))
    return metrics.totals(enrich(t.drop("s_suppkey", "k"), Sources(pages, renders=renders, cards=cards)))


@query("""with e as (select event_id as seq, 'https://n.example/' || user_id as url, case when event_id % 7 = 0 then 'purge' when event_id % 7 < 3 then 'update' else 'add' end as action,
  event_id::varchar as news_id, case when event_id % 5 = 0 then '' else event_type end as status, case when event_id % 3 = 0 then -1 else event_id % 100 end as score from events),
p as (select url, max(seq) filter (action = 'purge') as purged from e group by url),
a as (select e.url, min(e.seq) as start from e join p using (url) where action = 'add' and seq > coalesce(purged, -1) group by e.url),
s as (select e.url, arg_max(status, seq) as status from e join a using (url) where action = 'update' and seq > start and status <> '' group by e.url),
n as (select e.url, arg_max(score, seq) as score from e join a using (url) where action = 'update' and seq > start and score >= 0 group by e.url)
select p.url, e.news_id, coalesce(s.status, e.status) as status, coalesce(n.score, e.score)::int as score from p left join a using (url) left join e on e.url = a.url and e.seq = a.start left join s on s.url = p.url left join n on n.url = p.url""")
def news_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What adds, updates and purges of each address, in order, leave in the store."""
    from weftwork.operators import news

    i = c("event_id")
    action = F.when(i % 7 == 0, "purge").when(i % 7 < 3, "update").otherwise("add")
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("https://n.example/"), c("user_id").cast("string")).alias("url"), i.alias("seq"), action.alias("action"), i.cast("string").alias("news_id"), F.when(i % 5 == 0, "").otherwise(c("event_type")).alias("status"), F.when(i % 3 == 0, -1).otherwise(i % 100).cast("int").alias("score"))
    return news.folded(None, e).select("url", "entry.news_id", "entry.status", "entry.score")


@query("""select s_suppkey as item_pos, day, case when day = 2 and s_suppkey % 3 = 0 then 'day 2' when day = 2 and s_suppkey % 3 = 1 then 'day 2' else 'day 1' end as content,
  day = 2 and s_suppkey % 3 = 2 as cache_hit from supplier, (select unnest([1, 2]) as day) where day = 2 or s_suppkey % 3 > 0""")
def enrich_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two days of records: the second finds a third in the store, a third there is too old, a third is new. The second day is run twice."""
    import uuid

    from weftwork.plans import enrich as E

    store = E.result_store(spark, f"{E.shared_path(spark)}/results-{uuid.uuid4().hex}")
    t = _suppliers(spark, sf_dir, F.concat(F.lit("https://s"), c("s_suppkey").cast("string"), F.lit(".example/")))

    def run(day: int, rows: DataFrame, text: str, batch: str, ttl: str) -> DataFrame:
        at = F.lit(f"2024-01-{3 * day:02d} 00:00:00").cast("timestamp")
        pages = _fetched(rows.select("url", _html("<article>", text, "</article>").alias("html")))
        out = E.enrich_cached(rows.drop("s_suppkey", "k"), E.Sources(pages), store, at, batch, ttl)
        return out.select("item_pos", F.lit(day).alias("day"), "content", "cache_hit")

    one = run(1, t.filter("s_suppkey % 3 > 0"), "day 1", "a", "2 days")
    one = E.written(one, "day-one")
    # Those of the second third were read long before: they are put again, as old rows, and count as expired.
    old = store.read().join(t.filter("s_suppkey % 3 = 1").select("url"), "url", "left_semi").withColumn("stored_at", F.lit("2023-01-01 00:00:00").cast("timestamp"))
    aged = E.result_store(spark, f"{store.path}-aged")
    aged.put(store.read().join(old.select("cache_key"), "cache_key", "left_anti").unionByName(old), "a")
    store = aged
    run(2, t, "day 2", "b", "7 days")
    return one.unionByName(run(2, t, "day 3", "b", "7 days"))


@query("""with w as (select s_suppkey, i, case when i = 2 and s_suppkey % 2 = 0 then '' else 'about ' || i || ' of ' || s_suppkey end as snippet from supplier, (select unnest(range(3)) as i))
select s_suppkey, provider, i::int as pos, 'https://' || provider || s_suppkey || '-' || i || '.example/?a=b&c=1' as url, 'T ' || i as title, snippet
from w, (select unnest(['ddg', 'startpage', 'proxy']) as provider) where provider <> 'proxy' or s_suppkey % 3 = 0""")
def result_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows out of result pages of three providers: records by their shape, redirects unwrapped, menus and own links left out."""
    k = c("s_suppkey").cast("string")
    s = spread(table(spark, sf_dir, "supplier").select(c("s_suppkey").alias("query"), k.alias("k")))

    def page(name: str, record) -> Column:
        menu = "<ul><li><a href='/settings'>Settings and help</a></li><li><a href='https://other.example/'>Apps</a></li></ul>"
        rows = []
        for i in range(3):
            url = F.concat(F.lit(f"https://{name}"), c("k"), F.lit(f"-{i}.example/?a=b&c=1"))
            text = F.concat(F.lit(f"about <b>{i}</b> of "), c("k"))
            rows.append(record(i, url, F.when(c("query") % 2 == 0, "").otherwise(text) if i == 2 else text))
        return _html(menu, "<div id='links'>", *rows, "</div><footer><a href='/next'>Next page of results</a></footer>")

    def ddg(i: int, url: Column, text: Column) -> Column:
        to = F.concat(F.lit("//duckduckgo.com/l/?uddg="), F.url_encode(url), F.lit("&amp;rut=f"))
        return F.concat(F.lit("<div class='result web-result'><h2><a class='result__a' href='"), to, F.lit(f"'>T {i}</a></h2><a class='result__url' href='"), to, F.lit("'>site.example/x</a><a class='result__snippet' href='"), to, F.lit("'>"), text, F.lit("</a></div>"))

    def startpage(i: int, url: Column, text: Column) -> Column:
        return F.concat(F.lit("<section class='w-gl__result'><a href='"), F.replace(url, F.lit("&"), F.lit("&amp;")), F.lit(f"'><h3>T {i}</h3></a><p>"), text, F.lit("</p></section>"))

    envelope = F.to_json(F.struct(page("proxy", ddg).alias("body"), F.when(c("query") % 3 == 1, 403).otherwise(200).alias("status"), F.when(c("query") % 3 == 2, "timeout").alias("error")))
    rows = [tables.searched(s.withColumn("payload", p), name) for name, p in (("ddg", page("ddg", ddg)), ("startpage", page("startpage", startpage)), ("proxy", envelope))]
    out = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return out.select(c("query").alias("s_suppkey"), "provider", "pos", "url", "title", "snippet")


@query("""select s_suppkey as item_pos, case s_suppkey % 5 when 0 then 'open' when 1 then 'permanently_closed' when 2 then 'unknown' when 3 then 'not_found' else 'open' end as status,
  case s_suppkey % 5 when 0 then 'https://yandex.ru/maps/org/b/' || s_suppkey when 1 then 'https://yandex.ru/maps/org/a/' || s_suppkey when 4 then 'https://yandex.ru/maps/org/a/' || s_suppkey end as page,
  case when s_suppkey % 5 < 2 then 'House ' || s_suppkey end as name from supplier""")
def org_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organization pages of five kinds of record: closed, then open; all closed; pages that no attempt reached; no links; a renderer
    that answers with nothing, so that the plain page counts."""
    t, kind = _suppliers(spark, sf_dir, F.lit("")), c("s_suppkey") % 5
    link = lambda n: F.concat(F.lit(f"https://yandex.ru/maps/org/{n}/"), c("k"))
    row = lambda pos, url: t.select("item_pos", F.lit(pos).alias("pos"), url.alias("url"))
    results = row(0, F.lit("https://other.example/")).unionByName(row(1, F.when(kind != 3, link("a")))).unionByName(row(2, F.when(kind != 3, link("b")))).filter("url is not null")
    block = lambda status: F.concat(F.lit('<script>{"shortTitle": "House '), c("k"), F.lit(f'", "fullAddress": "x", "status": "{status}"' + "}</script>"))
    fetch = lambda n, attempt, html, error: t.select(link(n).alias("url"), F.lit(attempt).alias("attempt"), html.alias("html"), error.alias("error"))
    none = F.lit(None).cast("string")
    first = fetch("a", 1, F.when(kind < 2, block("permanent-closed")).otherwise(""), F.when(kind == 2, "timeout"))
    late = fetch("b", 1, none, F.lit("timeout")).unionByName(fetch("b", 2, F.when(kind == 0, block("open")).otherwise(block("permanent-closed")), F.when(kind == 2, "timeout")))
    useless = fetch("b", 4, block("open"), none)
    plain = fetch("a", 1, F.lit("<p>no status</p>"), none)
    out = maps.lookup(t, results, first.unionByName(late).unionByName(useless), plain)
    return out.select("item_pos", "status", "page", "org.name")


_RECORDS = "select c_custkey as record_id, 'ул. ' || ['Садовая', 'Лесная', 'Полевая', 'Мира'][c_custkey % 4 + 1] || ' ' || 'Улочка' || c_custkey % 50 || ', д. 5' as address, ['Москва', 'Спб', null][c_nationkey % 3 + 1] as city from customer"
_CARDS = "select s_suppkey as card_id, 'проспект ' || ['Садовая', 'Лесная', 'Речная'][s_suppkey % 3 + 1] || ' Улочка' || s_suppkey % 60 as address, ['Москва', 'спб ', ''][s_nationkey % 3 + 1] as city from supplier"


@query(rf"""with r as (select record_id, lower(trim(coalesce(city, ''))) as town, unnest(string_split(lower(regexp_replace(regexp_replace(address, '^ул\. ', ''), ', д\. 5$', '')), ' ')) as word from ({_RECORDS})),
k as (select card_id, lower(trim(coalesce(city, ''))) as town, unnest(string_split(lower(regexp_replace(address, '^проспект ', '')), ' ')) as word from ({_CARDS})),
p as (select record_id, card_id, count(*) as shared from r, k where r.town = k.town and r.word = k.word group by record_id, card_id),
b as (select *, row_number() over (partition by record_id order by shared desc, card_id) as place from p)
select record_id, card_id, shared from b where place = 1""")
def card_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The card of each record, out of a table of cards of all places: a join on the distinctive words of addresses."""
    pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))
    cu, su = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    records = cu.select(c("c_custkey").alias("record_id"), F.concat(F.lit("ул. "), pick(("Садовая", "Лесная", "Полевая", "Мира"), c("c_custkey") % 4), F.lit(" Улочка"), (c("c_custkey") % 50).cast("string"), F.lit(", д. 5")).alias("address"), pick(("Москва", "Спб", None), c("c_nationkey") % 3).alias("city"))
    cards = su.select(c("s_suppkey").alias("card_id"), F.concat(F.lit("проспект "), pick(("Садовая", "Лесная", "Речная"), c("s_suppkey") % 3), F.lit(" Улочка"), (c("s_suppkey") % 60).cast("string")).alias("address"), pick(("Москва", "спб ", ""), c("s_nationkey") % 3).alias("city"))
    return maps.matched(records, cards)


@query("""select s_suppkey, array_to_string(list_filter([case when s_suppkey % 2 = 0 then 'phone' end, 'hours', case when s_suppkey % 3 = 0 then 'website' end, 'rating', 'latitude'], lambda x: x is not null), ',') as missing from supplier""")
def org_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an organization's page leaves out."""
    k = c("s_suppkey").cast("string")
    phone = F.when(c("s_suppkey") % 2 == 0, "").otherwise(F.concat(F.lit(', "phones": [{"number": "+7'), k, F.lit('"}]')))
    site = F.when(c("s_suppkey") % 3 == 0, "").otherwise(F.lit(', "urls": ["http://s.example"]'))
    html = F.concat(F.lit('<script>{"shortTitle": "n", "fullAddress": "a"'), phone, site, F.lit("}</script>"))
    pages = maps.organization(table(spark, sf_dir, "supplier").select("s_suppkey", html.alias("html")))
    return pages.select("s_suppkey", maps.missing(c("org")).alias("missing"))


@query("""select c_custkey, c_custkey % 2 = 0 or c_custkey % 3 = 0 or c_custkey % 5 = 0 or c_custkey % 7 = 0 as lacks from customer""")
def missing_rich_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a homepage leaves something for a contacts page: one without an anchored number does, however rich."""
    k = c("c_custkey")
    has = lambda n: F.when(k % n != 0, "x")
    return table(spark, sf_dir, "customer").select(k, facts.lacks_rich_field(has(2), has(3), has(5), k % 7 != 0).alias("lacks"))


@query("""with t as (select p_partkey, repeat('a', p_partkey % 400) as one, repeat('b', p_partkey % 1300) || case when p_partkey % 2 = 0 then '](' else '' end as two from part)
select p_partkey, case when length(one) < 200 then length(two) > length(one) else contains(two, '](') and length(two) >= length(one) and length(two) // greatest(length(one), 1) <= 3 end as better from t""")
def second_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a page's second text replaces its first."""
    k = c("p_partkey")
    one, two = F.repeat(F.lit("a"), (k % 400).cast("int")), F.concat(F.repeat(F.lit("b"), (k % 1300).cast("int")), F.when(k % 2 == 0, "](").otherwise(""))
    return table(spark, sf_dir, "part").select(k, extract.second_is_better(one, two).alias("better"))


_CHOICES = "select s_suppkey as item_pos, unnest([case when s_suppkey % 5 = 0 then 'operator_verified' end, case when s_suppkey % 2 = 0 then 'official_site' end, case when s_suppkey % 3 = 0 then 'maps' end, case when s_suppkey % 7 = 0 then 'search' end]) as source from supplier"


@query(f"""with r as (select item_pos, max(['search', 'maps', '', 'official_site', '', 'operator_verified'].list_position(source)) as rank from ({_CHOICES}) where source is not null group by item_pos)
select ['search', 'maps', '', 'official_site', '', 'operator_verified'][rank] as phone_source, count(*) as records from r group by 1""")
def phone_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records each source gave the phone of."""
    from weftwork.plans import metrics

    k, t = c("s_suppkey"), table(spark, sf_dir, "supplier")
    kinds = (("operator_verified", 5, 0), ("maps", 3, 1), ("official_site", 2, 2), ("search", 7, 4))
    rows = [resolve.claims(t.filter(k % n == 0).select(k.alias("item_pos"), F.lit(f"+7812{n}").alias("phone")), source, seq, ["phone"]) for source, n, seq in kinds]
    claims = rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])
    return metrics.phone_sources(resolve.provenance(resolve.resolve(claims), ["phone"]))


@query("""with e as (select page_id, 'p' || page_id % 3 as project, url from pages)
select project, page_id::varchar as news_id, url, (page_id % 90)::int as score, page_id % 3 = 2 as enveloped from e""")
def news_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The news store written, a folder a project, and read again; one project's file is an envelope; one project has no file."""
    import uuid

    from weftwork.sources.shared import shared_path

    at = f"{shared_path(spark)}/news-{uuid.uuid4().hex}"
    none = lambda n, kind="string": F.lit(None).cast(kind).alias(n)
    e = table(spark, sf_dir, "pages").select(c("page_id").cast("string").alias("news_id"), F.concat(F.lit("p"), (c("page_id") % 3).cast("string")).alias("project"), "url", none("title"), none("snippet"), none("source"), none("topic"), (c("page_id") % 90).cast("int").alias("score"), none("engine_count", "int"), none("discovered_at"), none("status"))
    tables.write_news(e, f"{at}/folders")
    stored = spark.read.schema(tables.NEWS).json(f"{at}/folders").withColumn("enveloped", F.lit(False)).filter("project != 'p2'")
    # Files as other tools write them, one object that holds an array: a file for each thousand entries.
    items = spark.read.schema(tables.NEWS).json(f"{at}/folders/project=p2").withColumn("project", F.lit("p2"))
    files = items.groupBy(F.expr("cast(news_id as long) div 1000").alias("file")).agg(F.collect_list(F.struct(*items.columns)).alias("items"))
    files.select("file", F.to_json(F.struct("items")).alias("value")).write.partitionBy("file").text(f"{at}/envelopes")
    wrapped = tables.read_news(spark, f"{at}/envelopes").unionByName(tables.read_news(spark, f"{at}/nowhere")).withColumn("enveloped", F.lit(True))
    names = ["project", "news_id", "url", "score", "enveloped"]
    return stored.select(*names).unionByName(wrapped.select(*names))


@query("""select 'p' || s_suppkey as project, 't' || s_suppkey || ',t' as taboo, case when s_suppkey % 2 = 0 then 'q' || s_suppkey end as first_query from supplier""")
def news_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects out of a configuration file, some without queries."""
    import uuid

    from weftwork.sources.shared import shared_path

    at = f"{shared_path(spark)}/config-{uuid.uuid4().hex}"
    k = c("s_suppkey").cast("string")
    project = F.struct(F.when(c("s_suppkey") % 2 == 0, F.array(F.struct(F.concat(F.lit("q"), k).alias("q")))).alias("queries"), F.array(F.concat(F.lit("t"), k), F.lit("t")).alias("taboo_words"))
    files = table(spark, sf_dir, "supplier").select(F.to_json(F.struct(F.create_map(F.concat(F.lit("p"), k), project).alias("projects"))).alias("value"))
    files.unionByName(files.limit(1).select(F.lit('{"projects": null}').alias("value"))).write.text(at)
    # read_news_config reads a whole file as one object; here every line is a file's worth.
    rows = spark.read.schema(tables.NEWS_CONFIG).json(at).select(F.explode("projects").alias("project", "c"))
    return rows.select("project", F.array_join("c.taboo_words", ",").alias("taboo"), F.try_element_at("c.queries", F.lit(1)).getField("q").alias("first_query"))


@query("""select p_partkey, case p_partkey % 3 when 0 then '2024-05-01' when 1 then '2023-01-02' else '2022-11-09' end as published from part""")
def jsonld_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The date of an article item comes after the page's own, before that of the address."""
    kind = c("p_partkey") % 3
    item = F.when(kind < 2, """<script type="application/ld+json">{"@type": "NewsArticle", "datePublished": "2024-05-01"}</script>""").otherwise("")
    own = F.when(kind == 1, "<time datetime='2023-01-02'>x</time>").otherwise("")
    pages = spread(table(spark, sf_dir, "part").select("p_partkey")).select(c("p_partkey").alias("page_id"), F.concat(F.lit("https://a.example/2022/11/09/"), c("p_partkey").cast("string")).alias("url"), _html(item, own).alias("html"))
    return dom.with_nodes(pages).select(c("page_id").alias("p_partkey"), extract.published(c("nodes"), c("url")).alias("published"))


@query("""select s_suppkey, 'site:yandex.ru/maps/org "' || s_name || '" Санкт-Петербург' || case s_suppkey % 3 when 0 then ' невский' when 1 then '' else ' литейный' end as query from supplier""")
def org_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search for an organization's page."""
    k = c("s_suppkey").cast("string")
    address = F.element_at(F.array(F.concat(F.lit("СПб, Невский пр., д. "), k), F.lit(""), F.concat(F.lit("Литейный проспект, "), k)), (c("s_suppkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", maps.org_query(c("s_name"), F.lit("Санкт-Петербург"), address).alias("query"))


@query("""select c_custkey, case c_custkey % 4 when 0 then '<p>' || c_custkey || '</p>' end as html from customer""")
def render_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a render service's answers: one is whole, one an error, one empty, one cut off."""
    page = F.concat(F.lit("<p>"), c("c_custkey").cast("string"), F.lit("</p>"))
    answer = F.to_json(F.struct(F.lit("u").alias("url"), F.when(c("c_custkey") % 4 == 2, "").otherwise(page).alias("html"), F.when(c("c_custkey") % 4 == 1, "timeout").alias("error")))
    cut = F.when(c("c_custkey") % 4 == 3, F.substring(answer, 1, 9)).otherwise(answer)
    return table(spark, sf_dir, "customer").select("c_custkey", maps.rendered_html(cut).alias("html"))


@query("select count(*) as entries, count(distinct user_id) as urls from events")
def news_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries and different addresses of a store."""
    from weftwork.operators import news

    return news.totals(table(spark, sf_dir, "events").select(F.concat(F.lit("https://n.example/"), c("user_id").cast("string")).alias("url")))
