"""Operators of the enrichment engine on fixtures with known answers."""

import json

import pytest
from pyspark.sql import functions as F

from weftwork.functions import text as X
from weftwork.functions import urls as U
from weftwork.functions import validate as V
from weftwork.operators import extract, facts, maps, news, phones, resolve, search, state, structured
from weftwork.plans.enrich import Sources, enrich
from weftwork.sources import dom, tables


#: What the page queries make of a text with references that are closed and such that are not.
_CUT = "a &amp b & <c> &amp &#38 &am"
CUT = [("article_text", _CUT), ("main_text", _CUT), ("markdown_heading", _CUT), ("page_title", _CUT), ("thin_content_flag", len(_CUT))]


def column(spark, values, f, kind="string"):
    """f over one column of values, in order."""
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r.o for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def nodes(spark, *pages, url="https://a.example/x"):
    df = spark.createDataFrame([(i, url, p, "") for i, p in enumerate(pages)], "page_id long, url string, html string, city string")
    return dom.with_nodes(df)


def one(spark, html, f, **kw):
    return nodes(spark, html, **kw).select(f(F.col("nodes")).alias("o")).first().o


@pytest.mark.parametrize("phone,valid", [("+7 (812) 123-45-67", True), ("8 800 555 35 35", True), ("+7 921 000 00 00", True), ("+7 123 456 78 90", False), ("+7 817 1234567", False), ("123", False), ("", False), (None, False), ("9 812 1234567", False), ("+7 550 123 45 67", False), ("+7 812 123 45 678", False)])
def test_phone_validity(spark, phone, valid):
    assert column(spark, [phone], V.valid_phone) == [valid]


def test_area_codes_by_range(spark):
    codes = list(range(1000))
    got = column(spark, [f"7{c:03d}1234567" for c in codes], V.valid_phone)
    assert [c for c, ok in zip(codes, got) if ok] == [c for c in codes if any(a <= c <= b for a, b in V.P.AREA_CODES)]


@pytest.mark.parametrize("price,valid", [("1500 ₽", True), ("бесплатно", True), ("Free entry", True), ("от 500", True), ("₽₽₽", False), ("color: red; 5", False), ("<b>5</b>", False), ("let x = 5", False), ("see http://a/5", False), ("1" * 61, False), ("  ", False), (None, False)])
def test_price_validity(spark, price, valid):
    assert column(spark, [price], V.valid_price) == [valid]


@pytest.mark.parametrize("address,valid", [("ул. Садовая, д. 5", True), ("Невский проспект, 28", True), ("12 Baker Street, London", True), ("Наши цены, ул. Мира 5", False), ("короткое", False), ("просто слова без признаков места", False), ("ул. " + "я" * 120, False), ("streetwise people gather", False)])
def test_address_validity(spark, address, valid):
    assert column(spark, [address], V.valid_address) == [valid]


def test_legal_markers(spark):
    assert column(spark, ["ИП Иванов, ул. Садовая, 5", "Литейный пр., 5", "Юридический адрес: …", "…, ООО «Ромашка»", "инновация", None], V.legal_address) == [True, False, True, True, True, False]


def test_words_and_tokens(spark):
    assert column(spark, ["the end", "other", "the2", "the, end", "x the"], lambda c: X.has_word(c, "the")) == [True, False, False, True, True]
    assert column(spark, ["факс 5", "факсимиле", "2факс2"], lambda c: X.has_token(c, "факс")) == [True, False, True]


def test_truncation(spark):
    f = lambda c: X.truncate(c, 10)
    assert column(spark, ["short", "hello world again", "ab cdefghijklmnop", "привет мир снова", None], f) == ["short", "hello worl", "ab cdefghi", "привет", None]


def test_clean_lines_trims_all_white_space(spark):
    assert column(spark, ["\u00a0 a \n\n b\u2003\n", ""], X.clean_lines) == ["a\nb", ""]


@pytest.mark.parametrize("url,norm", [("HTTPS://WWW.Ex.COM/A/#f", "https://ex.com/A"), ("http://ex.com", "http://ex.com"), ("http://ex.com/?q=1#x", "http://ex.com/?q=1"), ("http://www.ex.com//", "http://ex.com"), ("http://ex.com/%zz", ""), ("/just/path/", "/just/path"), ("", "")])
def test_url_normalization(spark, url, norm):
    assert column(spark, [url], U.normal_url) == [norm]


def test_hosts_and_guards(spark):
    assert column(spark, ["https://m.vk.com/x", "https://notvk.com/", "http://x.com", None], U.is_blocked) == [True, False, True, None]
    assert column(spark, ["http://127.0.0.1/", "http://10.1.2.3/", "ftp://a.b/", "https://a.example/", "http://172.20.1.1/", "", None], U.private_target) == [True, True, True, False, True, True, True]
    assert column(spark, ["https://a.b", "https://a.b/", "https://a.b/c", "%"], U.is_homepage) == [True, True, False, False]


def test_hours(spark):
    assert one(spark, "<dl><dt>Часы работы</dt><dd>10:00-22:00</dd></dl>", extract.visible_hours) == "10:00-22:00"
    assert one(spark, "<p>Режим работы: Пн-Пт 9:00–18:00</p>", extract.visible_hours) == "Пн-Пт 9:00–18:00"
    assert one(spark, "<p>Часы работы уточняйте у оператора</p>", extract.visible_hours) is None
    assert column(spark, ["\nx\nПн 10:00-12:00\nВт 10:00-12:00\n\nСр 1:00-2:00", "реклама"], X.clean_hours) == ["Пн 10:00-12:00; Вт 10:00-12:00", None]


def test_main_text_without_boilerplate(spark):
    html = "<title>T &amp; t</title><body><nav>menu</nav><article>One <b>two</b><div class='x ad'>no</div><p>three<p hidden>no</p></article><footer>f</footer>"
    assert one(spark, html, extract.main_text) == "One twothree"
    assert one(spark, html, extract.title) == "T & t"
    assert one(spark, "<p>bare", extract.main_text) == "bare"
    assert one(spark, "", extract.main_text) == "" and one(spark, None, extract.title) == ""


def test_markdown(spark):
    html = "<article><h1>Head</h1><p>A <b>bold</b> and <a href='/x'>link</a>.</p><ul><li>one<li>two</ul></article>"
    assert one(spark, html, extract.markdown) == "# Head\n\nA **bold** and [link](/x).\n\n- one\n- two"


def test_second_text(spark):
    long = "x" * 300
    rows = [("a", "ab", True), (long, long + "](", True), (long, long * 5 + "](", False), (long, long, False), ("ab", "a", False)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert all(r.o == r.want for r in df.select("want", extract.second_is_better(F.col("a"), F.col("b")).alias("o")).collect())


def _pick(spark, html, city=""):
    p = phones.with_candidates(nodes(spark, html))
    return p.select(phones.pick(F.col("candidates"), F.lit(city), F.col("vendor")).alias("p")).first().p


def test_pick_prefers_contact_area_then_city(spark):
    html = "<a href='tel:+74951112233'>a</a><footer><a href='tel:+78121112233'>b</a></footer>"
    assert _pick(spark, html).value == "+78121112233" and _pick(spark, html).region == "contacts"
    assert _pick(spark, html, "Москва").value == "+74951112233"


def test_trackers_poison_all_but_chat_links(spark):
    script = "<script src='https://cloud.roistat.com/x'></script>"
    assert _pick(spark, script + "<a href='tel:+78121112233'>b</a>").poisoned
    p = _pick(spark, script + "<a href='tel:+78121112233'>b</a><a href='https://wa.me/79991112233'>c</a>")
    assert (p.value, p.poisoned) == ("+79991112233", False)
    assert not _pick(spark, script).poisoned and _pick(spark, script).value is None


def test_toll_free_and_tracked_links_come_last(spark):
    assert _pick(spark, "<footer><a href='tel:88005553535'>f</a></footer><p><a href='tel:+78121112233'>b</a></p>").value == "+78121112233"
    nested = "<footer><div class='comagic'><a href='tel:+78120000001'>t</a></div></footer><a href='tel:+78120000002'>b</a>"
    assert _pick(spark, nested).value == "+78120000002"
    wrapped = "<div class='mango'><footer><a href='tel:+78120000001'>t</a></footer></div><a href='tel:+78120000002'>b</a>"
    assert _pick(spark, wrapped).value == "+78120000001"


def test_site_numbers_keep_the_strongest_reading(spark):
    html = "<a href='tel:+78121112233'>x</a><footer><a href='tel:+78121112233'>y</a></footer><a href='https://wa.me/78121112233'>w</a><p>тел. 8 812 111-22-33</p>"
    got = phones.site_numbers(nodes(spark, html)).collect()
    assert [(r.key, r.source, r.trustworthy) for r in got] == [("78121112233", "social_link", True)]


def test_roles(spark):
    html = "<footer><h4>Бухгалтерия</h4><p><a href='tel:+78121112233'>x</a></p></footer><footer><h4>Приём</h4><p><a href='tel:+78121112233'>x</a></p></footer><section><p>Факс: <a href='tel:+78121112244'>x</a></p></section>"
    got = {r.key: r.role for r in phones.site_numbers(nodes(spark, html)).collect()}
    assert got == {"78121112233": "", "78121112244": "departmental"}
    assert column(spark, ["отдел аренды помещений, телефон", "факсимиле", "Для  СМИ", "", None], X.is_department) == [True, False, True, False, False]


def test_identifier_blocks_hold_no_phones(spark):
    assert phones.site_numbers(nodes(spark, "<div>Телефон ИНН 8 812 111-22-33</div>")).count() == 0


def test_branch_literals(spark):
    html = """<script>var a = '[{"Phone": "8(812)111-22-33", "tel": 78121112255}, {"x": {"phone": "+78120009988"}}]'; b = "not json"; c = '{"telephone": "\\'+78121112244"}';</script>"""
    got = {r.key for r in phones.site_numbers(nodes(spark, html)).filter("source = 'branch_json'").collect()}
    assert got == {"88121112233", "78121112244"}


def _chain(n):
    """A page's markup with n branches in a script's literal, a kilobyte each, and n other ones in a graph of places."""
    flat = json.dumps([{"id": i, "phone": f"+7812{i:07d}", "about": "x" * 1000} for i in range(n)])
    graph = json.dumps({"@graph": [{"@type": "Store", "telephone": f"+7495{i:07d}"} for i in range(n)]})
    return f"<script>var b = '{flat}';</script><script type='application/ld+json'>{graph}</script>"


@pytest.mark.parametrize("n", [200, 201, 260, 3000])
def test_all_branches_and_places_of_a_page_count(spark, n):
    got = phones.site_numbers(nodes(spark, _chain(n))).select("key", "source").collect()
    assert sorted(map(tuple, got)) == sorted([(f"7812{i:07d}", "branch_json") for i in range(n)] + [(f"7495{i:07d}", "schema_place") for i in range(n)])


def test_branches_of_all_scripts_count(spark):
    scripts = [json.dumps([{"tel": f"+7812{i:03d}{k:04d}"} for k in range(90)]) for i in range(4)]
    got = phones.site_numbers(nodes(spark, "".join(f"<script>x = '{s}'</script>" for s in scripts)))
    assert {r.key for r in got.collect()} == {f"7812{i:03d}{k:04d}" for i in range(4) for k in range(90)}


def test_branch_values_are_texts_of_flat_objects(spark):
    mixed = r"""["[", 5, null, {"phone": "\u002b78121110001", "x": {"k": 1, "k": 2, "tel": "+78121110009"}}, "{\"tel\": \"+78121110008\"}", {"tel": 78121110002, "id": "78121110002"}, {"TEL": "+78121110003", "about": "a \"b\" c"}]"""
    got = phones.site_numbers(nodes(spark, f"<script>var a = '{mixed}';</script>"))
    assert {r.key for r in got.collect()} == {"78121110001", "78121110003"}


def test_contacts_page(spark):
    f = lambda n: extract.contacts_page(n, F.lit("https://a.example/"))
    assert one(spark, "<a href='/about'>x</a><a href='/kontakty'>y</a><a href='https://b.example/contacts'>z</a>", f) == "https://a.example/kontakty"
    assert one(spark, "<a href='/page/5'>Контакты</a><a href='/about'>x</a>", f) == "https://a.example/about"
    assert one(spark, "<a href='#contacts'>Контакты</a><a href='/'>contacts</a>", f) is None


def test_facts_keep_seats_and_venues_apart(spark):
    org = json.dumps({"@type": "Organization", "name": "N", "legalName": "ООО N", "address": "ул. Юрьева, д. 1", "telephone": "+74951112233"}, ensure_ascii=False)
    html = f"<script type='application/ld+json'>{org}</script><address>ул. Садовая, д. 2</address><p>Цена: от 500 руб</p><a href='mailto:a@b.example?x'>m</a>"
    r = facts.page_facts(nodes(spark, html).drop("nodes")).first()
    assert (r.address, r.legal_address, r.phone, r.price, r.email) == ("ул. Садовая, д. 2", "ул. Юрьева, д. 1", "+74951112233", "от 500 руб", "a@b.example")


def test_style_digits_are_no_phone(spark):
    clean = nodes(spark, "<style>p{a:8.1234567890}</style><script>'+78121112233'</script><p a='1'>x &amp; y</p><!-- c -->").select(dom.noise_free_html(F.col("html")).alias("o")).first().o
    assert "1234567890" not in clean and "8121112233" not in clean and '<p a="1">x &amp; y</p><!-- c -->' in clean


def _resolve(spark, rows):
    df = spark.createDataFrame([(1, f, v, s, i, "low") for i, (f, v, s) in enumerate(rows)], "item_pos long, field string, value string, source string, seq int, confidence string")
    return {r.field: r for r in resolve.resolve(df).collect()}, {r.field: r.conflicts for r in resolve.conflicts(df).collect()}


def test_ranks_hold_in_either_order(spark):
    names = ["search", "maps", "official_site", "operator_verified"]
    for a in names:
        for b in names:
            got, _ = _resolve(spark, [("hours", "A", a), ("hours", "B", b)])
            assert got["hours"].value == ("B" if names.index(b) >= names.index(a) else "A")


def test_poison(spark):
    assert _resolve(spark, [("phone", "1", "maps"), ("phone", None, "poison_lock"), ("phone", "2", "official_site")])[0]["phone"][2:] == (None, "poison_locked", "low", True)
    late = _resolve(spark, [("phone", "1", "official_site"), ("phone", None, "poison_lock")])[0]["phone"]
    assert late.value == "1" and not late.poisoned


def test_conflicts_and_longer_addresses(spark):
    got, n = _resolve(spark, [("address", "long one", "official_site"), ("address", "short", "official_site"), ("address", "other", "maps"), ("hours", "x", "maps"), ("hours", "x", "search")])
    assert got["address"].value == "long one" and n == {"address": 1, "hours": 0}


def test_news_score(spark):
    p = news.Project("mysite", ("spam",), ("good", "хорош"), ("src.ru",), ("Питер",), ("Москва",))
    rows = [
        ("Good news", "x", "https://a.b/c", "z", 1, 55),
        ("Spam", "x", "https://a.b/c", "z", 1, 0),
        ("x", "x", "https://vk.com/c", "z", 1, 0),
        ("x", "x", "https://a.b/", "z", 1, 0),
        ("x", "x", "https://a.b/c", "mysite.ru", 1, 0),
        ("Питер хорош", "ж" * 51, "https://a.b/c", "m.src.ru", 2, 50 + 5 + 10 + 5 + 10 + 10),
        ("Питерский", "", "https://a.b/c", "z", 1, 55),
        ("москва", None, "https://a.b/c", None, 1, 45),
    ]
    df = spark.createDataFrame(rows, "t string, s string, u string, src string, n int, want int")
    c = F.col
    assert [(r.o, r.want) for r in df.select("want", news.score(p, c("t"), c("s"), c("u"), c("src"), c("n")).alias("o")).collect() if r.o != r.want] == []


def test_news_store(spark, tmp_path):
    store = spark.createDataFrame([("1", "p", "u1", 5, "new"), ("2", "p", "u2", 9, "read")], "news_id string, project string, url string, score int, status string")
    batch = spark.createDataFrame([("3", "p", "u2", 1, "new", 0), ("4", "p", "u3", 1, "new", 1), ("5", "p", "u3", 1, "new", 2)], "news_id string, project string, url string, score int, status string, seq int")
    after = news.added(store, batch)
    assert sorted(r.news_id for r in after.collect()) == ["1", "2", "4"]
    assert [r.news_id for r in news.listed(after, "", 1, 2).collect()] == ["2", "1"] and news.listed(after, "new").count() == 2
    change = spark.createDataFrame([("1", "", 77), ("2", "old", -1), ("x", "a", 1)], "news_id string, new_status string, new_score int")
    got = {r.news_id: (r.status, r.score) for r in news.updated(after, change).collect()}
    assert got == {"1": ("new", 77), "2": ("old", 9), "4": ("new", 1)} and news.absent(after, change).first().news_id == "x"
    (tmp_path / "a.json").write_text('[{"news_id": "1", "url": "u", "score": 3}]')
    (tmp_path / "b.json").write_text('{"items": [{"news_id": "2"}]}')
    assert tables.read_news(spark, str(tmp_path / "a.json")).first().score == 3
    assert tables.read_news(spark, str(tmp_path / "b.json")).first().news_id == "2"
    assert tables.read_news(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "c.json").write_text(json.dumps({"projects": {"p": {"taboo_words": ["x"]}}}))
    assert tables.read_news_config(spark, str(tmp_path / "c.json")).first().taboo_words == ["x"]


def test_search_merge_and_fallback(spark):
    rows = [("q", 0, 0, "http://a.example/", "A", "s", None), ("q", 0, 1, "http://www.a.example", "A2", "", None), ("q", 1, 0, "http://b.example", "", "t", None), ("q", 2, 0, "http://c.example", "C", "", "down")]
    r = spark.createDataFrame(rows, "query string, provider_ord int, pos int, url string, title string, snippet string, error string")
    m = search.merged(r, ["query"]).first()
    assert (m.context, m.sources, m.n) == ("A: s\n\nt", "http://a.example/\nhttp://b.example", 2)


def test_cards(spark):
    assert column(spark, ["Большая Морская ул., 5", "Санкт-Петербург, Невский пр-т, 1", "дом 5", None], lambda c: maps.street_hint(c, F.lit("Санкт-Петербург"))) == ["морская", "невский петербург санкт т", "", ""]
    assert column(spark, ["http://link.2gis.ru/1?http://a.b", "http://link.2gis.ru/a.b", "http://x"], maps.catalogue_url) == ["http://a.b", "a.b", "http://x"]
    assert column(spark, ['[{"qc_geo": 2, "geo_lat": "1", "geo_lon": "2"}]', "[]", '[{"qc_geo": 0, "geo_lat": "x", "geo_lon": "2"}]', '[{"qc_geo": 1, "geo_lat": "1.5", "geo_lon": "2", "result": "r"}]'], lambda c: maps.cleaned_address(c).latitude) == [None, None, None, 1.5]


def test_organization_pages(spark):
    page = '<script>{"x": {"shortTitle": "A \\"B\\"", "status": "temporary-closed", "phones": [{"formatted": "1"}, {"formatted": "2"}], "coordinates": [30.5, 59.5]}} var y = "}"</script>'
    r = maps.organization(spark.createDataFrame([(page,), ("",), ("broken \"shortTitle\": \"Name\" \"coordinates\": [30.5, 59.5]",)], "html string")).select("org.*").collect()
    assert (r[0].name, r[0].status, r[0].phone, r[0].latitude) == ('A "B"', "temporarily_closed", "2", 59.5)
    assert r[1].name is None and (r[2].name, r[2].latitude) == ("Name", 30.5)


def test_cache_and_breaker(spark):
    puts = spark.createDataFrame([("k", "2024-01-01 00:00:00", 60, "a"), ("k", "2024-01-01 00:05:00", 0, "b")], "cache_key string, put_at string, ttl_seconds long, value string").withColumn("put_at", F.to_timestamp("put_at"))
    gets = spark.createDataFrame([(1, "k", "2024-01-01 00:00:59"), (2, "k", "2024-01-01 00:01:00"), (3, "k", "2025-01-01 00:00:00"), (4, "z", "2024-01-01 00:00:00")], "get_id long, cache_key string, get_at string").withColumn("get_at", F.to_timestamp("get_at"))
    assert {r.get_id: r.value for r in state.cache_hits(puts, gets).collect()} == {1: "a", 2: None, 3: "b", 4: None}
    shared = puts.withColumn("value", F.concat(F.lit("s"), "value")).withColumn("ttl_seconds", F.lit(0).cast("long"))
    levels = {r.get_id: (r.value, r.level) for r in state.tiered_hits(puts, shared, gets).collect()}
    assert levels == {1: ("a", "first"), 2: ("sa", "second"), 3: ("b", "first"), 4: (None, "miss")}
    calls = [(0, True), (10, False), (31, True), (92, False), (93, True), (120, False), (124, True)]
    df = spark.createDataFrame([("p", i, t, f) for i, (t, f) in enumerate(calls)], "by string, seq long, t long, failed boolean").withColumn("ts", F.timestamp_seconds("t"))
    got = [r.outcome for r in state.breaker(df, "by", "ts", "failed").orderBy("seq").collect()]
    assert got == ["error", "suspended", "error", "success", "error", "suspended", "error"]
    starts = [r.start_s for r in state.throttled(df, "by", "ts", 0.1, 1).orderBy("seq").collect()]
    assert starts[:3] == [0.0, 10.0, 31.0] and all(b - a >= 9.99 for a, b in zip(starts, starts[1:]))


def test_fetch_status_and_retries(spark):
    rows = [("https://a.b/", 1, "", 503, None, False), ("https://a.b/", 2, "ok", 200, None, False), ("https://c.d/", 1, "", 200, "https://e.f/", False), ("https://g.h/", 1, "", 0, None, True), ("https://g.h/", 2, "plain", 200, None, False), ("https://i.j/", 1, "", 503, None, False), ("https://i.j/", 2, "", 504, None, False)]
    f = tables.settled(spark.createDataFrame(rows, "url string, attempt int, html string, status_code int, final_url string, tls_error boolean"))
    assert {r.url: (r.attempt, r.status) for r in f.collect()} == {"https://a.b/": (2, "active"), "https://c.d/": (1, "redirect"), "https://g.h/": (2, "active"), "https://i.j/": (2, "unreachable")}


def test_certificate_errors(spark):
    rows = [("https://a.b/", 1, "", 0, None, True), ("https://c.d/", 1, "", 0, None, True), ("https://c.d/", 2, "", 0, None, False), ("https://e.f/", 1, "", 0, None, True), ("https://e.f/", 2, "page", 200, None, False), ("https://g.h/", 1, "page", 200, None, False)]
    f = tables.settled(spark.createDataFrame(rows, "url string, attempt int, html string, status_code int, final_url string, tls_error boolean"))
    assert {r.url: (r.status, r.tls_fallback_used) for r in f.collect()} == {"https://a.b/": ("tls_invalid", False), "https://c.d/": ("tls_invalid", False), "https://e.f/": ("active", True), "https://g.h/": ("active", False)}


def test_bodies_are_cut_between_letters(spark):
    rows = [("https://a.b/", 1, "x" + "я" * 1_200_000, 200, None, False), ("https://c.d/", 1, "я" * 10, 200, None, False)]
    got = {r.url: r.html for r in tables.classified(spark.createDataFrame(rows, "url string, attempt int, html string, status_code int, final_url string, tls_error boolean")).collect()}
    assert got == {"https://a.b/": "x" + "я" * 999_999, "https://c.d/": "я" * 10}


def test_long_texts_are_whole(spark):
    long = "word " * 2000
    html = f'<html><head><title>{long}</title></head><body><div itemscope itemtype="https://schema.org/Article"><p itemprop="articleBody">{long}</p></div></body></html>'
    n = nodes(spark, html)
    r = n.select(extract.title(F.col("nodes")).alias("t"), structured.items(F.col("nodes")).alias("i")).first()
    assert r.t.strip() == long.strip() and long.strip() in r.i[0]


def test_promotion_does_not_renew_itself(spark):
    shared = spark.createDataFrame([("k", 0, 0, "old"), ("k", 300, 0, "new")], "cache_key string, s long, ttl_seconds long, value string").withColumn("put_at", F.timestamp_seconds("s"))
    gets = spark.createDataFrame([(1, "k", 60), (2, "k", 290), (3, "k", 480)], "get_id long, cache_key string, s long").withColumn("get_at", F.timestamp_seconds("s"))
    assert {r.get_id: (r.value, r.level) for r in state.tiered_hits(shared.limit(0), shared, gets).collect()} == {1: ("old", "second"), 2: ("old", "first"), 3: ("new", "second")}


def test_a_page_is_parsed_once(spark):
    plan = phones.site_numbers(nodes(spark, "<a href='tel:+78121112233'>x</a>"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_parse_nodes(") == 1


def test_walks_are_linear():
    import time

    page = "<ul>" + "".join(f"<li>a {i}</li><li><a href='tel:+7812{i:07d}'>+7812{i:07d}</a></li>" for i in range(3000)) + "</ul>"
    began = time.time()
    assert sum(n["role"] is not None for n in dom._nodes(page, "https://a.b/")) >= 3000
    assert time.time() - began < 5


def test_enrichment_without_a_page_reads_search_results(spark):
    items = spark.createDataFrame([(1, "n", "", "", "news", False)], "item_pos long, name string, url string, city string, mode string, skip_maps_check boolean")
    fetches = spark.createDataFrame([("https://r.example/1", 1, "<article>found</article>", 200, None, False), ("https://r.example/2", 1, "<article>more</article>", 404, None, False)], "url string, attempt int, html string, status_code int, final_url string, tls_error boolean")
    results = spark.createDataFrame([(1, 0, "https://r.example/1", "T", "Адрес: ул. Мира, д. 5"), (1, 1, "https://r.example/2", "", "")], "item_pos long, pos int, url string, title string, snippet string")
    r = enrich(items, Sources(fetches, results=results)).first()
    assert (r.content, r.address, r.address_source, r.status) == ("found\n\n---\n\nmore", "ул. Мира, д. 5", "search", "active")


def test_cached_records_are_not_enriched_again(spark, tmp_path):
    from pyspark.sql import Observation

    from weftwork.plans import metrics
    from weftwork.plans.enrich import Config, enrich_cached, result_store

    store = result_store(spark, str(tmp_path / "store"))

    def run(html, day, ids=(1, 2)):
        items = spark.createDataFrame([(i, f"n{i}", f"https://s{i}.example/", "", "places", False) for i in ids], "item_pos long, name string, url string, city string, mode string, skip_maps_check boolean")
        rows = [(f"https://s{i}.example/", 1, html, 200, None, False) for i in ids]
        fetches = spark.createDataFrame(rows, "url string, attempt int, html string, status_code int, final_url string, tls_error boolean")
        seen = Observation()
        at = F.lit(f"2024-01-{day:02d} 00:00:00").cast("timestamp")
        out = metrics.observed(enrich_cached(items, Sources(fetches), store, at, f"day-{day}", config=Config(markdown=True)), seen)
        return {r.item_pos: (r.content, r.phone, r.cache_hit) for r in out.collect()}, seen.get

    one, counts = run("<article><h2>old</h2><a href='tel:+78125550001'>x</a></article>", 1, ids=(1,))
    assert (counts["records"], counts["cache_misses"], counts["site_resolved"], counts["phone_official_site"]) == (1, 1, 1, 1)
    assert one[1][0].startswith("## old")
    two, counts = run("<article>new</article>", 5)
    assert (counts["cache_hits"], counts["cache_misses"], counts["site_resolved"]) == (1, 1, 0)
    assert two == {1: (one[1][0], "+78125550001", True), 2: ("new", None, False)}
    again, _ = run("<article>newest</article>", 5)
    assert again == two and store.manifest()["version"] == 2
    late, _ = run("<article>newest</article>", 9)
    assert late == {1: ("newest", None, False), 2: ("new", None, True)}
    assert store.compact() and len(store.manifest()["batches"]) == 1
    assert {r.content for r in store.read().collect()} == {"newest", "new"} and not store.put(None, "day-9")


def test_store_keeps_the_newest_whoever_writes(spark, tmp_path):
    from weftwork.sources.store import Store

    store = Store(spark, str(tmp_path / "s"), ("k",), "at", "gone")
    rows = lambda *x: spark.createDataFrame(list(x), "k string, at int, v string, gone boolean")
    assert store.read() is None and not store.compact()
    assert store.put(rows(("a", 2, "new", False), ("b", 1, "x", False)), "1") and store.put(rows(("a", 1, "old", False), ("c", 1, "y", None)), "2")
    assert store.put(rows(("b", 1, "later batch", False), ("c", 2, None, True)), "3") and not store.put(rows(("a", 9, "repeat", False)), "3")
    got = lambda: {r.k: r.v for r in store.read().collect()}
    assert got() == {"a": "new", "b": "later batch"}
    # Another writer commits between this one's look at the manifest and its own commit.
    other, look = Store(spark, store.path, store.keys, store.newest, store.gone), Store.manifest
    calls = []

    def slow(self):
        calls.append(1)
        last = look(self)
        if len(calls) == 2:
            Store.manifest = look
            other.put(rows(("d", 1, "theirs", False)), "5")
        return last

    try:
        Store.manifest = slow
        assert store.put(rows(("e", 1, "mine", False)), "4")
    finally:
        Store.manifest = look
    assert got() == {"a": "new", "b": "later batch", "d": "theirs", "e": "mine"} and store.manifest()["version"] == 5
    assert store.compact() and got()["e"] == "mine"


def test_a_stream_that_is_killed_and_restarted_changes_the_news_store_once(spark, tmp_path):
    from weftwork.streaming import live

    kind = "url string, news_id string, title string, score int, status string, action string, seq long"
    src, store = str(tmp_path / "in"), live.news_store(spark, str(tmp_path / "store"))
    add = lambda *x: spark.createDataFrame(list(x), kind).coalesce(1).write.mode("append").parquet(src)
    add(("https://a.b/1", "1", "one", 50, "new", "add", 1), ("https://a.b/2", "2", "two", 60, "new", "add", 2), ("https://a.b/1", "9", "later", 10, "new", "add", 3))

    def run(fail=False):
        stream = spark.readStream.schema(kind).parquet(src)
        upsert = live.news_upsert(store, "news")

        def batch(df, n):
            upsert(df, n)
            if fail:
                raise RuntimeError("killed after the batch was stored")

        q = stream.writeStream.option("checkpointLocation", str(tmp_path / "c")).foreachBatch(batch).trigger(availableNow=True).start()
        try:
            q.awaitTermination(120)
        except Exception as e:
            assert "killed" in str(e)

    run(fail=True)
    run()
    state = lambda: {r.url: (r.news_id, r.title, r.score, r.status) for r in store.read().collect()}
    assert state() == {"https://a.b/1": ("1", "one", 50, "new"), "https://a.b/2": ("2", "two", 60, "new")} and store.manifest()["version"] == 1
    add(("https://a.b/2", None, None, 70, "", "update", 4), ("https://a.b/3", "3", "three", 5, "new", "add", 5), ("https://a.b/1", None, None, None, None, "purge", 6))
    run(fail=True)
    run()
    assert state() == {"https://a.b/2": ("2", "two", 70, "new"), "https://a.b/3": ("3", "three", 5, "new")} and store.manifest()["version"] == 2


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _streamed(spark, tmp_path, batches, schema, plan, out):
    """The rows of out's column by seq, of a stream that reads one batch after the other."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    src = str(tmp_path / "in")
    rows = []
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        q = plan(stream).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "c"))
        q = q.foreachBatch(lambda df, _: rows.extend(df.collect())).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    return [r[out] for r in sorted(rows, key=lambda r: r.seq)]


def test_streamed_breaker(spark, tmp_path):
    from weftwork.streaming import live

    batches = [[("p", 2, 10.0, False), ("p", 1, 0.0, True)], [("p", 3, 20.0, False), ("p", 4, 31.0, True)], [("p", 5, 90.0, False), ("p", 6, 91.0, False)]]
    got = _streamed(spark, tmp_path, batches, "provider string, seq long, at_s double, failed boolean", live.breaker, "outcome")
    assert got == ["error", "suspended", "suspended", "error", "suspended", "success"]


def test_streamed_cache(spark, tmp_path):
    from weftwork.streaming import live

    batches = [
        [("k", 1, 5.0, True, None, 0.0), ("k", 0, 5.0, False, "a", 60.0), ("z", 2, 5.0, True, None, 0.0)],
        [("k", 3, 64.0, True, None, 0.0), ("k", 4, 65.0, True, None, 0.0), ("z", 5, 66.0, False, "b", 0.0)],
        [("z", 6, 1e9, True, None, 0.0), ("k", 7, 70.0, True, None, 0.0)],
    ]
    got = _streamed(spark, tmp_path, batches, "cache_key string, seq long, at_s double, is_get boolean, value string, ttl_s double", live.cached, "value")
    assert got == ["a", None, "a", None, "b", None]


def test_patterns_are_safe_for_cyrillic():
    """Case-blind Cyrillic needs (?iu), and no bare word edge stands in any pattern."""
    from weftwork.functions import patterns as P

    for name, value in vars(P).items():
        if isinstance(value, str) and not name.startswith("_"):
            assert r"\b" not in value, name
            if any("а" <= ch <= "я" for ch in value.lower()) and "(?i" in value:
                assert "(?iu)" in value, name


ARTICLE = "<p>{0} first paragraph of the story, long enough to count, with a <a href='/x'>link</a> in it and some more words.</p><p>Short.</p><p>{0} second paragraph, also long enough to count, that goes on and on about the same thing.</p>"
MENU = "<ul>" + "".join(f"<li><a href='/{i}'>A section of the site {i}</a></li>" for i in range(12)) + "</ul>"


@pytest.mark.parametrize(
    "page, kept, left",
    [
        ("<body><div>" + MENU + "</div><div><h2>Head</h2>" + ARTICLE + "<p>End.</p></div><div><p>Cookies.</p></div></body>", ["Head", "first", "Short.", "second", "End."], ["section", "Cookies"]),
        ("<body>" + MENU + "<h1>Head</h1>" + ARTICLE + MENU + "</body>", ["Head", "first", "Short.", "second"], ["section"]),
        ("<body><table><tr><td>" + MENU + "</td><td>" + ARTICLE + "</td></tr></table></body>", ["first", "second"], ["section"]),
        ("<body><div>" + MENU + "</div><div>" + ARTICLE.format("One") + MENU + ARTICLE.format("Two") + "</div></body>", ["One first", "Two second"], []),
        ("<body><div class='sidebar'><p>" + "aside words " * 60 + "</p></div><div>" + ARTICLE + "</div></body>", ["first"], ["aside"]),
        ("<body><p>tiny</p></body>", ["tiny"], []),
        ("<body>" + MENU + "</body>", [], ["section"]),
        ("", [], []),
    ],
)
def test_articles_without_containers(page, kept, left):
    text = dom._article(dom._nodes(page, "https://a.b/"))
    assert all(k in text for k in kept) and not any(x in text for x in left)


def test_one_parse_gives_what_two_gave(spark):
    html = "<html><head><style>p{}</style></head><body><p a='1'>x &amp; y</p><!-- c --><a href='tel:+78121112233'>z</a></body></html>"
    r = dom.with_pages(spark.createDataFrame([(html, "https://a.b/"), (None, None)], "html string, url string")).withColumn("c", dom.noise_free_html(F.col("html"))).collect()
    assert r[0].clean == r[0].c and r[1].clean is None and r[0].nodes == nodes(spark, html).first().nodes
    plan = facts.page_facts(dom.with_pages(spark.createDataFrame([(1, html, "https://a.b/", "")], "page_id int, html string, url string, city string")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_parse_pages(") == 1 and "noise_free_html(" not in plan


def test_projects_scored_alike_by_walk_and_by_pattern(spark, monkeypatch):
    from weftwork.operators import news

    entries = [(i, p, t, s, f"https://n.example/{i}", src, e) for i, (p, t, s, src, e) in enumerate([("a", "Opening in New York", "great opening", "good.example", 2), ("a", "newyorker", "x" * 101, "www.good.example", 1), ("a", "no taboo", "", "", None), ("b", "Straße, a.b (c)", "c++ rocks", "", 0), ("b", None, None, None, None), ("c", "t", "s", "", 0), (None, "t", "s", "", 0), ("a", "the end new york", "york 2", "", 0), ("b", "xtaboo1", "Taboo", "b", 0)])]
    config = [("a", ["Taboo"], ["opening", "great", "york 2", "york"], ["good.example"], ["New York", "york", ""], ["end"]), ("b", ["xtaboo"], ["c++", "a.b", "straße", r"\\E"], None, ["c"], [""]), ("d", [], [], [], [], [])]
    e = spark.createDataFrame(entries, "news_id int, project string, title string, snippet string, url string, source string, engines int")
    c = spark.createDataFrame(config, "project string, taboo_words array<string>, positive_words array<string>, good_sources array<string>, city_names array<string>, rival_cities array<string>")
    run = lambda: {r.news_id: r.score for r in news.scored(e, c).collect()}
    walked = run()
    monkeypatch.setattr(news, "WORDS", 1)
    assert run() == walked
    for project, row in {x[0]: x for x in config}.items():
        own = news.Project(project, *[tuple(x or ()) for x in row[1:]])
        one = e.filter(F.col("project") == project).select("news_id", news.score(own, *map(F.col, ("title", "snippet", "url", "source", "engines"))).alias("s")).collect()
        assert {r.news_id: r.s for r in one} == {k: v for k, v in walked.items() if entries[k][1] == project}
    assert walked[5] is None and walked[6] is None


def test_cards_meet_records_whatever_the_words_weigh(spark, monkeypatch):
    from weftwork.operators import maps

    rows = [(i, f"ул. {'Садовая' if i % 3 else 'Лесная'} улочка{i % 7}", "Москва" if i % 2 else None) for i in range(60)] + [(100, None, "Москва"), (101, "д. 5", "Москва"), (102, "Москва", "Москва")]
    cards = [(i, f"Садовая ул., Улочка{i % 9}, 3", " москва" if i % 2 else "") for i in range(40)] + [(900, None, None)]
    r, c = spark.createDataFrame(rows, "record_id long, address string, city string"), spark.createDataFrame(cards, "card_id long, address string, city string")
    words = lambda a: {w for w in "".join(x if x.isalnum() else " " for x in (a or "").lower()).split() if w not in ("ул", "д") and not w[0].isdigit()}
    town = lambda x: (x or "").strip().lower()
    want = {}
    for i, a, t in rows:
        best = max(((len((words(a) & words(b)) - {town(t)}), -j) for j, b, u in cards if town(t) == town(u)), default=(0, 0))
        if best[0]:
            want[i] = (-best[1], best[0])
    for hot in (10**6, 3):
        monkeypatch.setattr(maps, "HOT", hot)
        assert {x.record_id: (x.card_id, x.shared) for x in maps.matched(r, c).collect()} == want


@pytest.mark.parametrize("sets", [0, 2, 6])
def test_cards_are_found_by_sets_of_words_and_long_addresses_by_pairs(spark, monkeypatch, sets):
    import random

    rng, names = random.Random(5), [f"слово{i}" for i in range(12)]
    rows, cards = ([(i, tuple(rng.sample(names, rng.choice((0, 1, 2, 3, 5, 9)))), rng.choice("аб")) for i in range(n)] for n in (80, 70))
    r = spark.createDataFrame([(i, " ".join(w), t) for i, w, t in rows], "record_id long, address string, city string")
    c = spark.createDataFrame([(i, " ".join(w), t) for i, w, t in cards], "card_id long, address string, city string")
    best = {i: max((len({*w} & {*v}), -j) for j, v, u in cards if u == t) for i, w, t in rows}
    monkeypatch.setattr(maps, "SETS", sets)
    assert {x.record_id: (x.shared, -x.card_id) for x in maps.matched(r, c).collect()} == {i: b for i, b in best.items() if b[0]}


def test_short_addresses_make_no_pairs(spark, monkeypatch):
    met = []
    pairs = maps._word_pairs
    monkeypatch.setattr(maps, "_word_pairs", lambda a, b: met.append(a.count() * b.count()) or pairs(a, b))
    r = spark.createDataFrame([(i, f"Садовая дом{i}") for i in range(300)], "record_id long, address string").withColumn("city", F.lit(""))
    c = r.select(F.col("record_id").alias("card_id"), "address", "city")
    assert maps.matched(r, c).filter("record_id = card_id and shared = 2").count() == 300 and not any(met)


@pytest.mark.parametrize("name", ["phone_pick", "phone_finders", "dni_detect", "site_contacts", "jsonld_article", "og_image_and_date", "jsonld_date"])
def test_a_table_of_one_file_is_parsed_by_many_tasks(spark, name):
    from weftwork.plans import derived_queries

    assert getattr(derived_queries, name)(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 8


def test_result_pages_are_dealt_before_they_are_read(spark):
    from weftwork.plans import derived_queries

    plan = derived_queries.result_pages(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition 8, true") == 3


def test_enriched_pages_are_dealt_before_the_parse(spark, monkeypatch):
    from weftwork.plans import derived_queries
    from weftwork.plans import enrich as plan

    seen, write = {}, plan.written
    dealt = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Repartition 8, true")
    monkeypatch.setattr(plan, "written", lambda df, name: seen.update({name: dealt(df)}) or write(df, name))
    derived_queries.enrich_end_to_end(spark, "/root/testdata/sf0.001")
    assert seen["enrich-first"] == 1 and seen["enrich-second"] == 1


def test_pages_are_parsed_a_few_at_a_time(spark, monkeypatch):
    import pyarrow as pa

    html, url = pa.array(["<p>" + "x" * 1000, None, "", "<p>y"] * 50), pa.array(["https://a.example/"] * 200)
    monkeypatch.setattr(dom, "MARKUP", 5000)
    for parse, of in ((dom._parse_nodes, lambda x: x), (dom._parse_pages, lambda x: x["nodes"])):
        parts = list(parse.func(iter([(html, url), (html[:0], url[:0])])))
        assert max(len(p) for p in parts) <= 20 and [len(of(x)) for p in parts for x in p.to_pylist()] == [3, 0, 0, 3] * 50
    monkeypatch.setattr(dom, "MARKUP", 1)
    assert sum(len(p) for p in dom._parse_nodes.func(iter([(html, url)]))) == 200


@pytest.mark.parametrize("name,want", CUT)
def test_references_that_a_cut_left_open_stand_as_they_are(spark, tmp_path, name, want):
    from weftwork.plans import page_queries

    text = "a &amp;amp b &#38; &lt;c&gt; &amp &#38 &am"
    html = f"<html><head><title>{text}</title></head><body><script>x && y</script><article><h1>{text}</h1></article></body></html>"
    spark.createDataFrame([(1, "https://a.example/", html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert getattr(page_queries, name)(spark, str(tmp_path)).first()[-1] == want


def test_result_pages_of_odd_shapes():
    import time

    from weftwork.sources.results import records, target

    base = "https://html.duckduckgo.com/html/"
    find = lambda html: records(dom._nodes(html, base, phones=False), base)
    assert find("") == [] and find("<p>No results.</p>") == []
    one = "<div class='r'><a href='https://x.example/'>Title</a><p>Some text about it</p></div>"
    assert find(one) == [("https://x.example/", "Title", "Some text about it")]
    assert find("<ol>" + "".join(f"<li><a href='https://x{i}.example/'>T{i}</a> <span>text {i} of it</span></li>" for i in range(3)) + "</ol>") == [(f"https://x{i}.example/", f"T{i}", f"text {i} of it") for i in range(3)]
    many = "<div>" * 40 + "<ul>" + "".join(f"<li><a href='https://x{i}.example/'>T{i}</a><p>some <b>text</b> {i}</p></li>" for i in range(3000)) + "</ul>"
    began = time.time()
    assert find(many)[2999] == ("https://x2999.example/", "T2999", "some text 2999") and time.time() - began < 20
    assert target("/l/?uddg=https%3A%2F%2Fa.example%2F%3Fb%3D1", base) == "https://a.example/?b=1"
    assert target("//duckduckgo.com/y.js?ad=1", base) is None and target("javascript:void(0)", base) is None and target("https://[bad", base) is None


def test_every_provider_is_known(spark):
    raw = spark.createDataFrame([(1, None), (2, ""), (3, "{")], "query int, payload string")
    for provider in ("brave", "google", "searxng", "ddg", "startpage", "proxy"):
        assert tables.searched(raw, provider).collect() == []


def test_a_render_alone_may_link_to_the_contacts_page(spark):
    """A homepage shell whose render tells no more but has a link; links go by where the page was found; a page of no fetch
    stands on the readability text."""
    items = spark.createDataFrame([(1, "n", "https://s.ru/", "", "places", False), (2, "m", "https://t.ru/", "", "places", False)], "item_pos long, name string, url string, city string, mode string, skip_maps_check boolean")
    fetches = spark.createDataFrame([("https://s.ru/", 1, "<div id='app'></div>", 200, "https://s.ru/ru/", False), ("https://s.ru/ru/contacts", 1, "<footer><address>ул. Садовая, д. 5</address><a href='tel:+78125550001'>x</a></footer>", 200, None, False)], "url string, attempt int, html string, status_code int, final_url string, tls_error boolean")
    renders = spark.createDataFrame([("https://s.ru/", 2, "<a href='/other/contacts'>Контакты</a>" + "<p>" + "x " * 600), ("https://s.ru/", 1, "<a href='contacts'>Контакты</a>" + "<p>" + "x " * 600)], "url string, attempt int, html string")
    service = spark.createDataFrame([("https://t.ru/", "told by a service", "T", "A", None)], "url string, content string, title string, author string, excerpt string")
    one, two = enrich(items, Sources(fetches, renders=renders, readability=service)).orderBy("item_pos").collect()
    assert (one.phone, one.address, one.url, one.status, one.render_skipped) == ("+78125550001", "ул. Садовая, д. 5", "https://s.ru/ru/", "active", False)
    assert (one.legs.render_thin_content, one.legs.render_error, one.legs.contacts_resolved) == (1, 0, 1)
    assert (two.content, two.title, two.author, two.status) == ("told by a service", "T", "A", "active")
