"""Every pattern and word list once, in the dialect of Spark's `rlike` and `regexp_*` (java.util.regex).

Case-blind patterns over Cyrillic take (?iu); word edges are written as ASCII lookarounds, for a bare word edge would also
see Cyrillic letters. `ASCII_WORD` and its negation stand for the edges.
"""

# All that follows are fixed values: the numbering plan, word lists and formats that results depend on.

_B, _E = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"

#: Valid area and operator codes, as closed ranges.
AREA_CODES = ((301, 349), (351, 395), (401, 499), (800, 816), (820, 879), (900, 999))
MOBILE = (900, 999)
SERVICE = (803, 809)
TOLL_FREE = 800

CITY_CODES = {
    "санкт-петербург": (812,),
    "петербург": (812,),
    "спб": (812,),
    "spb": (812,),
    "saint petersburg": (812,),
    "st petersburg": (812,),
    "st. petersburg": (812,),
    "москва": (495, 499),
    "moscow": (495, 499),
    "мск": (495, 499),
    "msk": (495, 499),
}

STYLE = r"[{}]|[0-9A-Za-z_]+\s*:\s*[0-9A-Za-z_]+\s*;|:\s*[0-9A-Za-z_]+\(|margin|padding|display|font-size"
TAG = r"<[a-zA-Z/]"
SCRIPT = r"(?:var |const |let |function |=>|===)"
PRICE_FREE = r"(?iu)(?:бесплатно|free)"
PRICE_MOST = 60

STREET = (
    r"(?iu)(?:ул\.|улица|пр\.|просп|проспект|наб\.|набережная|пер\.|переулок|ш\.|шоссе|пл\.|площадь|б-р|бульвар|линия|аллея|остров|"
    r"город(?=[0-9A-Za-z_])|г\.\s*[0-9A-Za-z_]|д\.\s*[0-9]|корп\.|стр\.|лит\.|"
    + "|".join(rf"{_B}{w}{_E}" + (r"\.?" if w in ("st", "ave", "rd") else "") for w in ("street", "st", "avenue", "ave", "road", "rd", "drive", "lane", "blvd"))
    + ")"
)
MARKETING = r"(?iu)(?:бронирование|меню|цены|как пройти|режим работы|собственник|без комиссии|аренда|официальном сайте|подробнее|интересные факты|фото)"
ADDRESS_LENGTH = (8, 120)
LEGAL_ADDRESS = r"(?iu)(?:юридическ|реквизит|инн|огрн|огрнип|кпп|(?:^|[\s,.;«])(?:ооо|оао|зао|пао|ао|ип)(?:[\s,.;»]|$))"
LEGAL_ID = r'(?iu)(?:^|[\s,.;:«"(])(?:инн|огрнип|огрн|кпп)(?:[\s,.;:»")]|$)'
LEGAL_ID_KEY = r"(?iu)^(?:инн|огрнип|огрн|кпп|taxid|vatid)$"

PHONE = r"(?:\+7|8)[\s\-]?\(?[0-9]{3}\)?[\s\-]?[0-9]{3}[\s\-]?[0-9]{2}[\s\-]?[0-9]{2}"
ADDRESS = r"(?iu)(?:адрес|address)[:\s]+([^\n<]{5,100})"
PRICE = r"(?iu)(?:цена|стоимость|price)[:\s]+((?:от\s+|до\s+|from\s+)?(?:бесплатно|free|[0-9$€£])[^\n<]{0,29})"
SNIPPET_ADDRESS = r"(?iu)(?:адрес|address)[:\s]+([^\n]{5,100})"
SNIPPET_PRICE = r"(?iu)(?:цена|стоимость|price)[:\s]+((?:от\s+|до\s+|from\s+)?(?:бесплатно|free|[0-9$€£])[^\n]{0,29})"

HOURS_LABEL = r"(?iu)(?:режим|часы|время)\s+работы"
HOURS_VALUE = r"(?iu)(?:[0-9]{1,2}[:.][0-9]{2}\s*[-–—]\s*[0-9]{1,2}[:.][0-9]{2}|ежедневно|круглосуточно|без выходных|выходной|(?:пн|вт|ср|чт|пт|сб|вс|пон|втор|сред|четв|пятн|субб|воскр)[а-я]*)"
HOURS_LENGTH = (4, 160)
ORG_NOISE = r"(?iu)(?:ООО|ОАО|ЗАО|ИП(?=[0-9A-Za-z_])|ИНН|ОГРН|КПП|юридическ)"

PHONE_LABEL = rf"(?iu)(?:телефон|тел[.:]|моб[.:]|сотов|звони|вайбер|viber|whats\s?app|{_B}telephone{_E}|{_B}phone{_E}|{_B}tel[.:])"
ID_LABELS = ("ИНН", "ОГРН", "ОГРНИП", "КПП", "БИК", "ОКПО", "ОКАТО", "ОКТМО", "IBAN", "SWIFT", "р/с", "к/с", "р/сч", "к/сч", "расчётный счёт", "расчетный счет", "расчётный счет", "лиценз")

DEPARTMENT_PARTS = (
    "бухгалтер", "отдел кадров", "кадровая служба", "отдел персонала", "юридический отдел", "юротдел", "юрслужба", "пресс-служба",
    "пресс-центр", "для сми", "для прессы", "отдел закупок", "претензи", "оптовый отдел", "приёмная директора", "приемная директора",
    "по вопросам аренды", "вопросам аренды", "аренда мест", "аренды мест", "аренда помещен", "аренды помещен", "аренда площад",
    "аренды площад", "аренда торгов", "аренды торгов", "по вопросам сотрудничества", "по вопросам поставок", "для поставщиков",
    "для партнёров", "для партнеров", "оптовый прайс",
)
DEPARTMENT_WORDS = ("факс", "fax")
NAVIGATION = ("menu", "nav", "navbar", "navigation", "breadcrumb")

#: Call-tracking vendors: tokens of script addresses, tokens of inline scripts.
VENDORS = (
    ("roistat", ("roistat.com", "roistat.js"), ("window.roistat", "roistatprojectid", "roistat.init", "roistatcompanyid")),
    ("calltouch", ("calltouch.ru", "calltouch.js", "mod.calltouch"), ("window.ct(", "ct_data", "calltouch_session", "calltouchsiteid")),
    ("comagic", ("comagic.ru", "comagic.io", "comagic.js"), ("comagic.", "window.comagic", "__comagic")),
    ("mango", ("mango-office.ru", "mango.office", "mangooffice", "mango.js"), ("mango-office", "mangooffice", "mango_office", "window.mango", "mangoobject")),
    ("callibri", ("callibri.ru", "callibri.js", "cdn.callibri"), ("window.callibri", "callibri_", "__callibri")),
    ("uis", ("uiscom.ru", "uis-comagic", "uiscall"), ("window.uis", "uiscom.", "__uis")),
)

CONTACT_SLUGS = (
    "contact", "contacts", "contact-us", "contactus", "get-in-touch", "getintouch", "контакты", "контакт", "свяжитесь", "связаться",
    "kontakty", "kontakt", "kontakty-1", "svyazhites", "svyaz", "svyazatsya", "kontakte", "nous-contacter", "contacto", "contatti", "contato",
)
ABOUT_SLUGS = ("about", "about-us", "o-nas", "o-kompanii")
CONTACT_TEXTS = (
    "контакты", "контакт", "свяжитесь", "связаться", "связаться с нами", "contacts", "contact us", "contact", "get in touch",
    "kontakt", "kontakte", "kontakty", "nous contacter", "contacto", "contatti", "contato",
)

#: Boilerplate by tag, by class, by attribute; and the narrower set of elements that never hold text.
BOILER_TAGS = ("script", "style", "noscript", "iframe", "svg", "header", "footer", "nav", "aside")
BOILER_CLASSES = (
    "advertisement", "ad", "sidebar", "comments", "cookie-banner", "popup", "modal", "newsletter-signup", "social-share",
    "share-buttons", "breadcrumbs", "breadcrumb", "tags", "tag-list", "related", "related-articles", "related-news", "author-info",
    "author-bio", "author-card", "subscribe", "subscription", "newsletter", "widget", "incut", "banner",
)
BOILER_ROLES = ("navigation", "banner", "contentinfo")
NOISE_TAGS = ("script", "style", "noscript", "template", "svg", "head")
CONTENT_TAGS, CONTENT_CLASSES, CONTENT_IDS = ("article", "main"), ("content", "post-content", "article-content"), ("content",)
REGION_TAGS, REGION_CLASSES, REGION_IDS = ("header", "footer", "address"), ("contacts", "contact", "footer", "header"), ("contacts", "contact")
TRACKING_PARTS, TRACKING_CLASSES = ("calltrack", "calltouch", "comagic", "mango", "callibri", "uiscom"), ("b24-widget",)

BLOCKED_DOMAINS = (
    "pinterest.com", "pinterest.ru", "facebook.com", "instagram.com", "twitter.com", "x.com", "vk.com", "ok.ru", "tiktok.com",
    "youtube.com", "reddit.com", "telegram.org", "t.me", "wa.me", "apple.com", "google.com", "yandex.ru", "mail.ru", "avito.ru",
    "hh.ru", "wildberries.ru", "ozon.ru",
)

PLACE_TYPES = (
    "LocalBusiness", "Restaurant", "CafeOrCoffeeShop", "BarOrPub", "Hotel", "Store", "Place", "TouristAttraction", "Museum",
    "SportsActivityLocation", "EntertainmentBusiness",
)
ARTICLE_TYPES = ("Article", "NewsArticle", "BlogPosting", "WebPage")
ORGANIZATION_TYPES = ("Organization", "Corporation", "GovernmentOrganization")

ADDRESS_NOISE = (
    "улица", "ул", "проспект", "пр", "пр-т", "просп", "переулок", "пер", "набережная", "наб", "шоссе", "ш", "бульвар", "б-р", "бул",
    "площадь", "пл", "дом", "д", "корпус", "корп", "к", "строение", "стр", "литера", "лит", "реки", "линия", "аллея",
)
ADDRESS_ADJECTIVES = (
    "большая", "большой", "большое", "малая", "малой", "малое", "малый", "новая", "новый", "новое", "старая", "старый", "старое",
    "верхняя", "верхний", "верхнее", "нижняя", "нижний", "нижнее", "средняя", "средний", "среднее",
)
CITY_SYNONYMS = {"санкт-петербург": ("спб", "питер", "ленинград"), "москва": ("мск",)}

TIME_RANGES = {
    "ddg": {"day": "d", "week": "w", "month": "m"},
    "brave": {"day": "pd", "week": "pw", "month": "pm", "year": "py"},
    "google": {"day": "d1", "week": "w1", "month": "m1", "year": "y1"},
}

#: Sources of a value, weakest first; the place in the list is the rank.
SOURCES = ("none", "search", "maps", "aggregator", "official_site", "poison_lock", "operator_verified")

ORG_STATUS = r'"status"\s*:\s*"(permanent-closed|temporary-closed|open)"'
ORG_FIELDS = {
    "name": (r'"shortTitle"\s*:\s*"([^"]{2,100})"', r'"chain"\s*:\s*\{[^}]*?"name"\s*:\s*"([^"]{2,100})"', r'"name"\s*:\s*"([^"]{2,100})"'),
    "address": (r'"fullAddress"\s*:\s*"([^"]+)"', r'"address"\s*:\s*\{[^}]*?"formatted"\s*:\s*"([^"]+)"'),
    "phone": (r'"phones"\s*:\s*\[[^\]]*?"number"\s*:\s*"([^"]+)"', r'"phones"\s*:\s*\[[^\]]*?"formatted"\s*:\s*"([^"]+)"'),
    "hours": (r'"currentWorkingStatus"\s*:\s*\{[^}]*?"text"\s*:\s*"([^"]+)"', r'"hours"\s*:\s*\{[^}]*?"text"\s*:\s*"([^"]+)"'),
    "website": (r'"urls"\s*:\s*\[\s*"(https?://[^"]+)"', r'"urls"\s*:\s*\[[^\]]*?"value"\s*:\s*"(https?://[^"]+)"'),
    "rating": (r'"ratingData"\s*:\s*\{[^}]*?"ratingValue"\s*:\s*([0-9.]+)', r'"rating"\s*:\s*\{[^}]*?"score"\s*:\s*([0-9.]+)'),
}
ORG_COORDINATES = r'"coordinates"\s*:\s*\[([0-9.]+)\s*,\s*([0-9.]+)\]'
ORG_LISTS = (r'"categories"\s*:\s*(\[[^\]]+\])', r'"rubrics"\s*:\s*(\[[^\]]+\])')
ORG_ANCHORS = ('"shortTitle"', '"currentWorkingStatus"', '"fullAddress"', '"chain"', '"ratingData"', '"rubrics"')
