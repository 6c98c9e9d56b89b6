"""HTML pages as node lists: the one place where Python reads markup, a batch of pages at a time.

`with_nodes` parses each page once into array<node>; every finder after that is a Catalyst expression over it (`with_pages` gives
the markup without noise and the densest text too, from the same parse). A node has
its number in document order, its parent, the number of its last descendant (so a subtree is a range of numbers), its tag
(`#text` for text, `#comment`), its attributes, its own text and, for short subtrees, all of its text; and what it lies in: boilerplate, the nearest contact
area, tracking part and item, emphasis, a link. (Asked for in a lambda, these would be worked out again for every node.) Phone-bearing nodes also carry the text that names
their role, and phones printed as plain text near a phone label come as `#phone` nodes at the end.

What the parser promises: void elements, implied ends of p, li, dt, dd, tr, td, th and option, raw text in script, style,
iframe, noscript, noembed, noframes, xmp, textarea and title, character references, stray end tags ignored. It is not the
full HTML5 tree construction.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import escape, unescape
from html.parser import HTMLParser
from urllib.parse import quote, urljoin, urlsplit, urlunsplit

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import arrow_udf

from weftwork.functions import patterns as P

# Elements without content, elements whose content is text, and what an opening tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style iframe noscript noembed noframes xmp textarea title".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

#: Text of a whole subtree is kept with its node up to so many characters; `whole` puts longer ones together where asked for.
SUBTREE = 4000

NODE = T.StructType(
    [
        T.StructField("id", T.IntegerType()),
        T.StructField("parent", T.IntegerType()),
        T.StructField("last", T.IntegerType()),
        T.StructField("tag", T.StringType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("own", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("next", T.IntegerType()),
        T.StructField("link", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("boiler", T.BooleanType()),
        T.StructField("content", T.BooleanType()),
        T.StructField("region", T.IntegerType()),
        T.StructField("tracking", T.IntegerType()),
        T.StructField("scope", T.IntegerType()),
        T.StructField("strong", T.BooleanType()),
        T.StructField("em", T.BooleanType()),
        T.StructField("href", T.StringType()),
    ]
)
_ARROW = pa.list_(pa.struct([("id", pa.int32()), ("parent", pa.int32()), ("last", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("own", pa.string()), ("text", pa.string()), ("next", pa.int32()), ("link", pa.string()), ("role", pa.string()), ("boiler", pa.bool_()), ("content", pa.bool_()), ("region", pa.int32()), ("tracking", pa.int32()), ("scope", pa.int32()), ("strong", pa.bool_()), ("em", pa.bool_()), ("href", pa.string())]))


class _Builder(HTMLParser):
    CDATA_CONTENT_ELEMENTS = tuple(RAW)

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.open: list[int] = []

    def _add(self, tag: str, attrs: list | None = None, own: str = "") -> int:
        self.nodes.append({"parent": self.open[-1] if self.open else -1, "tag": tag, "attrs": attrs or [], "own": own})
        return len(self.nodes) - 1

    def _in_body(self) -> None:
        """Content opens html and body where the page left them out; body ends the head."""
        if not self.open:
            self.open.append(self._add("html"))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "html" and any(n["tag"] == "html" for n in self.nodes):
            return
        if tag != "html":
            self._in_body()
        if tag in ("body", "frameset") or tag in BLOCKS or tag in ("a", "span"):
            self._close({"head"})
        if tag in BLOCKS:
            self._close({"p"}, stop={"button", "table", "td"})
        if tag in CLOSES:
            self._close(CLOSES[tag], stop={"ul", "ol", "dl", "table", "select"})
        seen: dict[str, str] = {}
        for k, v in attrs:
            seen.setdefault(k, v or "")
        at = self._add(tag, list(seen.items()))
        if tag not in VOID:
            self.open.append(at)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("path", "circle", "rect", "use", "line", "polygon") and self.open and self.nodes[self.open[-1]]["tag"] == tag:
            self.open.pop()

    def _close(self, tags: set, stop: set = frozenset()) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            name = self.nodes[self.open[i]]["tag"]
            if name in tags:
                del self.open[i:]
                return
            if name in stop or (name in BLOCKS and tags == {"p"}):
                return

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.nodes[self.open[i]]["tag"] == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        if data.strip() or self.open:
            self._in_body()
            if self.nodes[self.open[-1]]["tag"] in ("title", "textarea"):
                data = unescape(data)
            self._add("#text", own=data)

    def handle_comment(self, data: str) -> None:
        self._in_body()
        self._add("#comment", own=data)


def _absolute(base: str, href: str) -> str | None:
    """href against base, its path percent-encoded; null for fragments and what does not parse."""
    href = href.strip()
    if not href or href.startswith("#"):
        return None
    try:
        s = urlsplit(urljoin(base, href))
        return urlunsplit((s.scheme, s.netloc, quote(s.path, safe="/%:@!$&'()*+,;=~-._"), s.query, ""))
    except ValueError:
        return None


#: Levels that a phone's label or value is looked for above a node, and characters of a label.
LEVELS, LABEL = 4, 120
_PHONE, _PHONE_LABEL = re.compile(P.PHONE), re.compile(P.PHONE_LABEL)


class _Page:
    """Walks that go by siblings and ancestors; bounded by LEVELS."""

    def __init__(self, nodes: list[dict]) -> None:
        self.nodes = nodes
        self.children: dict[int, list[int]] = {}
        self.place: dict[int, int] = {}
        self.texts: dict[int, str] = {}
        self.phones: dict[int, bool] = {}
        self.labels: dict[int, list[str]] = {}
        for i, n in enumerate(nodes):
            if n["tag"][0] != "#":
                siblings = self.children.setdefault(n["parent"], [])
                self.place[i] = len(siblings)
                siblings.append(i)

    def text(self, i: int) -> str:
        """Text under a node without that of noise elements; the node itself counts whatever it is. Kept, for walks ask again."""
        if i in self.texts:
            return self.texts[i]
        out, skip = [], -1
        for n in self.nodes[i : self.nodes[i]["last"] + 1]:
            if n["id"] <= skip:
                continue
            if n["id"] > i and n["tag"] in P.NOISE_TAGS:
                skip = n["last"]
            elif n["tag"] == "#text":
                out.append(n["own"])
        self.texts[i] = "".join(out)
        return self.texts[i]

    def phone_in(self, i: int) -> bool:
        if i not in self.phones:
            self.phones[i] = bool(_PHONE.search(self.text(i)))
        return self.phones[i]

    def named(self, parent: int) -> list[str]:
        """For each child of a node, the text of the nearest earlier one that is no navigation, has text and no phone."""
        if parent not in self.labels:
            out, last = [], ""
            for k in self.children.get(parent, ()):
                out.append(last)
                if not self.navigation(k) and not self.phone_in(k) and (t := self.text(k).strip()):
                    last = t
            self.labels[parent] = out
        return self.labels[parent]

    def navigation(self, i: int) -> bool:
        n = self.nodes[i]
        a = dict(n["attrs"])
        names = f"{a.get('class', '')} {a.get('id', '')}".lower()
        return n["tag"] in ("nav", "menu") or a.get("role") in ("navigation", "menu", "menubar") or any(t in names for t in P.NAVIGATION)

    def role(self, i: int) -> str:
        """What names the role of a phone: the nearest earlier sibling without a phone, else an ancestor's own text."""
        for level in range(LEVELS + 1):
            if i < 0:
                break
            found = self.named(self.nodes[i]["parent"])[self.place[i]]
            if not found and level and not self.navigation(i):
                found = self.nodes[i]["own"].strip()
            if found:
                return re.sub(r"[ \t\n\f\r]+", " ", found)[:LABEL]
            i = self.nodes[i]["parent"]
        return ""

    def scope(self, i: int) -> int:
        """Where the phone of a label stands: the label's node, its next sibling, or the same of an ancestor; -1 for nowhere."""
        for _ in range(LEVELS + 1):
            if i < 0:
                break
            siblings = self.children[self.nodes[i]["parent"]]
            after = siblings[self.place[i] + 1] if self.place[i] + 1 < len(siblings) else -1
            for k in (i, after):
                if k >= 0 and self.phone_in(k):
                    return k
            i = self.nodes[i]["parent"]
        return -1

    def narrowest(self, i: int) -> int:
        while (k := next((k for k in self.children.get(i, ()) if self.nodes[k]["tag"] not in P.NOISE_TAGS and self.phone_in(k)), -1)) >= 0:
            i = k
        return i

    def plain_phones(self) -> list[tuple[str, str]]:
        """(phone, role) of phones printed near a phone label, but for tracked scopes and blocks of identifiers."""
        out = []
        for i, n in enumerate(self.nodes):
            if n["tag"][0] == "#" or n["tag"] in P.NOISE_TAGS or not _PHONE_LABEL.search(n["own"]):
                continue
            scope = self.scope(i)
            if scope < 0 or self.nodes[scope]["tracking"] is not None:
                continue
            at = self.narrowest(scope)
            text = self.text(at)
            if not any(t in text for t in P.ID_LABELS):
                out += [(m, self.role(at)) for m in _PHONE.findall(text)]
        return out


def _surroundings(nodes: list[dict]) -> None:
    """Sets what each node lies in, from its parent's and its own tag and attributes."""
    outside = {"boiler": False, "content": False, "region": None, "tracking": None, "scope": None, "strong": False, "em": False, "href": None}
    for i, n in enumerate(nodes):
        up = nodes[n["parent"]] if n["parent"] >= 0 else None
        n.update({k: up[k] for k in outside} if up else outside)
        n["content"] = False
        if up and any(k == "itemscope" for k, _ in up["attrs"]):
            n["scope"] = n["parent"]
        if n["tag"][0] == "#":
            continue
        a, tag = dict(n["attrs"]), n["tag"]
        names = set(a.get("class", "").split())
        if tag in P.BOILER_TAGS or names & set(P.BOILER_CLASSES) or a.get("role") in P.BOILER_ROLES or a.get("aria-hidden") == "true" or "hidden" in a:
            n["boiler"] = True
        n["content"] = tag in P.CONTENT_TAGS or bool(names & set(P.CONTENT_CLASSES)) or a.get("id") in P.CONTENT_IDS
        if tag in P.REGION_TAGS or names & set(P.REGION_CLASSES) or a.get("id") in P.REGION_IDS:
            n["region"] = i
        if any(p in a.get("class", "") for p in P.TRACKING_PARTS) or names & set(P.TRACKING_CLASSES):
            n["tracking"] = i
        n["strong"], n["em"] = n["strong"] or tag in ("b", "strong"), n["em"] or tag in ("i", "em")
        if tag == "a" and "href" in a:
            n["href"] = a["href"]


def _nodes(html: str | None, url: str | None, phones: bool = True) -> list[dict]:
    if not html:
        return []
    b = _Builder()
    b.feed(html)
    b.close()
    nodes = b.nodes
    _surroundings(nodes)
    texts: list[str | None] = [""] * len(nodes)
    follows: dict[int, int] = {}
    for i in range(len(nodes) - 1, -1, -1):
        n = nodes[i]
        n["id"], n["last"] = i, max(i, n.get("last", i))
        if n["tag"] == "#text":
            texts[i] = n["own"]
        p = n["parent"]
        if n["tag"][0] != "#":
            n["next"] = follows.get(p)
            follows[p] = i
        if p >= 0:
            nodes[p]["last"] = max(nodes[p].get("last", p), n["last"])
            if n["tag"] == "#text":
                nodes[p]["own"] = n["own"] + nodes[p]["own"]
            if n["tag"] != "#comment":
                both = None if texts[p] is None or texts[i] is None else texts[i] + texts[p]
                texts[p] = both if both is not None and len(both) <= SUBTREE else None
    for n, text in zip(nodes, texts):
        n["text"] = text
        n.setdefault("next", None)
        n["role"] = None
        n["link"] = _absolute(url or "", dict(n["attrs"])["href"]) if n["tag"] == "a" and any(k == "href" for k, _ in n["attrs"]) else None
    if phones and html and any(x in html for x in ("tel:", "TEL:", "telephone")) or phones and _PHONE.search(html):
        page = _Page(nodes)
        for n in nodes:
            a = dict(n["attrs"])
            if n["tag"] == "a" and a.get("href", "").startswith(("tel:", "TEL:")) or a.get("itemprop") == "telephone":
                n["role"] = page.role(n["id"])
        for value, role in page.plain_phones():
            i = len(nodes)
            nodes.append({"id": i, "parent": -1, "last": i, "tag": "#phone", "attrs": [], "own": value, "text": value, "next": None, "link": None, "role": role, "boiler": False, "content": False})
    return nodes


#: Bytes of markup whose nodes are held, and handed on, at once; a larger page stands alone.
MARKUP = 1 << 17


def _runs(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[tuple[list, list]]:
    """(pages, addresses) in runs of MARKUP bytes: a batch has 10,000 rows, whatever their size, and nodes take some fifty times the
    room of their markup."""
    for html, url in batches:
        ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(html), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(ends):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + MARKUP, side="right")))
            yield html.slice(at, to - at).to_pylist(), url.slice(at, to - at).to_pylist()
            at = to


@arrow_udf(T.ArrayType(NODE))
def _parse_nodes(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for html, url in _runs(batches):
        yield pa.array([_nodes(h, u) for h, u in zip(html, url)], _ARROW)


#: Said to be nondeterministic so that the optimizer never copies it: a filter that it derives from an explode over nodes
#: would parse each page a second time.
parse_nodes = _parse_nodes.asNondeterministic()


#: Blocks whose text counts as one piece of an article. A block is worth its characters outside links, less those inside and PIECE.
_PIECES, PIECE = BLOCKS | {"body", "html", "li", "dt", "dd", "td", "th", "tr"}, 40


def _article(nodes: list[dict]) -> str:
    """The text of the densest part of a page, whatever its elements are called: a line a block.

    Text goes to blocks in document order; boilerplate and noise are left out. The run of blocks of the greatest sum of worths
    (of prefix sums, the greatest rise) is the article's core. If an element below the body holds the whole core, so do its
    other blocks that are no link lists belong to it (a core of one block is widened to what that lies in); else only headings
    right before the core do. Where no block is worth anything, as on very short pages, the best one is the core.
    """
    blocks: list[list] = []
    home: dict[int, int] = {}
    skip = -1
    for i, n in enumerate(nodes):
        if i <= skip or n["tag"] == "#phone":
            continue
        if n["tag"] in P.NOISE_TAGS or n["boiler"]:
            skip = n["last"]
            continue
        if n["tag"][0] != "#":
            home[i] = i if n["tag"] in _PIECES else home.get(n["parent"], i)
        elif n["tag"] == "#text":
            at = home.get(n["parent"], n["parent"])
            if not blocks or blocks[-1][0] != at:
                blocks.append([at, [], 0])
            blocks[-1][1].append(n["own"])
            blocks[-1][2] += len(n["own"].strip()) if n["href"] is not None else 0
        if n["tag"] == "br" and blocks:
            blocks[-1][1].append(" ")
    texts = [" ".join("".join(b[1]).split()) for b in blocks]
    rows = [(b[0], t, b[2]) for b, t in zip(blocks, texts) if t]
    total, low, low_at, best, core = 0, 0, 0, 0, None
    for k, (_, t, linked) in enumerate(rows):
        total += len(t) - 2 * linked - PIECE
        if total - low > best:
            best, core = total - low, (low_at, k + 1)
        if total < low:
            low, low_at = total, k + 1
    if core is None:
        worth = [len(t) - 2 * linked for _, t, linked in rows]
        if not worth or max(worth) <= 0:
            return ""
        core = worth.index(max(worth)), worth.index(max(worth)) + 1
    a, b = core

    def above(i: int) -> list[int]:
        out = []
        while i >= 0:
            out.append(i)
            i = nodes[i]["parent"]
        return out[::-1]

    shared = above(rows[a][0] if b - a > 1 else nodes[rows[a][0]]["parent"])
    for at, _, _ in rows[a + 1 : b]:
        shared = [x for x, y in zip(shared, above(at)) if x == y]
    root = shared[-1] if shared else 0
    if nodes[root]["tag"] not in ("html", "body"):
        kept = [t for at, t, linked in rows if root <= at <= nodes[root]["last"] and 2 * linked <= len(t)]
    else:
        while a and nodes[rows[a - 1][0]]["tag"] in ("h1", "h2", "h3", "h4", "h5", "h6"):
            a -= 1
        kept = [t for _, t, _ in rows[a:b]]
    return "\n".join(kept)


_PAGE = T.StructType([T.StructField("nodes", T.ArrayType(NODE)), T.StructField("clean", T.StringType()), T.StructField("article", T.StringType())])


@arrow_udf(_PAGE)
def _parse_pages(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for html, url in _runs(batches):
        nodes = [_nodes(h, u) for h, u in zip(html, url)]
        clean = [None if h is None else _written_out(n) for h, n in zip(html, nodes)]
        columns = [pa.array(nodes, _ARROW), pa.array(clean, pa.string()), pa.array(map(_article, nodes), pa.string())]
        yield pa.StructArray.from_arrays(columns, ["nodes", "clean", "article"])


parse_pages = _parse_pages.asNondeterministic()


def with_pages(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """pages with nodes, `clean` (the markup without noise elements) and `article` (the densest text), by one parse."""
    out = pages.withColumn("_page", parse_pages(html, url))
    return out.select(*pages.columns, "_page.nodes", "_page.clean", "_page.article")


def with_nodes(pages: DataFrame, html: str = "html", url: str = "url", to: str = "nodes") -> DataFrame:
    """pages with a column of nodes. Filters belong before this, for they do not pass a Python function."""
    return pages.withColumn(to, parse_nodes(html, url))


def attr(n: Column, name: str) -> Column:
    return F.try_element_at(n.attrs, F.lit(name))


def node(nodes: Column, i: Column) -> Column:
    return F.try_element_at(nodes, i + 1)


def whole(nodes: Column, n: Column) -> Column:
    """All text under a node, whatever its length: kept with the node if short, else put together from its text nodes."""
    inside = F.filter(F.slice(nodes, n.id + 1, n.last - n.id + 1), lambda x: x.tag == "#text")
    return F.coalesce(n.text, F.array_join(F.transform(inside, lambda x: x.own), ""))


def text_of(nodes: Column, root: Column) -> Column:
    """All text under a node, but for boilerplate, head and title."""
    inside = F.filter(F.slice(nodes, root.id + 1, root.last - root.id + 1), lambda n: (n.tag == "#text") & ~n.boiler)
    return F.array_join(F.transform(inside, lambda n: n.own), "")


def _written_out(nodes: list[dict]) -> str:
    """A page written out again without script, style, noscript, template, svg and head: attributes and comments stay."""
    parts, ends = [], []
    skip = -1
    for n in nodes:
        if n["tag"] == "#phone":
            break
        while ends and ends[-1][0] < n["id"]:
            parts.append(ends.pop()[1])
        if n["id"] <= skip:
            continue
        if n["tag"] in P.NOISE_TAGS:
            skip = n["last"]
        elif n["tag"] == "#text":
            parts.append(escape(n["own"], quote=False))
        elif n["tag"] == "#comment":
            parts.append(f"<!--{n['own']}-->")
        else:
            parts.append("<" + n["tag"] + "".join(f' {k}="{escape(v)}"' for k, v in n["attrs"]) + ">")
            if n["tag"] not in VOID:
                ends.append((n["last"], f"</{n['tag']}>"))
    return "".join([*parts, *(e for _, e in reversed(ends))])


@arrow_udf(T.StringType())
def noise_free_html(html: pa.Array) -> pa.Array:
    """Pages written out again without noise elements."""
    return pa.array([None if h is None else _written_out(_nodes(h, "", phones=False)) for h in html.to_pylist()], pa.string())
