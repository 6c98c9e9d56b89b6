"""Result pages of search engines: records found by their shape, whatever the engine calls its classes."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import arrow_udf

from weftwork.sources import dom

# Query parameters that redirects carry the target in.
TARGETS = ("uddg", "url", "u", "q")
INLINE = frozenset(("#text", "#comment", "b", "em", "strong", "i", "span", "mark", "br"))
_ADDRESS = re.compile(r"^(?:https?://)?[\w.-]+\.[\w-]+(?:[/ ›>]\S*)*$")
RESULTS = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("url", "title", "snippet")]))


def target(href: str, base: str) -> str | None:
    """Where a link leads: out of the page's host, or, as a redirect of the host, to the address that it carries; else nowhere."""
    try:
        at = urlsplit(urljoin(base, href.strip()))
        if at.scheme not in ("http", "https"):
            return None
        known = dict(parse_qsl(at.query))
    except ValueError:
        return None
    own, host = urlsplit(base).hostname or "", at.hostname or ""
    inside = bool(own) and ".".join(host.split(".")[-2:]) == ".".join(own.split(".")[-2:])
    if not inside:
        return at.geturl() if host else None
    return next((known[k] for k in TARGETS if known.get(k, "").startswith(("http://", "https://"))), None)


def records(nodes: list[dict], base: str) -> list[tuple[str, str, str]]:
    """(url, title, snippet) of the page's largest set of like siblings that hold a link out of the page and a text beside it.

    Siblings are alike if they have a parent, tag and first class in common. A record's title is its first link out of the page
    with a text, its snippet the longest other piece of text that is not the title and no bare address.
    """
    plain = lambda t: " ".join(t.split())
    # Pieces of text: elements that hold nothing but words and marks of emphasis. Told bottom up, so that no subtree is walked twice.
    piece = [True] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):
        p = nodes[i]["parent"]
        if p >= 0 and not (nodes[i]["tag"] in INLINE and piece[i]):
            piece[p] = False
    kinds: dict[tuple, list[int]] = {}
    for i, n in enumerate(nodes):
        if n["tag"][0] != "#" and not (n["boiler"] and n["tag"] in ("script", "style", "noscript", "svg", "iframe")):
            kinds.setdefault((n["parent"], n["tag"], (dict(n["attrs"]).get("class", "").split() or [""])[0]), []).append(i)

    def inside(i: int) -> str:
        return plain("".join(x["own"] for x in nodes[i : nodes[i]["last"] + 1] if x["tag"] == "#text"))

    def record(i: int) -> tuple[str, str, str] | None:
        found, pieces = None, []
        for k in range(i, nodes[i]["last"] + 1):
            n = nodes[k]
            if n["tag"] == "a" and found is None and (to := target(dict(n["attrs"]).get("href", ""), base)) and (text := inside(k)):
                found = to, text, k
            elif n["tag"][0] != "#" and piece[k] and (found is None or not found[2] <= k <= nodes[found[2]]["last"]) and (text := inside(k)):
                pieces.append(text)
        if found is None:
            return None
        rest = [t for t in pieces if t != found[1] and not _ADDRESS.match(t)]
        return found[0], found[1], max(rest, key=len, default="")

    best: tuple[int, int, list] = (0, 0, [])
    for members in kinds.values():
        rows = [r for r in map(record, members) if r]
        told = sum(bool(r[2]) for r in rows)
        if told and (told, sum(len(r[2]) for r in rows)) > best[:2]:
            best = told, sum(len(r[2]) for r in rows), rows
    return best[2]


def results_udf(base: str):
    """Column function html -> array of (url, title, snippet) of a result page that was fetched from base."""

    @arrow_udf(RESULTS)
    def results(pages: pa.Array) -> pa.Array:
        rows = [[dict(zip(("url", "title", "snippet"), r)) for r in records(dom._nodes(h, base, phones=False), base)] if h else [] for h in pages.to_pylist()]
        return pa.array(rows, pa.list_(pa.struct([(c, pa.string()) for c in ("url", "title", "snippet")])))

    return results
