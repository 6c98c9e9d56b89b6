"""URL functions on the text itself: a URL that does not parse gives null or an empty text, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftwork.functions import patterns as P

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://(?:([^@/?#]*)@)?([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, f"(?s){_PARTS}", i)


def parses(url: Column) -> Column:
    return ~url.rlike(r"[\x00-\x1f\x7f]") & ~F.regexp_replace(url, r"(?s)[?#].*$", "").rlike(r"%(?![0-9A-Fa-f]{2})|^:")


def normal_url(url: Column) -> Column:
    """No fragment, scheme and host lowered, no leading www., no slashes at the end; "" if it does not parse."""
    scheme, user, host, path, query = (_part(url, i) for i in range(1, 6))
    whole = F.concat(
        F.when(scheme != "", F.concat(F.lower(scheme), F.lit(":"))).otherwise(""),
        F.when(host != "", F.lit("//")).otherwise(""),
        F.when(user != "", F.concat(user, F.lit("@"))).otherwise(""),
        F.regexp_replace(F.lower(host), r"^www\.", ""),
        path,
        query,
    )
    return F.when(parses(url), F.regexp_replace(whole, "/+$", "")).otherwise(F.lit(""))


def host_port(url: Column) -> Column:
    return F.lower(_part(url, 3))


def host(url: Column) -> Column:
    return F.regexp_replace(host_port(url), r":[0-9]*$", "")


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def path(url: Column) -> Column:
    return _part(url, 4)


def is_homepage(url: Column) -> Column:
    return parses(url) & path(url).isin("", "/")


def is_blocked(url: Column, domains: tuple[str, ...] = P.BLOCKED_DOMAINS) -> Column:
    """Whether the host is one of the domains or under one."""
    names = "|".join(d.replace(".", r"\.") for d in domains)
    return parses(url) & host(url).rlike(rf"(^|\.)(?:{names})$")


def is_self_reference(source: Column, key: Column) -> Column:
    s, k = F.lower(F.coalesce(source, F.lit(""))), F.lower(F.coalesce(key, F.lit("")))
    return (s != "") & (k != "") & (F.contains(s, k) | F.contains(k, s))


def plain_http(url: Column) -> Column:
    """The http: form of an https: URL, else null."""
    return F.when(scheme(url) == "https", F.regexp_replace(url, "(?i)^https:", "http:"))


def private_target(url: Column) -> Column:
    """Whether a URL may point inside: no web scheme or host, a local name, a private or loopback address. Fails closed."""
    h = host(url)
    inside = h.rlike(r"^(localhost|.*\.local|.*\.internal|0\..*|127\..*|10\..*|192\.168\..*|169\.254\..*|172\.(1[6-9]|2[0-9]|3[01])\..*|\[.*)$")
    return F.coalesce(~scheme(url).isin("http", "https") | (h == "") | inside, F.lit(True))


def last_segment(url_path: Column) -> Column:
    return F.lower(F.regexp_extract(F.regexp_replace(url_path, "^/+|/+$", ""), "([^/]*)$", 1))


def slug_class(url_path: Column) -> Column:
    """2 for a contacts page by its last path segment, 1 for an about page, 0 for others."""
    seg = last_segment(url_path)
    return F.when(seg.isin(*P.CONTACT_SLUGS), 2).when(seg.isin(*P.ABOUT_SLUGS), 1).otherwise(0)
