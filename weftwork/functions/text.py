"""Text functions, Column to Column, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftwork.functions import patterns as P

Col = Column


def trimmed(c: Col) -> Col:
    """Without white space, of any script, at either end (`trim` only knows U+0020)."""
    return F.regexp_replace(c, r"^[\s\x0B\x85\p{Z}]+|[\s\x0B\x85\p{Z}]+$", "")


def digits(c: Col) -> Col:
    return F.regexp_replace(c, "[^0-9]", "")


def one_spaced(c: Col) -> Col:
    """Trimmed, runs of ASCII white space as one space."""
    return F.regexp_replace(trimmed(c), r"\s+", " ")


def closed_references(html: Col) -> Col:
    """Markup in which an ampersand that begins no character reference closed by a semicolon stands for itself, as in `&amp` where a
    title was cut. Not for markup whose scripts are read: references in these are text."""
    return F.regexp_replace(html, r"&(?!(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][0-9A-Za-z]*);)", "&amp;")


def clean_lines(c: Col) -> Col:
    """Lines trimmed, empty ones dropped."""
    return F.array_join(F.filter(F.transform(F.split(c, "\n"), trimmed), lambda x: x != ""), "\n")


def truncate(c: Col, most: int) -> Col:
    """At most so many characters, cut at the last space if that lies past half the bytes. 0 keeps all."""
    if most <= 0:
        return c
    cut = F.substring(c, 1, most)
    before = F.regexp_extract(cut, r"(?s)^(.*) [^ ]*$", 1)
    late = F.contains(cut, F.lit(" ")) & (F.octet_length(before) > F.floor(F.octet_length(cut) / 2))
    return F.when(F.length(c) <= most, c).when(late, before).otherwise(cut)


def has_word(text: Col, word: str) -> Col:
    """Whether a lowered text holds a lowered word, bounded by anything but letters and digits of any script."""
    return text.rlike(rf"(?<![\p{{L}}\p{{Nd}}]){_quoted(word)}(?![\p{{L}}\p{{Nd}}])") if word else F.lit(False)


def has_token(text: Col, token: str) -> Col:
    """The same, bounded by anything but letters: a digit does bound."""
    return text.rlike(rf"(?<!\p{{L}}){_quoted(token)}(?!\p{{L}})") if token else F.lit(False)


def _quoted(word: str) -> str:
    return r"\Q" + word.replace(r"\E", r"\E\\E\Q") + r"\E"


def let(value: Col, then) -> Col:
    """then(value), with value worked out once however often it is used."""
    return F.try_element_at(F.transform(F.array(value), then), F.lit(1))


def any_of(conditions) -> Col:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def holds_any(text: Col, parts) -> Col:
    return any_of(F.contains(text, F.lit(p)) for p in parts)


def usable_hours(c: Col) -> Col:
    t = trimmed(c)
    return F.length(t).between(*P.HOURS_LENGTH) & t.rlike(P.HOURS_VALUE)


def clean_hours(c: Col) -> Col:
    """The first run of lines that look like opening hours, joined by "; "; null if there is none."""
    lines = F.transform(F.split(c, "\n"), trimmed)
    start = F.struct(F.lit(False).alias("done"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Col, line: Col) -> Col:
        good = (line != "") & ~line.rlike(P.ORG_NOISE) & line.rlike(P.HOURS_VALUE)
        return F.struct((acc.done | (~good & (F.size(acc.kept) > 0))).alias("done"), F.when(good & ~acc.done, F.concat(acc.kept, F.array(line))).otherwise(acc.kept).alias("kept"))

    return let(F.aggregate(lines, start, step).kept, lambda kept: F.when(usable_hours(c) & (F.size(kept) > 0), F.array_join(kept, "; ")))


def is_department(label: Col) -> Col:
    """Whether a role label names a department rather than the general line."""
    low = F.lower(one_spaced(F.coalesce(label, F.lit(""))))
    return low.rlike("|".join(map(_quoted, P.DEPARTMENT_PARTS)) + rf"|(?<!\p{{L}})(?:{'|'.join(P.DEPARTMENT_WORDS)})(?!\p{{L}})")


def first_group(c: Col, pattern: str) -> Col:
    """The first group of the first match, trimmed; null if that is empty."""
    return F.nullif(trimmed(F.regexp_extract(c, pattern, 1)), F.lit(""))


def first_match(c: Col, pattern: str) -> Col:
    return F.nullif(trimmed(F.regexp_extract(c, pattern, 0)), F.lit(""))
