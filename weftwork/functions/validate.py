"""Validators of phones, prices and addresses, and what a phone's area code tells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftwork.functions import patterns as P
from weftwork.functions.text import any_of, digits, let, trimmed


def _codes() -> str:
    """A pattern of the valid area codes, by their first two digits."""
    tens: dict[str, str] = {}
    for low, high in P.AREA_CODES:
        for code in map(str, range(low, high + 1)):
            tens[code[:2]] = tens.get(code[:2], "") + code[2]
    return "|".join(f"{t}[{last}]" for t, last in tens.items())


_PHONE = rf"^[78]({_codes()})[0-9]{{7}}$"


def area_code(phone: Column) -> Column:
    """Digits 2 to 4 of a valid phone, else -1."""
    return F.coalesce(F.regexp_extract(digits(phone), _PHONE, 1).try_cast("int"), F.lit(-1))


def valid_phone(phone: Column) -> Column:
    return F.coalesce(digits(phone).rlike(_PHONE), F.lit(False))


def valid_code(code: Column) -> Column:
    return F.coalesce(any_of(code.between(*r) for r in P.AREA_CODES), F.lit(False))


def mobile_code(code: Column) -> Column:
    return code.between(*P.MOBILE)


def service_code(code: Column) -> Column:
    return code.between(*P.SERVICE)


def toll_free(code: Column) -> Column:
    return code == P.TOLL_FREE


def geographic_code(code: Column) -> Column:
    return valid_code(code) & ~mobile_code(code) & ~toll_free(code) & ~service_code(code)


def canonical_phone(phone: Column) -> Column:
    """Digits; a leading 8 of eleven as 7."""
    return F.regexp_replace(digits(phone), r"^8([0-9]{10})$", "7$1")


def valid_price(price: Column) -> Column:
    return let(trimmed(F.coalesce(price, F.lit(""))), _price)


def _price(p: Column) -> Column:
    number = p.rlike("[0-9]") | p.rlike(P.PRICE_FREE)
    return (p != "") & (F.length(p) <= P.PRICE_MOST) & number & ~p.rlike(P.STYLE) & ~p.rlike(P.TAG) & ~p.rlike(P.SCRIPT) & ~F.contains(p, F.lit("://"))


def valid_address(address: Column) -> Column:
    return let(trimmed(F.coalesce(address, F.lit(""))), _address)


def _address(a: Column) -> Column:
    return F.length(a).between(*P.ADDRESS_LENGTH) & a.rlike(P.STREET) & ~a.rlike(P.MARKETING) & ~a.rlike(P.STYLE) & ~F.contains(a, F.lit("://"))


def legal_address(address: Column) -> Column:
    return F.coalesce(address.rlike(P.LEGAL_ADDRESS), F.lit(False))


def city_key(city: Column) -> Column:
    """Lowered, trimmed, a leading city mark taken off."""
    k = F.lower(trimmed(F.coalesce(city, F.lit(""))))
    k = trimmed(F.regexp_replace(k, r"^г\.", ""))
    return trimmed(F.regexp_replace(k, "^г ", ""))


def city_codes(city: Column) -> Column:
    """array<int> of a city's area codes, null if it is not known. A map literal of a dozen entries."""
    pairs = [F.lit(v) if isinstance(v, str) else F.array(*map(F.lit, v)) for kv in P.CITY_CODES.items() for v in kv]
    return F.try_element_at(F.create_map(*pairs), city_key(city))


def city_membership(phone: Column, city: Column) -> Column:
    """struct(match, foreign): a landline of the city, a landline of another place; neither without a known city."""
    codes, code = city_codes(city), area_code(phone)
    match = F.coalesce(F.array_contains(codes, code), F.lit(False))
    return F.struct(match.alias("match"), (codes.isNotNull() & ~match & geographic_code(code)).alias("foreign"))
