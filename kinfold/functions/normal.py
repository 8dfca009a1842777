r"""Normalisers as Column -> Column functions: built-in expressions only, so they stay in generated code.

All are total: null, blank and unusable input gives the empty string. White space means Unicode
white space, as `(?U)\s`.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import values as V


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once per row."""
    return F.get(F.transform(F.array(value), body), 0)


def strip(x: Column) -> Column:
    """x without white space at its ends; null becomes empty."""
    return F.regexp_replace(F.coalesce(x.cast("string"), F.lit("")), r"(?U)^\s+|\s+$", "")


def present(x: Column) -> Column:
    """Whether a string has more than white space."""
    return strip(x) != ""


def first_of(*options: Column) -> Column:
    """The first option that is not empty, else empty."""
    return F.coalesce(*[F.nullif(o, F.lit("")) for o in options], F.lit(""))


def words(x: Column) -> Column:
    return F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")


def capitalised(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))


def _lookup(table: dict[str, list[str]], key: Column) -> Column:
    """The table's name for a spelling, else null."""
    pairs = [F.lit(x) for name, spellings in table.items() for s in spellings for x in (s, name)]
    return F.try_element_at(F.create_map(*pairs), key)


def email(raw: Column) -> Column:
    return let(F.lower(strip(raw)), lambda e: F.when(e.rlike(V.EMAIL), e).otherwise(F.lit("")))


def phone_in(region: str) -> Callable[[Column], Column]:
    """The normaliser to E.164 for a home region. A number with `+` or the international prefix must have an assigned country code and a length that its plan has; others are of `region`.

    There is no check of area codes. North American numbers without an area code (7 digits) pass, as numbers that are possible.
    """
    home = V.REGIONS[region]
    own_lengths = V.PHONE_LENGTHS.get(home, V.ANY_LENGTH) + ("7," if home == "1" else "")
    prefix, trunk = ("011", r"^1(?=\d{10}$)") if home == "1" else ("00", "^0")

    def fits(n: Column, lengths: Column) -> Column:
        return F.contains(lengths, F.concat(F.lit(","), n.cast("string"), F.lit(",")))

    def full(x: Column) -> Column:
        code = F.regexp_extract(x, V.CALLING_CODE, 1)
        lengths = F.create_map(*[F.lit(v) for pair in V.PHONE_LENGTHS.items() for v in pair])
        known = F.coalesce(F.try_element_at(lengths, code), F.lit(V.ANY_LENGTH))
        return F.when((code != "") & fits(F.length(x) - F.length(code), known), F.concat(F.lit("+"), x)).otherwise(F.lit(""))

    def of(s: Column) -> Column:
        d = F.regexp_replace(s, r"\D", "")
        own = F.regexp_replace(d, trunk, "")
        here = F.when(fits(F.length(own), F.lit(own_lengths)), F.concat(F.lit(f"+{home}"), own))
        abroad = F.when(d.startswith(prefix), let(F.regexp_replace(d, f"^{prefix}", ""), full))
        return F.when(d == "", F.lit("")).when(s.startswith("+"), let(d, full)).otherwise(first_of(F.coalesce(abroad, F.lit("")), F.coalesce(here, F.lit(""))))

    return lambda raw: let(F.regexp_replace(strip(raw), r"(?i)\s*(?:ext\.?|extension|x|#)\s*\d{1,7}$", ""), of)


def phone(raw: Column) -> Column:
    return phone_in("US")(raw)


_iso: dict[str, str] = {}


def iso_countries() -> dict[str, str]:
    """ISO 3166 alpha-2 by alpha-2, alpha-3 (in capitals) and English name (in lower case), from the JVM's locale data."""
    if not _iso:
        locale = SparkSession.active()._jvm.java.util.Locale
        for code in locale.getISOCountries():
            one = SparkSession.active()._jvm.java.util.Locale("", code)
            _iso[code] = _iso[one.getISO3Country()] = _iso[one.getDisplayCountry(locale.ENGLISH).lower()] = code
    return _iso


def country(raw: Column) -> Column:
    """ISO 3166 alpha-2: aliases, codes, English names, other and official names; at last a long form without its form of government.

    So `Kingdom of Spain` and `Republic of Korea` are known. There is no search by likeness of letters.
    """
    known = F.from_json(F.lit(json.dumps(iso_countries())), "map<string,string>")  # folded into one constant
    other = F.from_json(F.lit(json.dumps(V.COUNTRY_NAMES)), "map<string,string>")

    def named(key: Column) -> Column:
        return F.coalesce(_lookup(V.COUNTRIES, key), F.try_element_at(other, key), F.when(F.length(key) > 3, F.try_element_at(known, key)))

    def of(s: Column) -> Column:
        key = F.lower(s)
        by_code = F.when(F.length(s).isin(2, 3), F.try_element_at(known, F.upper(s)))
        return F.coalesce(_lookup(V.COUNTRIES, key), by_code, named(key), named(F.regexp_replace(key, V.GOVERNMENT, "")), F.lit(""))

    return let(strip(raw), of)


def date(raw: Column) -> Column:
    """YYYY-MM, or `present`. Years 1900 to 2100; a bare year is its January."""
    shapes = [  # (pattern, group of the year, group of the month or None)
        (r"^(\d{4})[-/](\d{1,2})[-/]\d{1,2}(?:[ t].*)?$", 1, 2),
        (r"^(\d{4})-(\d{1,2})$", 1, 2),
        (r"^(\d{1,2})[/-](\d{4})$", 2, 1),
        (r"^([a-z]+)\s+(\d{4})$", 2, 1),
        (r"^(\d{4})\s+([a-z]+)$", 1, 2),
        (r"^(\d{4})$", 1, None),
    ]

    def of(s: Column) -> Column:
        def read(pattern: str, y: int, m: int | None) -> Column:
            year = F.regexp_extract(s, pattern, y)
            if m is None:
                month = F.lit("01")
            else:
                named = F.regexp_extract(s, pattern, m)
                month = F.coalesce(_lookup(V.MONTHS, named), F.lpad(named, 2, "0"))
            good = s.rlike(pattern) & year.rlike(r"^(?:19\d\d|20\d\d|2100)$") & month.rlike(r"^(?:0[1-9]|1[0-2])$")
            return F.when(good, F.concat(year, F.lit("-"), month))

        ongoing = F.when(s.isin(V.ONGOING), F.lit("present"))
        return F.coalesce(ongoing, *[read(*x) for x in shapes], F.lit(""))

    return let(F.lower(strip(raw)), of)


def skill(raw: Column) -> Column:
    """The canonical name, else each word capitalised; short words in capitals stay."""

    def word(w: Column) -> Column:
        acronym = (w == F.upper(w)) & (w != F.lower(w)) & F.length(w).between(2, 4)
        return F.when(acronym, w).otherwise(capitalised(w))

    return let(strip(raw), lambda s: F.coalesce(_lookup(V.SKILLS, F.lower(s)), F.array_join(F.transform(words(s), word), " ")))


def name(raw: Column) -> Column:
    def part(p: Column) -> Column:
        low = F.lower(p)
        quote = F.instr(p, "'")
        return (
            F.when((quote > 0) & (F.length(p) > 2), F.concat(capitalised(F.substring_index(p, "'", 1)), F.lit("'"), capitalised(p.substr(quote + 1, F.length(p)))))
            .when(low.startswith("mc") & (F.length(p) > 2), F.concat(F.lit("Mc"), capitalised(F.substring(p, 3, 1 << 30))))
            .when(low.startswith("mac") & (F.length(p) > 3), F.concat(F.lit("Mac"), capitalised(F.substring(p, 4, 1 << 30))))
            .when(low.isin(V.PARTICLES), low)
            .otherwise(capitalised(p))
        )

    return F.array_join(F.transform(words(strip(raw)), part), " ")


def url(raw: Column) -> Column:
    """https:// unless a scheme is given; scheme and host in lower case, no fragment, no slash at the path's end."""
    pattern = r"^(?i)(https?)://([^/?#]*)([^?#]*)(\?[^#]*)?(?:#.*)?$"

    def of(s: Column) -> Column:
        host = F.lower(F.regexp_extract(s, pattern, 2))
        query = F.regexp_extract(s, pattern, 4)
        built = F.concat(F.lower(F.regexp_extract(s, pattern, 1)), F.lit("://"), host, F.regexp_replace(F.regexp_extract(s, pattern, 3), "/+$", ""), F.when(query == "?", F.lit("")).otherwise(query))
        return F.when(host == "", F.lit("")).otherwise(built)

    schemed = lambda s: F.when(s == "", F.lit("")).when(s.rlike(r"^(?i)https?://"), s).otherwise(F.concat(F.lit("https://"), s))
    return let(let(strip(raw), schemed), of)


def number(raw: Column, plus: bool = False) -> Column:
    """A double, or null; `plus`: a + at the end is dropped. NaN counts as missing."""
    s = strip(raw)
    x = (F.regexp_replace(s, r"\++$", "") if plus else s).try_cast("double")
    return F.when(F.isnan(x), F.lit(None)).otherwise(x)


def place(raw: Column) -> Column:
    """A struct city, region, country from up to three comma-separated parts; null if there is none."""

    def of(p: Column) -> Column:
        at = lambda i: F.coalesce(F.get(p, i), F.lit(""))
        return F.when(F.size(p) > 0, F.struct(at(0).alias("city"), at(1).alias("region"), at(2).alias("country")))

    return let(F.filter(F.transform(F.split(strip(raw), ","), strip), lambda x: x != ""), of)


def listed(raw: Column, separators: tuple[str, ...]) -> Column:
    """Items of a string, split at the first of `separators` that it contains."""
    s = strip(raw)
    split = reduce(lambda rest, sep: F.when(F.contains(s, F.lit(sep)), F.split(s, "[" + sep + "]" if len(sep) == 1 else sep)).otherwise(rest), reversed(separators), F.array(s))
    return F.filter(F.transform(split, strip), lambda x: x != "")


#: Names for the projection's inline normalisers.
NAMED = {"email": email, "e164": phone, "canonical": skill, "url": url, "lowercase": F.lower, "uppercase": F.upper}
