"""Values found in free text, as Column -> Column functions over built-in expressions.

Patterns run with Unicode classes and only a line feed as line end, `rx`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinfold.functions import values as V
from kinfold.functions.normal import first_of, let, place, strip


def rx(pattern: str, any_case: bool = False) -> str:
    return ("(?iuUd)" if any_case else "(?Ud)") + pattern


def find_all(text: Column, pattern: str, group: int = 0, any_case: bool = False) -> Column:
    return F.regexp_extract_all(text, F.lit(rx(pattern, any_case)), group)


def found(text: Column, pattern: str, any_case: bool = False) -> Column:
    return text.rlike(rx(pattern, any_case))


def group(text: Column, pattern: str, n: int, any_case: bool = True) -> Column:
    """The n-th group of the first match, else empty."""
    return F.regexp_extract(text, rx(pattern, any_case), n)


def distinct_by(items: Column, key: Callable[[Column], Column]) -> Column:
    """Items in order, the first of each key."""
    return let(items, lambda a: let(F.transform(a, key), lambda k: F.filter(a, lambda x, i: F.array_position(k, F.get(k, i)) == i + 1)))


def trimmed(x: Column) -> Column:
    return F.regexp_replace(strip(x), r"[.,;:]+$", "")


def emails(text: Column) -> Column:
    return distinct_by(find_all(text, V.FIND_EMAIL), F.lower)


def phones(text: Column) -> Column:
    digits = lambda x: F.regexp_replace(x, r"\D", "")
    fit = F.filter(F.transform(find_all(text, V.FIND_PHONE), strip), lambda x: F.length(digits(x)).between(7, 15))
    return distinct_by(fit, digits)


def links(text: Column, labelled: bool = False) -> Column:
    """A struct linkedin, github, portfolio, other. `labelled`: a label such as `GitHub:` comes first."""

    def profile(site: str, pattern: str) -> Column:
        named = group(text, rf"{site}\s*:\s*(https?://[^\s]+|{pattern})", 1) if labelled else F.lit("")
        hit = first_of(named, group(text, pattern, 0))
        return F.when((hit == "") | hit.startswith("http"), hit).otherwise(F.concat(F.lit("https://"), hit))

    urls = F.transform(find_all(text, V.FIND_URL), lambda u: F.regexp_replace(u, r"[.,;:)]+$", ""))
    others = F.filter(urls, lambda u: ~F.lower(u).rlike(r"linkedin\.com|github\.com"))
    return let(others, lambda o: F.struct(
        profile("LinkedIn", V.FIND_LINKEDIN).alias("linkedin"), profile("GitHub", V.FIND_GITHUB).alias("github"),
        F.coalesce(F.get(o, 0), F.lit("")).alias("portfolio"), F.array_distinct(F.slice(o, 2, 1 << 30)).alias("other"),
    ))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def first_name_line(text: Column) -> Column:
    """The first line that could be a person's name, else empty."""

    def could(x: Column) -> Column:
        letters = F.length(F.regexp_replace(x, r"[^\p{L}]", ""))
        odd = [found(x, p) for p in (V.FIND_EMAIL, V.FIND_PHONE, V.FIND_URL)] + [found(x, p, True) for p in (V.IS_EXPERIENCE, V.IS_EDUCATION, V.IS_SKILLS)]
        ok = (x != "") & (F.length(x) <= 60) & (letters >= 0.6 * F.length(x))
        for o in odd:
            ok = ok & ~o
        return ok

    return F.coalesce(F.get(F.filter(F.transform(lines(text), strip), could), 0), F.lit(""))


def sections(text: Column) -> Column:
    """Array of (name, body): the stretches between section headings, the first named _header; empty stretches left out."""

    def heading(x: Column) -> Column:
        capitals = (F.length(x) >= 3) & (x == F.upper(x)) & (x != F.lower(x)) & F.regexp_replace(x, " ", "").rlike(r"^\p{L}+$")
        return found(x, V.SECTION_HEAD, True) | capitals

    def of(raw: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(raw) - 1), lambda i: heading(strip(F.get(raw, i))))

        def cut(h: Column) -> Column:
            begins, ends = F.concat(F.array(F.lit(-1)), h), F.concat(h, F.array(F.size(raw)))
            title = lambda b: F.lower(strip(F.regexp_replace(strip(F.get(raw, b)), ":+$", "")))
            parts = F.zip_with(begins, ends, lambda b, e: F.struct(F.when(b < 0, F.lit("_header")).otherwise(title(b)).alias("name"), F.array_join(F.slice(raw, b + 2, e - b - 1), "\n").alias("body"), (e - b - 1).alias("n")))
            return F.transform(F.filter(parts, lambda p: p["n"] > 0), lambda p: F.struct(p["name"].alias("name"), p["body"].alias("body")))

        return let(heads, cut)

    return let(lines(text), of)


def section(parts: Column, pattern: str) -> Column:
    """Body of the first section whose name matches; of sections with one name the last counts. Else empty."""
    first = F.get(F.filter(parts, lambda p: found(p["name"], pattern, True)), 0)["name"]
    return F.coalesce(F.try_element_at(F.filter(parts, lambda p: p["name"] == first), F.lit(-1))["body"], F.lit(""))


def _clean_lines(body: Column) -> Column:
    kept = F.filter(F.transform(lines(body), strip), lambda x: x != "")
    return F.transform(kept, lambda x: strip(F.regexp_replace(x, rx(V.BULLET), "")))


def skill_list(body: Column) -> Column:
    def split(x: Column) -> Column:
        by = F.when(F.contains(x, F.lit("|")), F.split(x, "[|]")).when(F.contains(x, F.lit(";")), F.split(x, ";")).when(F.contains(x, F.lit(",")), F.split(x, ","))
        parts = F.filter(F.transform(by, strip), lambda s: s != "")
        return F.coalesce(parts, F.when((x != "") & (F.length(x) < 50), F.array(x)), F.array().cast("array<string>"))

    return F.filter(distinct_by(F.flatten(F.transform(_clean_lines(body), split)), F.lower), lambda s: F.length(s) < 100)


def loose_date(raw: Column) -> Column:
    """A résumé date: YYYY-MM, YYYY, present, or what stands there."""
    s = strip(raw)
    named, year = F.lower(F.regexp_extract(s, r"^([A-Za-z]+)[\s,]*(\d{4})$", 1)), F.regexp_extract(s, r"^([A-Za-z]+)[\s,]*(\d{4})$", 2)
    from kinfold.functions.normal import _lookup

    return (
        F.when(F.lower(s).isin("present", "current", "now"), F.lit("present"))
        .when(s.rlike(r"^\d{1,2}/\d{4}$"), F.concat(F.substring_index(s, "/", -1), F.lit("-"), F.lpad(F.substring_index(s, "/", 1), 2, "0")))
        .when(year != "", F.concat_ws("-", year, _lookup(V.MONTHS, named)))
        .otherwise(s)
    )


def _entry(company: Column, title: Column, start: Column, end: Column, summary: Column) -> Column:
    return F.struct(company.alias("company"), title.alias("title"), start.alias("start"), end.alias("end"), summary.alias("summary"))


EXPERIENCE = "array<struct<company:string,title:string,start:string,end:string,summary:string>>"
EDUCATION = "array<struct<institution:string,degree:string,field:string,end_year:string>>"


def experience_list(body: Column) -> Column:
    """Entries of an experience section, by a fold over its lines with the open entry as state."""
    empty = F.lit("")

    def closed(s: Column) -> Column:
        one = _entry(s["company"], s["title"], loose_date(s["start"]), loose_date(s["end"]), strip(F.array_join(s["notes"], " ")))
        return F.when((s["company"] != "") | (s["title"] != ""), F.concat(s["out"], F.array(one))).otherwise(s["out"])

    def state(company: Column, title: Column, start: Column, end: Column, notes: Column, out: Column) -> Column:
        return F.struct(company.alias("company"), title.alias("title"), start.alias("start"), end.alias("end"), notes.alias("notes"), out.alias("out"))

    def pair(x: Column) -> Column:
        """A struct title, company: `title at company`, `title | company` or `title @ company`; null if x is no pair."""
        return let(group(x, V.PAIR, 1), lambda left: F.when(left != "", F.struct(strip(left).alias("title"), strip(group(x, V.PAIR, 2)).alias("company"))))

    def read(x: Column) -> Column:
        """What one line says, looked at once: its date range, what stands before and after it, and the pair it may be."""

        def around(ranged: Column) -> Column:
            at = F.instr(x, ranged)
            before = F.regexp_replace(strip(F.substr(x, F.lit(1), at - 1)), r"[–—\-|,]+$", "")
            after = strip(F.regexp_replace(strip(F.substr(x, at + F.length(ranged))), r"^[–—\-|,]+", ""))
            dated = let(before, lambda b: F.struct(F.coalesce(pair(b), F.struct(b.alias("title"), empty.alias("company"))).alias("p"), after.alias("after"), group(ranged, V.DATE_RANGE, 1).alias("start"), group(ranged, V.DATE_RANGE, 2).alias("end")))
            return F.struct(x.alias("x"), F.when(ranged != "", dated).alias("dated"), F.when(ranged == "", pair(x)).alias("pair"))

        return let(group(x, V.DATE_RANGE, 0), around)

    def step(s: Column, line: Column) -> Column:
        x, dated, own = line["x"], line["dated"], line["pair"]
        title, company, after = dated["p"]["title"], dated["p"]["company"], dated["after"]
        opened = state(
            F.when(company == "", after).otherwise(company), F.when((company != "") & (title == ""), after).otherwise(title), dated["start"], dated["end"], F.array().cast("array<string>"), closed(s)
        )
        bare, has_date = (s["company"] == "") & (s["title"] == ""), (s["start"] != "") | (s["end"] != "")
        whole = (s["company"] != "") & (s["title"] != "")
        next_company = F.when(bare, F.when(own.isNotNull(), own["company"]).when(has_date, x).otherwise(empty)).when(s["company"] == "", x).otherwise(s["company"])
        next_title = F.when(bare, F.when(own.isNotNull(), own["title"]).when(has_date, empty).otherwise(x)).when(s["title"] == "", x).otherwise(s["title"])
        more = state(next_company, next_title, s["start"], s["end"], F.when(whole, F.concat(s["notes"], F.array(x))).otherwise(s["notes"]), s["out"])
        return F.when(dated.isNotNull(), opened).otherwise(more)

    start = state(empty, empty, empty, empty, F.array().cast("array<string>"), F.array().cast(EXPERIENCE))
    return F.aggregate(F.transform(_clean_lines(body), read), start, step, closed)


def education_list(body: Column) -> Column:
    """Entries of an education section, by a fold over its lines."""
    empty = F.lit("")
    names = ("institution", "degree", "field", "end_year")

    def state(values: list[Column], out: Column) -> Column:
        return F.struct(*[v.alias(n) for n, v in zip(names, values, strict=True)], out.alias("out"))

    def closed(s: Column) -> Column:
        one = F.struct(*[s[n].alias(n) for n in names])
        return F.when((s["institution"] != "") | (s["degree"] != ""), F.concat(s["out"], F.array(one))).otherwise(s["out"])

    def step(s: Column, x: Column) -> Column:
        year, degree = group(x, r"\b((?:19|20)\d{2})\b", 1), group(x, V.DEGREE, 0)
        at = F.instr(x, degree)
        rest = F.regexp_replace(strip(F.substr(x, at + F.length(degree))), r"(?i)^(?:in|of|,)\s+", "")
        prefix = F.regexp_replace(strip(F.substr(x, F.lit(1), at - 1)), r"[,\- ]+$", "")
        open_ = (s["institution"] != "") | (s["degree"] != "")
        kept = lambda n: F.when(open_, empty).otherwise(s[n])
        fresh = state([first_of(prefix, kept("institution")), degree, first_of(rest, kept("field")), first_of(year, kept("end_year"))], closed(s))
        more = state([
            F.when(s["institution"] == "", x).otherwise(s["institution"]), s["degree"],
            F.when((s["institution"] != "") & (s["degree"] == "") & (s["field"] == ""), x).otherwise(s["field"]), first_of(s["end_year"], year),
        ], s["out"])
        return F.when(degree != "", fresh).otherwise(more)

    start = state([empty] * 4, F.array().cast(EDUCATION))
    return F.aggregate(F.filter(_clean_lines(body), lambda x: x != ""), start, step, closed)


def resume_place(text: Column) -> Column:
    head = F.array_join(F.slice(lines(text), 1, 10), "\n")
    short, long = V.RESUME_PLACES
    at = lambda p, i: group(head, p, i, False)
    return F.when(at(short, 1) != "", F.struct(at(short, 1).alias("city"), at(short, 2).alias("region"), F.lit("").alias("country"))).when(
        at(long, 1) != "", F.struct(at(long, 1).alias("city"), at(long, 2).alias("region"), at(long, 3).alias("country"))
    )


def blocks(text: Column) -> Column:
    """Notes cut into one block per person: at rules, else at headings, else whole."""

    def parts(pattern: str, any_case: bool) -> Column:
        return F.filter(F.transform(F.split(text, rx(pattern, any_case)), strip), lambda b: b != "")

    return let(parts(V.NOTE_RULE, False), lambda a: F.when(F.size(a) > 1, a).otherwise(parts(V.NOTE_HEAD, True)))


def note_name(t: Column) -> Column:
    def fit(x: Column) -> Column:
        n = F.size(F.filter(F.split(x, r"(?U)\s+"), lambda w: w != ""))
        plain = F.length(F.regexp_replace(x, r"(?U)[^\p{L}\s]", ""))
        return n.between(1, 5) & (plain > 0.8 * F.length(x))

    return F.coalesce(*[let(trimmed(group(t, p, 1)), lambda x: F.when(fit(x), x)) for p in V.NOTE_NAME], F.lit(""))


def note_companies(t: Column) -> Column:
    each = F.transform(F.flatten(F.array(*[find_all(t, p, 1, True) for p in V.NOTE_COMPANY])), trimmed)
    return distinct_by(F.filter(each, lambda c: (c != "") & (F.length(c) <= 80)), F.lower)


def note_skills(t: Column) -> Column:
    def split(raw: Column) -> Column:
        x = trimmed(raw)
        by = F.when(F.contains(x, F.lit(" and ")), F.split(x, " and "))
        for sep in (",", ";", "|"):
            by = by.when(F.contains(x, F.lit(sep)), F.split(x, f"[{sep}]"))
        return by.otherwise(F.array(x))

    each = F.transform(F.flatten(F.transform(F.flatten(F.array(*[find_all(t, p, 1, True) for p in V.NOTE_SKILLS])), split)), trimmed)
    return distinct_by(F.filter(each, lambda s: (s != "") & (F.length(s) <= 60)), F.lower)


def note_years(t: Column) -> Column:
    return F.coalesce(*[group(t, p, 1).try_cast("double") for p in V.NOTE_YEARS])


def note_place(t: Column) -> Column:
    return F.coalesce(*[place(trimmed(group(t, p, 1))) for p in V.NOTE_PLACE])


def note_title(t: Column) -> Column:
    return first_of(*[let(trimmed(group(t, p, 1)), lambda x: F.when(F.length(x) < 80, x).otherwise(F.lit(""))) for p in V.NOTE_TITLE])
