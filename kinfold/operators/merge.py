"""Merging the records of a cluster: source-priority choice, unions, keyed dedup, intervals, lineage.

Every operator takes records with cluster_id and gives one row per cluster. A merge reads the records twice: one
aggregation chooses scalars and links (`min_by` over an order struct), one gathers all that a cluster has several of
(`gathered`): items of every kind in one long form, first grouped by (cluster, kind, key), then by cluster. Both combine before the shuffle,
and no cluster's records are gathered; only its distinct values are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions import normal as N
from kinfold.operators.score import field_confidence



def order() -> Column:
    """Merge order: higher priority first, then file name, then order in the file."""
    return F.struct((-F.col("priority")).alias("p"), F.col("source_file").alias("f"), F.col("at").alias("a"))


def first_by_priority(value: Column, when: Column) -> Column:
    """Aggregate: `value` of the first record in merge order that meets `when`; null if none does."""
    return F.min_by(value, F.when(when, order()))


def _scalars() -> dict[str, Column]:
    """Aggregates name, headline, location, years, top (source) and position: each choice a struct with its source, or null."""
    name = N.name(F.col("full_name"))
    head = N.strip(F.col("headline"))
    loc = F.col("location")
    some = F.coalesce((loc["city"] != "") | (loc["region"] != "") | (loc["country"] != ""), F.lit(False))
    place = F.struct(N.strip(loc["city"]).alias("city"), N.strip(loc["region"]).alias("region"), N.country(loc["country"]).alias("country"))
    years = F.col("years_experience")
    ok = F.coalesce((years >= 0) & ~F.isnan(years), F.lit(False))
    src = F.col("source").alias("source")
    return {
        "name": first_by_priority(F.struct(src, name.alias("value"), F.col("full_name").alias("raw")), name != ""),
        "headline": first_by_priority(F.struct(src, head.alias("value")), head != ""),
        "location": first_by_priority(F.struct(src, place.alias("value"), loc.alias("raw")), some),
        "years": first_by_priority(F.struct(src, years.alias("value")), ok),
        "top": F.min_by("source", order()),
        "position": F.min(F.struct("source", "at")),
    }


def _chosen_links() -> dict[str, Column]:
    """Aggregates linkedin, github and portfolio: structs of source and value, or null."""
    raw = lambda n: F.coalesce(F.col("links")[n], F.lit(""))
    return {n: first_by_priority(F.struct(F.col("source").alias("source"), N.url(raw(n)).alias("value")), N.url(raw(n)) != "") for n in ("linkedin", "github", "portfolio")}


def _chosen(records: DataFrame, *parts: dict[str, Column]) -> DataFrame:
    return records.groupBy("cluster_id").agg(*[c.alias(n) for part in parts for n, c in part.items()])


@dataclass(frozen=True)
class Kind:
    """Items that a record has several of. `items`: an array of arrays of raw strings; `key` of such an array, empty for what does not count;
    `clean`: a cleaner for each string, of which a key's first one that is not empty is kept; `done`: the output from a key's rows."""

    items: Column
    key: Callable[[Column], Column]
    clean: list[Callable[[Column], Column]]
    done: Callable[[Column], Column]


def gathered(records: DataFrame, kinds: dict[str, Kind]) -> DataFrame:
    """cluster_id and a column for each kind.

    A key's row has `first` (place of its first item in merge order), `key`, `source` of that item, `f` (cleaned strings), `sources` and `best` (the source of
    highest priority).
    """
    tag = lambda name, k: F.transform(k.items, lambda f, i: F.struct(F.lit(name).alias("kind"), i.alias("i"), F.transform(f, lambda v: F.coalesce(v, F.lit(""))).alias("f")))
    each = records.select("cluster_id", "source", "priority", order().alias("o"), F.explode(F.concat(*[F.coalesce(tag(n, k), F.array()) for n, k in kinds.items()])).alias("x"))
    by_kind = lambda of: F.coalesce(*[F.when(F.col("x.kind") == n, of(k)) for n, k in kinds.items()], F.lit(""))
    width = max(len(k.clean) for k in kinds.values())
    cleaned = [by_kind(lambda k, j=j: k.clean[j](F.get("x.f", j)) if j < len(k.clean) else F.lit("")).alias(f"f{j}") for j in range(width)]
    each = each.select("cluster_id", "source", "priority", F.struct("o", "x.i").alias("at"), "x.kind", by_kind(lambda k: k.key(F.col("x.f"))).alias("key"), *cleaned)
    firsts = [F.coalesce(F.min_by(f"f{j}", F.when(F.col(f"f{j}") != "", F.col("at"))), F.lit("")) for j in range(width)]
    row = each.groupBy("cluster_id", "kind", "key").agg(
        F.min("at").alias("first"), F.min_by("source", "at").alias("source"), F.array(*firsts).alias("f"), F.array_sort(F.collect_set("source")).alias("sources"), F.max_by("source", F.struct("priority", "source")).alias("best")
    )
    some = F.struct("first", "key", "source", "f", "sources", "best")
    lists = row.where("key <> ''").groupBy("cluster_id").agg(*[F.sort_array(F.collect_list(F.when(F.col("kind") == n, some))).alias(n) for n in kinds])
    return lists.select("cluster_id", *[k.done(F.col(n)).alias(n) for n, k in kinds.items()])


def _values(column: str, normalise: Callable[[Column], Column]) -> Kind:
    """values (sorted, distinct) and origins (source, raw, value of each value's first item, in merge order)."""
    origin = lambda r: F.struct(r["source"].alias("source"), F.get(r["f"], 0).alias("raw"), r["key"].alias("value"))
    done = lambda rows: F.struct(F.array_sort(F.transform(rows, lambda r: r["key"])).alias("values"), F.transform(rows, origin).alias("origins"))
    return Kind(F.transform(column, lambda v: F.array(v)), lambda f: normalise(F.get(f, 0)), [lambda x: x], done)


def _skills() -> Kind:
    """name, confidence by best source and number of sources, sources; sorted by name."""
    one = lambda r: F.struct(r["key"].alias("name"), field_confidence(r["best"], F.size(r["sources"])).alias("confidence"), r["sources"].alias("sources"))
    return Kind(F.transform("skills", lambda v: F.array(v)), lambda f: N.skill(F.get(f, 0)), [], lambda rows: F.array_sort(F.transform(rows, one)))


def _other_links() -> Kind:
    return Kind(F.transform(F.col("links")["other"], lambda v: F.array(v)), lambda f: N.url(F.get(f, 0)), [], lambda rows: F.array_sort(F.transform(rows, lambda r: r["key"])))


def _entries(column: str, key_fields: tuple[str, str, str], fields: dict[str, Callable[[Column], Column]], sort_field: str) -> Kind:
    """Nested entries deduplicated by key, empty fields filled from later records; latest first. The key is the MD5 of two lower-cased fields and a third as written."""
    names = list(fields)
    at = lambda f, n: F.get(f, names.index(n))
    a, b, c = key_fields
    key = lambda f: F.md5(F.concat_ws("|", F.lower(N.strip(at(f, a))), F.lower(N.strip(at(f, b))), at(f, c)))
    by = lambda r: F.get(r["f"], names.index(sort_field))
    later = lambda p, q: F.when(by(p) > by(q), -1).when(by(p) < by(q), 1).when(p["key"] < q["key"], -1).when(p["key"] > q["key"], 1).otherwise(0)
    entry = lambda r: F.struct(*[F.get(r["f"], j).alias(n) for j, n in enumerate(names)])
    return Kind(F.transform(column, lambda e: F.array(*[e[n] for n in names])), key, list(fields.values()), lambda rows: F.transform(F.array_sort(rows, later), entry))


def _all_kinds() -> dict[str, Kind]:
    job = {"company": N.strip, "title": N.strip, "start": N.date, "end": N.date, "summary": N.strip}
    study = {"institution": N.strip, "degree": N.strip, "field": N.strip, "end_year": N.strip}
    return {
        "emails": _values("emails", N.email),
        "phones": _values("phones", N.phone),
        "skills": _skills(),
        "other": _other_links(),
        "experience": _entries("experience", ("company", "title", "start"), job, "start"),
        "education": _entries("education", ("institution", "degree", "end_year"), study, "end_year"),
    }


def scalars(records: DataFrame) -> DataFrame:
    """cluster_id with the choices of `_scalars`."""
    return _chosen(records, _scalars())


def links(records: DataFrame) -> DataFrame:
    """cluster_id, linkedin, github, portfolio (structs of source and value, or null), other."""
    out = _chosen(records, _chosen_links()).join(gathered(records, {"other": _other_links()}), "cluster_id", "left")
    return out.withColumn("other", F.coalesce("other", F.array().cast("array<string>")))


def collected(records: DataFrame, *kinds: str) -> DataFrame:
    """cluster_id and the chosen kinds of `_all_kinds`, for clusters that have any of them."""
    known = _all_kinds()
    return gathered(records, {k: known[k] for k in kinds})


def months(date: Column) -> Column:
    """Months since year 0 of YYYY-MM, else null."""
    return F.when(date.rlike(r"^\d{4}-\d{2}$"), F.substring(date, 1, 4).cast("int") * 12 + F.substring(date, 6, 2).cast("int"))


def covered(ranges: Column) -> Column:
    """Length of the union of closed ranges, an array of structs a, b of whole numbers: a running maximum of ends over ranges in order. Null without any.

    Ranges that end before they start, or lack an end, are ignored.
    """

    def of(r: Column) -> Column:
        zero = F.struct(F.lit(None).cast("long").alias("reach"), F.lit(0).cast("long").alias("total"))
        more = lambda s, x: F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], s["reach"])).cast("long")
        fold = F.aggregate(r, zero, lambda s, x: F.struct(F.greatest(s["reach"], x["b"]).cast("long").alias("reach"), (s["total"] + more(s, x)).alias("total")))
        return F.when(F.size(r) > 0, fold["total"])

    return N.let(F.array_sort(F.filter(ranges, lambda x: F.coalesce(x["b"] >= x["a"], F.lit(False)))), of)


def years_from_entries(entries: Column, now: Column) -> Column:
    """Years covered by an array of entries (start, end), to one decimal, half to even; null without a dated entry. An open end is `now` (months)."""

    ranges = F.transform(entries, lambda e: F.struct(months(e["start"]).alias("a"), F.when(e["end"].isin("", "present"), now).otherwise(months(e["end"])).alias("b")))
    return F.bround(covered(ranges) / F.lit(12.0), 1)


def candidate_id(emails: Column, name: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the sorted e-mails and the name in lower case."""
    return F.substring(F.sha2(F.array_join(F.array_append(F.array_sort(F.array_distinct(emails)), F.lower(name)), "|"), 256), 1, 16)


def _shown(x: Column) -> Column:
    """A string as quoted text in the lineage."""
    s = F.regexp_replace(x, r"\\", r"\\\\\\\\")
    return F.when(F.contains(x, F.lit("'")) & ~F.contains(x, F.lit('"')), F.concat(F.lit('"'), s, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.regexp_replace(s, "'", r"\\\\'"), F.lit("'")))


def _shown_list(a: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(a, _shown), ", "), F.lit("]"))


def _shown_place(p: Column) -> Column:
    return F.concat(F.lit("{'city': "), _shown(p["city"]), F.lit(", 'region': "), _shown(p["region"]), F.lit(", 'country': "), _shown(p["country"]), F.lit("}"))


def _origin(source: Column, field: str, raw: Column, value: Column, steps: Column) -> Column:
    return F.struct(source.alias("source"), F.lit(field).alias("field"), raw.alias("original_value"), value.alias("normalized_value"), steps.alias("normalizations_applied"))


def _steps(*names: str) -> Column:
    return F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")


def merge_clusters(records: DataFrame, now: Column) -> DataFrame:
    """One profile per cluster, lineage included. `now`: months since year 0, the end of open engagements."""
    strings = F.array().cast("array<string>")
    all_ = _chosen(records, _scalars(), _chosen_links()).join(gathered(records, _all_kinds()), "cluster_id", "left")
    all_ = all_.withColumns({f"{k[:-1]}_origins": F.col(k)["origins"] for k in ("emails", "phones")}).withColumns({k: F.col(k)["values"] for k in ("emails", "phones")})
    all_ = all_.withColumns({c: F.coalesce(c, F.array().cast(all_.schema[c].dataType)) for c in ("emails", "phones", "email_origins", "phone_origins", "skills", "experience", "education", "other")})
    full_name = F.coalesce(F.col("name.value"), F.lit(""))
    computed = years_from_entries(F.col("experience"), now)
    names = lambda c, f: F.transform(c, lambda e: e[f])
    some = lambda test, one: F.when(test, F.array(one)).otherwise(F.array())
    collection = lambda field, items, *steps: some(F.size(items) > 0, _origin(F.col("top"), field, _shown_list(items), _shown_list(items), _steps(*steps)))
    link = lambda n: some(F.col(n).isNotNull(), _origin(F.col(f"{n}.source"), "links", F.lit(f"{{'type': '{n}'}}"), F.col(f"{n}.value"), _steps("normalize_url")))
    text = lambda y: F.when(y == F.floor(y), F.concat(F.floor(y).cast("string"), F.lit(".0"))).otherwise(y.cast("string"))
    given = F.col("years.value")
    lineage = F.concat(
        some(F.col("name").isNotNull(), _origin(F.col("name.source"), "full_name", F.col("name.raw"), F.col("name.value"), _steps("normalize_name"))),
        F.transform("email_origins", lambda v: _origin(v["source"], "emails", v["raw"], v["value"], _steps("normalize_email"))),
        F.transform("phone_origins", lambda v: _origin(v["source"], "phones", v["raw"], v["value"], _steps("normalize_phone", "E.164"))),
        some(F.col("location").isNotNull(), _origin(F.col("location.source"), "location", _shown_place(F.col("location.raw")), _shown_place(F.col("location.value")), F.when(F.col("location.raw.country") != "", _steps("normalize_country")).otherwise(strings))),
        link("linkedin"), link("github"), link("portfolio"),
        some(F.col("headline").isNotNull(), _origin(F.col("headline.source"), "headline", F.col("headline.value"), F.col("headline.value"), _steps())),
        collection("experience", names("experience", "company"), "normalize_date", "deduplicate"),
        collection("education", names("education", "institution"), "deduplicate"),
        collection("skills", names("skills", "name"), "normalize_skill", "union", "confidence"),
        F.when(given.isNotNull(), F.array(_origin(F.col("years.source"), "years_experience", text(given), text(given), _steps())))
        .when(computed.isNotNull(), F.array(_origin(F.lit("ats_json"), "years_experience", F.lit(None).cast("string"), text(computed), _steps("computed_from_experience"))))
        .otherwise(F.array()),
    )
    any_link = F.col("linkedin").isNotNull() | F.col("github").isNotNull() | F.col("portfolio").isNotNull() | (F.size("other") > 0)
    at = lambda n: F.coalesce(F.col(f"{n}.value"), F.lit("")).alias(n)
    return all_.select(
        "cluster_id", "position", candidate_id(F.col("emails"), full_name).alias("candidate_id"), full_name.alias("full_name"), "emails", "phones", F.col("location.value").alias("location"),
        F.when(any_link, F.struct(at("linkedin"), at("github"), at("portfolio"), "other")).alias("links"), F.coalesce(F.col("headline.value"), F.lit("")).alias("headline"),
        F.coalesce(given, computed).alias("years_experience"), "skills", "experience", "education", lineage.alias("provenance"),
    )
