"""Readers of the canonical layout: files whose columns or keys are the record's own field names.

Lists in delimited files are split at semicolons; a row holds at most one engagement and one study.
Every row is a record, identified or not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import normal as N
from kinfold.sources import records as S


def _links(linkedin: Column, github: Column, portfolio: Column, other: Column) -> Column:
    x = F.struct(linkedin.alias("linkedin"), github.alias("github"), portfolio.alias("portfolio"), other.alias("other"))
    return N.let(x, lambda v: F.when((v["linkedin"] != "") | (v["github"] != "") | (v["portfolio"] != "") | (F.size(v["other"]) > 0), v))


def _place(city: Column, region: Column, country: Column) -> Column:
    return F.when((city != "") | (region != "") | (country != ""), F.struct(city.alias("city"), region.alias("region"), country.alias("country")))


def read_canonical_csv(spark: SparkSession, path: str, source: str = "recruiter_csv") -> DataFrame:
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False)
    rows = rows.withColumns({"source_file": F.lit(path), "line": F.monotonically_increasing_id()})
    get = lambda c: N.strip(F.col(f"`{c}`")) if c in rows.columns else F.lit("")
    many = lambda c: N.listed(get(c), (";",))
    job = F.struct(*[get(c).alias(c) for c in ("company", "title", "start", "end", "summary")])
    study = F.struct(get("institution").alias("institution"), get("degree").alias("degree"), get("field_of_study").alias("field"), get("end_year").alias("end_year"))
    none = F.array().cast("array<string>")
    return S.as_records(
        rows, source, ["line"], full_name=get("full_name"), emails=many("email"), phones=many("phone"), location=_place(get("city"), get("region"), get("country")),
        links=_links(get("linkedin"), get("github"), get("portfolio"), none), headline=get("headline"), years_experience=N.number(get("years_experience")), current_company=get("company"), skills=many("skills"),
        experience=F.when((get("company") != "") | (get("title") != ""), F.array(job)).otherwise(F.array()), education=F.when((get("institution") != "") | (get("degree") != ""), F.array(study)).otherwise(F.array()),
    )


def read_canonical_json(spark: SparkSession, path: str, source: str = "ats_json") -> DataFrame:
    """An object, an array of objects, or an object with the array under `candidates`."""
    body = N.strip(F.col("body"))
    inner = F.coalesce(F.get_json_object(body, "$.candidates"), body)
    rows = S.whole_files(spark, [path]).select("source_file", F.posexplode(S._objects(inner)).alias("line", "m"))
    get = lambda k: F.try_element_at("m", F.lit(k))
    part = lambda k, f: N.strip(F.get_json_object(get(k), f"$.{f}"))
    several = lambda k, one: F.coalesce(F.filter(F.transform(S._items(F.coalesce(get(k), get(one))), N.strip), lambda x: x != ""), S._one(F.coalesce(get(k), get(one))))
    skills = F.coalesce(F.filter(F.transform(S._items(get("skills")), N.strip), lambda x: x != ""), N.listed(get("skills"), (";",)))
    other = F.coalesce(F.filter(S._items(F.get_json_object(get("links"), "$.other")), lambda x: N.strip(x) != ""), F.array().cast("array<string>"))
    same = lambda fields: {f: [f] for f in fields}
    return S.as_records(
        rows, source, ["line"], full_name=N.strip(get("full_name")), emails=several("emails", "email"), phones=several("phones", "phone"), location=_place(part("location", "city"), part("location", "region"), part("location", "country")),
        links=_links(part("links", "linkedin"), part("links", "github"), part("links", "portfolio"), other), headline=N.strip(get("headline")), years_experience=N.number(get("years_experience")), current_company=N.strip(get("current_company")),
        skills=skills, experience=S._entries(get("experience"), same(("company", "title", "start", "end", "summary")), S._fall), education=S._entries(get("education"), same(("institution", "degree", "field", "end_year")), S._fall),
    )
