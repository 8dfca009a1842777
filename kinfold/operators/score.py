"""Confidence: by source and corroboration for a field, weighted over fields for a profile. Exact decimals, half up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions import values as V


def base_confidence(source: Column) -> Column:
    out = F.lit("0.50")
    for name, (_, base) in V.SOURCES.items():
        out = F.when(source == name, F.lit(base)).otherwise(out)
    return out.cast("decimal(5,4)")


def field_confidence(source: Column, n: Column) -> Column:
    """Base confidence, a tenth of it more for each further source, at most 1."""
    more = (F.greatest(n, F.lit(1)) - 1).cast("decimal(10,0)") * F.lit("0.1").cast("decimal(2,1)")
    return F.least(F.lit(1).cast("decimal(5,4)"), F.round(base_confidence(source) * (more + F.lit(1).cast("decimal(2,1)")), 4).cast("decimal(9,4)")).cast("decimal(5,4)")


def priority(source: Column) -> Column:
    out = F.lit(0)
    for name, (p, _) in V.SOURCES.items():
        out = F.when(source == name, F.lit(p)).otherwise(out)
    return out


def corroboration(provenance: Column, field: str) -> Column:
    """best and n of a field of a lineage array: its source of highest priority and its number of distinct sources."""
    sources = F.array_distinct(F.transform(F.filter(provenance, lambda p: p["field"] == field), lambda p: p["source"]))
    best = F.array_max(F.transform(sources, lambda s: F.struct(priority(s).alias("p"), s.alias("s"))))["s"]
    return F.struct(best.alias("best"), F.size(sources).alias("n"))


def score_profiles(profiles: DataFrame) -> DataFrame:
    """`profiles` with field_confidence (a struct) and overall_confidence. A value without lineage counts .5, no value 0."""
    loc = F.col("location")
    filled = {f: F.size(f) > 0 for f in ("emails", "phones", "skills", "experience", "education")}
    filled |= {f: F.trim(F.coalesce(f, F.lit(""))) != "" for f in ("full_name", "headline")}
    filled["location"] = F.coalesce((loc["city"] != "") | (loc["region"] != "") | (loc["country"] != ""), F.lit(False))

    def one(field: str) -> Column:
        by = corroboration(F.col("provenance"), field)
        some = F.when(by["n"] > 0, field_confidence(by["best"], by["n"])).otherwise(F.lit("0.5").cast("decimal(5,4)"))
        return F.when(filled[field], some).otherwise(F.lit(0).cast("decimal(5,4)"))

    scored = profiles.withColumn("field_confidence", F.struct(*[one(f).alias(f) for f in V.FIELD_WEIGHTS]))
    total = sum((F.col(f"field_confidence.{f}") * F.lit(w).cast("decimal(3,2)") for f, w in V.FIELD_WEIGHTS.items()), F.lit(0).cast("decimal(2,1)"))
    return scored.withColumn("overall_confidence", F.round(total, 4).cast("decimal(5,4)"))
