"""The whole flow: load, resolve, merge, score, project, validate; and documents for callers that want JSON."""

from __future__ import annotations

import copy
import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.operators.merge import merge_clusters
from kinfold.operators.resolve import assign_clusters
from kinfold.operators.score import score_profiles
from kinfold.plans.project import ProjectionConfig, documents, project, validation_errors
from kinfold.plans.schema import schema_errors
from kinfold.session import materialise
from kinfold.sources.records import load


def profiles(records: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """One scored profile per person. `as_of`: the date at which open engagements end (default: now)."""
    at = as_of or datetime.now(timezone.utc)
    clustered = materialise(assign_clusters(records))  # read by two aggregations
    return score_profiles(merge_clusters(clustered, F.lit(at.year * 12 + at.month)))


def run(spark: SparkSession, sources: dict[str, str | list[str]], config: ProjectionConfig | None = None, as_of: datetime | None = None, schema: dict | None = None) -> DataFrame:
    """Projected profiles with position (their order), _sources, _overall_confidence and _validation_errors (null if valid).

    Default documents are validated by the profile schema, chosen fields only by a `schema` (JSON Schema, draft 7) of the caller.
    """
    config = config or ProjectionConfig()
    found = profiles(materialise(load(spark, sources)), as_of)
    own = found.withColumns({"_sources": F.array_sort(F.array_distinct(F.transform("provenance", lambda p: p["source"]))), "_overall_confidence": F.col("overall_confidence")})
    keep = ["position", "_sources", "_overall_confidence"]
    out = project(own, config, *keep)
    if schema is not None:
        errors = schema_errors(F.to_json(F.struct(*[F.col(f"`{c}`") for c in out.columns if c not in keep]), {"ignoreNullFields": "false"}), schema)
    else:
        errors = validation_errors(out) if not config.fields else F.lit(None).cast("array<string>")
    return out.withColumn("_validation_errors", F.when(F.size(errors) > 0, errors))


#: The document without records, and what it says. Fixed values.
EMPTY = {
    "candidate_id": "", "full_name": "", "emails": [], "phones": [], "location": {"city": "", "region": "", "country": ""},
    "links": {"linkedin": "", "github": "", "portfolio": "", "other": []}, "headline": "", "years_experience": None, "skills": [], "experience": [], "education": [],
}
EMPTY_ERRORS = ["No records loaded — empty result."]


def empty_document(config: ProjectionConfig) -> dict:
    out = copy.deepcopy(EMPTY)
    if config.include_provenance:
        out["provenance"] = []
    if config.include_confidence:
        out["overall_confidence"] = 0.0
    return out | {"_validation_errors": list(EMPTY_ERRORS)}


def to_document(df: DataFrame, config: ProjectionConfig | None = None) -> dict:
    """All rows of `run` as one document: the profile itself if there is one, else candidates and count.

    This brings every profile to the driver: it is for small results. Write `documents(...)` for large ones.
    """
    config = config or ProjectionConfig()
    private = ["position", "_sources", "_overall_confidence", "_validation_errors"]
    rows = documents(df, config, *private).orderBy("position").collect()
    found = []
    for r in rows:
        one = json.loads(r["document"]) | {"_sources": r["_sources"], "_overall_confidence": float(r["_overall_confidence"])}
        found.append(one | ({"_validation_errors": r["_validation_errors"]} if r["_validation_errors"] else {}))
    if not found:
        return empty_document(config)
    return found[0] if len(found) == 1 else {"candidates": found, "count": len(found)}


def public(document: dict) -> dict:
    """A document without its private keys."""
    strip = lambda d: {k: v for k, v in d.items() if not k.startswith("_")}
    return {"candidates": [strip(c) for c in document["candidates"]], "count": document["count"]} if "candidates" in document else strip(document)
