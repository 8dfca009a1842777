"""Whole runs over the small files in tests/data."""

import hashlib
import json
import os
from datetime import datetime

from kinfold.plans.pipeline import public, run, to_document
from kinfold.plans.project import ProjectionConfig

HERE = os.path.join(os.path.dirname(os.path.abspath(__file__)), "data")
SOURCES = {"recruiter_csv": "people.csv", "ats_json": "export.json", "linkedin": "profile.json", "github": "code.json", "recruiter_notes": "notes.txt"}
SOURCES = {k: os.path.join(HERE, v) for k, v in SOURCES.items()}


def test_default_document(spark):
    got = public(to_document(run(spark, SOURCES, as_of=datetime(2026, 1, 1))))
    with open(os.path.join(HERE, "expected.json"), encoding="utf-8") as f:
        want = json.load(f)
    assert got["count"] == want["count"] == 2
    for g, w in zip(got["candidates"], want["candidates"], strict=True):
        assert set(g) == set(w)
        for k in w:
            assert g[k] == w[k], k


def test_document_by_hand(spark):
    """What the rules say about the first person, worked out by hand."""
    p = public(to_document(run(spark, SOURCES, as_of=datetime(2026, 1, 1))))["candidates"][0]
    mails = ["maria.keller@mail.example", "mk@home.example", "mkeller@code.example"]
    assert p["full_name"] == "Maria Keller" and p["emails"] == mails and p["phones"] == ["+15552013344"]
    assert p["candidate_id"] == hashlib.sha256("|".join([*mails, "maria keller"]).encode()).hexdigest()[:16]
    assert p["location"] == {"city": "Bern", "region": "BE", "country": "CH"} and p["years_experience"] == 8.0
    assert {s["name"]: s["confidence"] for s in p["skills"]} == {"Amazon Web Services": 0.8, "Dbt Well": 0.4, "Docker": 0.715, "Kubernetes": 0.65, "PostgreSQL": 0.8, "Python": 0.96, "Rust": 0.55}
    assert [(e["company"], e["start"], e["end"]) for e in p["experience"]] == [("Northwind Labs", "2020-03", "present"), ("Blue Fern", "2016-09", "2020-02")]
    # .20*.9 + .15*.99 + .10*.9 + .10*.8 + .15*.9 + .15*.9 + .10*.9 + .05*.9
    assert p["overall_confidence"] == 0.9035


def test_chosen_fields(spark):
    config = ProjectionConfig.from_file(os.path.join(HERE, "fields.json"))
    doc = public(to_document(run(spark, SOURCES, config), config))
    assert doc["candidates"][1] == {"full_name": "Tom O'Hara", "mail": "tom@harbor.example", "tel": "+15553309911", "skills": ["Credit Scoring", "SQL"]}


def test_no_records(spark):
    doc = to_document(run(spark, {}))
    assert doc["_validation_errors"] and doc["candidate_id"] == ""
