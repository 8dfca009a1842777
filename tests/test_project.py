import json

import pytest
from people import frame, links, row
from pyspark.sql import functions as F

from kinfold.operators.merge import merge_clusters
from kinfold.operators.score import score_profiles
from kinfold.plans.project import ProjectionConfig, documents, project, validation_errors


@pytest.fixture(scope="module")
def profiles(spark):
    rows = [row(1, full_name="Ann Lee", emails=["b@x.org", "a@x.org"], phones=["5551234567"], headline="Lead", skills=["js", "Go"], links=links(github="github.com/a"), location=("Paris", "", "FR"))]
    return score_profiles(merge_clusters(frame(spark, rows).withColumn("cluster_id", F.lit(1)), F.lit(24313))).cache()


def run(profiles, **config):
    c = ProjectionConfig.from_dict({"include_confidence": False, "include_provenance": False} | config)
    return json.loads(documents(project(profiles, c), c).first()[0])


PATHS = [
    ("full_name", None, "Ann Lee"), ("emails[0]", None, "a@x.org"), ("emails[9]", None, None), ("skills[].name", None, ["Go", "JavaScript"]), ("skills[].nope", None, [None, None]), ("full_name[].x", None, None),
    ("location.city", None, "Paris"), ("location.nope", None, None), ("nope", None, None), ("a.b.c", None, None), ("emails[0]", "uppercase", "A@X.ORG"), ("headline", "e164", "Lead"), ("links.github", "url", "https://github.com/a"), ("emails", "UPPERCASE", ["A@X.ORG", "B@X.ORG"]), ("headline", "unknown", "Lead"),
]


@pytest.mark.parametrize("path,normalize,want", PATHS)
def test_paths(profiles, path, normalize, want):
    assert run(profiles, fields=[{"path": "x", "from": path, "normalize": normalize}]) == {"x": want}


def test_missing_policies(profiles):
    fields = [{"path": "full_name"}, {"path": "y", "from": "emails[5]"}]
    assert run(profiles, fields=fields, on_missing="null") == {"full_name": "Ann Lee", "y": None}
    assert run(profiles, fields=fields, on_missing="omit") == {"full_name": "Ann Lee"}
    with pytest.raises(Exception, match="missing value for field 'y'"):
        run(profiles, fields=fields, on_missing="error")
    with pytest.raises(ValueError):
        ProjectionConfig.from_dict({"on_missing": "other"})


def test_rename_and_toggles(profiles):
    out = run(profiles, rename={"full_name": "name"})
    assert list(out)[-1] == "name" and "full_name" not in out and "provenance" not in out and "overall_confidence" not in out
    full = run(profiles, include_confidence=True, include_provenance=True)
    assert set(full) >= {"provenance", "overall_confidence", "field_confidence"} and full["location"] == {"city": "Paris", "region": "", "country": "FR"}
    assert run(profiles, fields=["full_name"], rename={"full_name": "n"}, include_confidence=True)["n"] == "Ann Lee"


def test_validation(profiles):
    c = ProjectionConfig()
    out = project(profiles, c)
    errors = lambda df: df.select(validation_errors(df)).first()[0]
    assert errors(out) == []
    assert errors(out.withColumn("candidate_id", F.lit(""))) == ["Value at 'candidate_id' is too short (minimum length: 1)"]
    assert errors(out.withColumn("overall_confidence", F.lit(1.5)))[0].startswith("Value at 'overall_confidence': 1.5 is greater")
    assert errors(out.withColumn("years_experience", F.lit(-1.0))) != [] and errors(out.drop("phones")) == ["Missing required field at '$': 'phones' is a required property"]
