import hashlib

import pytest
from people import frame, job, links, row
from pyspark.sql import functions as F

from kinfold.operators.merge import candidate_id, covered, merge_clusters, years_from_entries
from kinfold.operators.score import field_confidence, score_profiles

NOW = 2026 * 12 + 1


def merged(spark, *rows):
    return score_profiles(merge_clusters(frame(spark, list(rows)).withColumn("cluster_id", F.lit(1)), F.lit(NOW))).first()


def test_priority_and_back_fill(spark):
    p = merged(
        spark,
        row(1, "linkedin", full_name="ann LEE", headline="from profile", location=("Paris", "", "France"), years_experience=4.0, experience=[job("Acme ", "Eng", "2020-01", "", "did things")]),
        row(2, "ats_json", full_name=" ", headline=" Lead ", location=("Lyon", "", ""), years_experience=-1.0, experience=[job("acme", "ENG", "2020-01", "March 2021", "")]),
    )
    assert (p.full_name, p.headline, p.years_experience) == ("Ann Lee", "Lead", 4.0)
    assert tuple(p.location) == ("Lyon", "", "")  # the whole place of the first record that has any
    assert [tuple(e) for e in p.experience] == [("acme", "ENG", "2020-01", "2021-03", "did things")]
    assert [(x.field, x.source) for x in p.provenance] == [("full_name", "linkedin"), ("location", "ats_json"), ("headline", "ats_json"), ("experience", "ats_json"), ("years_experience", "linkedin")]


def test_unions_are_sorted_and_credited_once(spark):
    p = merged(spark, row(1, "github", emails=["B@x.org", "a@x.org"]), row(2, emails=["b@x.org", "bad"], phones=["555-123-4567", "(555) 123 4567"]))
    assert p.emails == ["a@x.org", "b@x.org"] and p.phones == ["+15551234567"]
    assert [(x.source, x.normalized_value) for x in p.provenance if x.field == "emails"] == [("recruiter_csv", "b@x.org"), ("github", "a@x.org")]
    assert float(p.field_confidence.emails) == 0.99 and float(p.field_confidence.phones) == 0.9


def test_skills_by_best_source_and_corroboration(spark):
    p = merged(spark, row(1, "ats_json", skills=["AWS", "aws"]), row(2, "linkedin", skills=["Amazon Web Services", "JS"]), row(3, "recruiter_notes", skills=["aws"]))
    assert [(s.name, float(s.confidence), s.sources) for s in p.skills] == [("Amazon Web Services", 0.96, ["ats_json", "linkedin", "recruiter_notes"]), ("JavaScript", 0.65, ["linkedin"])]


def test_links_first_wins_per_kind(spark):
    p = merged(spark, row(1, "github", links=links("", "github.com/a", "a.org", ["http://o.org/", "o2.org"])), row(2, links=links("linkedin.com/in/a/", "", "", ["http://o.org"])))
    assert (p.links.linkedin, p.links.github, p.links.portfolio, p.links.other) == ("https://linkedin.com/in/a", "https://github.com/a", "https://a.org", ["http://o.org", "https://o2.org"])
    assert merged(spark, row(1)).links is None


def test_entries_latest_first_ties_by_key(spark):
    p = merged(spark, row(1, education=[("MIT", "Bachelor of Science", "", "2018"), ("Massachusetts Institute of Technology", "BS", "", "2018"), ("X", "", "", "2020")]))
    assert [e.institution for e in p.education] == ["X", "Massachusetts Institute of Technology", "MIT"]


@pytest.mark.parametrize("entries,want", [([], None), ([("2020-01", "2021-01"), ("2020-06", "2021-07")], 1.5), ([("2020-01", "2020-07"), ("2021-01", "2021-04")], 0.8), ([("2025-01", "present")], 1.0), ([("2025-10", "")], 0.2), ([("2021-01", "2020-01")], None), ([("x", "2020-01")], None)])
def test_years_of_intervals(spark, entries, want):
    df = spark.createDataFrame([([job("a", "b", s, e) for s, e in entries],)], "e array<struct<company:string,title:string,start:string,end:string,summary:string>>")
    assert df.select(years_from_entries(F.col("e"), F.lit(NOW))).first()[0] == want


def test_covered(spark):
    rows = [(1, [(1, 5), (4, 8), (8, 9), (20, 21), (30, 29), (40, None)]), (2, [(3, 3)]), (3, []), (4, [(9, 1)]), (5, [(1, 10), (2, 3), (12, 13)])]
    df = spark.createDataFrame(rows, "k int, r array<struct<a:int,b:int>>")
    assert {r.k: r.n for r in df.select("k", covered(F.col("r")).alias("n")).collect()} == {1: 9, 2: 0, 3: None, 4: None, 5: 10}


def test_two_scans_and_few_exchanges(spark, tmp_path):
    df = frame(spark, [row(1), row(2)]).withColumn("cluster_id", F.lit(1))
    df.write.parquet(str(tmp_path / "r"))
    plan = merge_clusters(spark.read.parquet(str(tmp_path / "r")), F.lit(NOW))._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Scan parquet") == 2 and plan.count("Exchange hashpartitioning") <= 4


def test_confidence(spark):
    df = spark.createDataFrame([("recruiter_csv", 1, 0.9), ("recruiter_csv", 2, 0.99), ("recruiter_csv", 9, 1.0), ("ats_json", 0, 0.8), ("unknown", 1, 0.5), ("linkedin", 2, 0.715)], "s string, n int, want double")
    assert [float(r.x) for r in df.select(field_confidence(F.col("s"), F.col("n")).alias("x")).collect()] == [r.want for r in df.collect()]
    empty = merged(spark, row(1))
    assert float(empty.overall_confidence) == 0.0 and empty.provenance == []


def test_candidate_id(spark):
    df = spark.createDataFrame([(["b@x.org", "a@x.org", "b@x.org"], "Ann Lee"), ([], "")], "e array<string>, n string")
    want = [hashlib.sha256(t.encode()).hexdigest()[:16] for t in ("a@x.org|b@x.org|ann lee", "")]
    assert [r.x for r in df.select(candidate_id(F.col("e"), F.col("n")).alias("x")).collect()] == want
