import pytest
from pyspark.sql import functions as F

from kinfold.functions import normal as N

CASES = {
    "email": [("Alice@Example.COM ", "alice@example.com"), ("alice+jobs@gmail.com", "alice+jobs@gmail.com"), ("not-an-email", ""), ("", ""), (None, ""), ("a@b", "")],
    "phone": [("+1-555-123-4567", "+15551234567"), ("(555) 123-4567", "+15551234567"), ("+44 20 7946 0958", "+442079460958"), ("+49 151 12345678", "+4915112345678"), ("5551234567", "+15551234567"), ("1 555 123 4567", "+15551234567"), ("12345", ""), ("abc", ""), ("", ""), (None, ""), ("555-123-4567 ext 89", "+15551234567"), ("+999 123 456 789", ""), ("+1 555 123", ""), ("011 44 20 7946 0958", "+442079460958"), ("+33 1 42 68 53 00", "+33142685300"), ("+33 1 42", ""), ("+210 1234567", "")],
    "country": [("US", "US"), ("USA", "US"), ("u.k.", "GB"), ("United States", "US"), ("Germany", "DE"), ("DEU", "DE"), ("Neverland", ""), ("", ""), (None, ""), ("us", "US"), ("Czech Republic", "CZ"), ("Republic of Korea", "KR"), ("Federal Republic of Germany", "DE"), ("the Kingdom of Norway", "NO"), ("Viet Nam", "VN"), ("United Arab Emirates", "AE"), ("Republic of Nowhere", "")],
    "date": [("2021-03", "2021-03"), ("March 2021", "2021-03"), ("Mar 2021", "2021-03"), ("03/2021", "2021-03"), ("2021-03-15", "2021-03"), ("3-2021", "2021-03"), ("2021/3/5", "2021-03"), ("2021 sept", "2021-09"), ("PRESENT", "present"), ("Current", "present"), ("2021", "2021-01"), ("1899", ""), ("2021-13", ""), ("not-a-date", ""), ("", ""), (None, ""), ("2021-03-15T10:00", "2021-03")],
    "skill": [("JS", "JavaScript"), ("python3", "Python"), (" k8s ", "Kubernetes"), ("data analysis", "Data Analysis"), ("JIRA", "JIRA"), ("SCRUMMASTER", "Scrummaster"), ("ml", "Machine Learning"), ("", ""), (None, "")],
    "name": [("alice JOHNSON", "Alice Johnson"), ("  alice   johnson ", "Alice Johnson"), ("o'connor", "O'Connor"), ("mcdonald", "McDonald"), ("macarthur", "MacArthur"), ("macy", "MacY"), ("Ludwig VAN Beethoven", "Ludwig van Beethoven"), ("", ""), (None, "")],
    "url": [("linkedin.com/in/alice/", "https://linkedin.com/in/alice"), ("HTTP://Example.com/A/b/?q=1#top", "http://example.com/A/b?q=1"), ("https://x.org", "https://x.org"), ("", ""), (None, ""), ("https://", "")],
}


@pytest.mark.parametrize("kind", CASES)
def test_normaliser(spark, kind):
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(CASES[kind])], "i int, a string, b string")
    f = getattr(N, kind)
    got = {r.i: (r.a, r.x, r.b) for r in rows.withColumn("x", f(F.col("a"))).collect()}
    assert [v for v in got.values() if v[1] != v[2]] == []


@pytest.mark.parametrize("kind", ["email", "phone", "date", "skill", "name", "url"])
def test_idempotent(spark, kind):
    rows = spark.createDataFrame([(a,) for a, _ in CASES[kind]], "a string")
    f = getattr(N, kind)
    bad = rows.select(f(F.col("a")).alias("x")).where("x not in ('MacY', 'MacArthur', 'McDonald')").where(f(F.col("x")) != F.col("x"))
    assert bad.collect() == []


def test_phone_of_other_regions(spark):
    rows = spark.createDataFrame([("GB", "020 7946 0958", "+442079460958"), ("GB", "0044 20 7946 0958", "+442079460958"), ("GB", "123", ""), ("IN", "098765 43210", "+919876543210"), ("DE", "+1 (555) 123-4567", "+15551234567")], "r string, a string, b string")
    for r in ("GB", "IN", "DE"):
        assert [(x.a, x.b) for x in rows.where(F.col("r") == r).select("a", "b", N.phone_in(r)(F.col("a")).alias("x")).where("x <> b").collect()] == []
