"""Person records derived from the test tables: the shared input recipe of queries and their SQL.

PERSON is plain SQL for both engines, a flat relation of raw values; nothing in it normalises,
matches or merges. `records` turns it into the nested record schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import extract as X
from kinfold.session import table
from kinfold.sources.records import LINKS, PLACE

PERSON = """
SELECT c_custkey AS rec_idx, c_custkey AS grp, 'recruiter_csv' AS source, 6 AS priority, 'customer' AS source_file, upper(c_name) AS full_name,
  concat('  Cust', c_custkey, '@Example.COM ') AS email_raw, concat('(555) ', lpad(concat(c_custkey - c_custkey % 2), 7, '0')) AS phone_raw,
  concat('') AS linkedin_raw, concat('') AS portfolio_raw, CASE WHEN c_custkey % 4 = 0 THEN ' ' ELSE concat(' ', c_mktsegment, ' buyer') END AS headline,
  CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 30 AS DOUBLE) END AS years, concat('') AS skill_raw,
  CASE WHEN c_custkey % 5 = 0 THEN '' ELSE concat('City ', c_nationkey) END AS city, CASE c_nationkey % 4 WHEN 0 THEN 'usa' WHEN 1 THEN 'U.K.' WHEN 2 THEN 'fra' ELSE 'Nowhere' END AS country,
  concat('') AS company, concat('') AS title, concat('') AS start_raw, concat('') AS end_raw, concat('') AS school, concat('') AS degree, concat('') AS end_year
FROM customer
UNION ALL
SELECT 1000000000 + o_orderkey, o_custkey, 'ats_json', 5, 'orders', '', concat('cust', o_custkey, '@example.com'), '',
  CASE WHEN o_custkey % 8 <> 7 THEN concat('HTTP://LinkedIn.com/in/P', (o_custkey + 1) - (o_custkey + 1) % 2, '/#top') ELSE '' END, '',
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '' END, CASE WHEN o_orderkey % 7 = 0 THEN CAST(o_orderkey % 40 AS DOUBLE) END, '', concat('Town ', o_custkey % 9), 'Germany',
  concat('Company ', o_orderkey % 5), CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat(' Role ', o_orderkey % 2) END,
  CASE o_orderkey % 3 WHEN 0 THEN concat(extract(year FROM o_orderdate), '-', lpad(concat(extract(month FROM o_orderdate)), 2, '0'), '-05')
    WHEN 1 THEN concat(extract(month FROM o_orderdate), '/', extract(year FROM o_orderdate))
    ELSE concat(CASE extract(month FROM o_orderdate) WHEN 1 THEN 'Jan' WHEN 2 THEN 'Feb' WHEN 3 THEN 'March' WHEN 4 THEN 'Apr' WHEN 5 THEN 'May' WHEN 6 THEN 'June' WHEN 7 THEN 'Jul' WHEN 8 THEN 'Aug' WHEN 9 THEN 'Sept' WHEN 10 THEN 'Oct' WHEN 11 THEN 'Nov' ELSE 'December' END, ' ', extract(year FROM o_orderdate)) END,
  CASE WHEN o_orderkey % 11 = 0 THEN 'Present' WHEN o_orderkey % 13 = 0 THEN '' ELSE concat(extract(year FROM o_orderdate) + o_orderkey % 3, '-', lpad(concat(extract(month FROM o_orderdate)), 2, '0')) END,
  concat('School ', o_custkey % 7), o_orderstatus, concat(extract(year FROM o_orderdate))
FROM orders
UNION ALL
SELECT 2000000000 + event_id, user_id, 'github', 2, 'events', '', concat('cust', user_id, '@example.com'), '', '', concat('blog.example.org/', user_id % 5), '', NULL,
  CASE event_type WHEN 'view' THEN 'JS' WHEN 'click' THEN 'data analysis' WHEN 'error' THEN 'golang' ELSE event_type END, '', '', '', '', '', '', '', '', ''
FROM events
UNION ALL
SELECT 3000000000 + s_suppkey, s_suppkey * 3, 'linkedin', 3, 'supplier', concat('customer#', lpad(concat(s_suppkey * 3), 9, '0')),
  CASE WHEN s_suppkey % 2 = 1 THEN concat('supp', s_suppkey, '@other.org') ELSE '' END, '', '', concat('http://Site.example.org/', s_suppkey, '/'), 'Supplier', NULL, 'k8s', 'Harbour', 'United Kingdom', '', '', '', '', '', '', ''
FROM supplier
"""

TABLES = ("customer", "orders", "events", "supplier")


def person(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat relation. Views have names of their own per call, so sessions can be shared."""
    return spark.sql(
        PERSON.replace("FROM customer", "FROM {customer}").replace("FROM orders", "FROM {orders}").replace("FROM events", "FROM {events}").replace("FROM supplier", "FROM {supplier}"),
        **{t: table(spark, sf_dir, t) for t in TABLES},
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records; cluster_id is the recipe's own grouping, for operators that take clusters as given."""
    some = lambda c: F.filter(F.array(c), lambda x: x != "")
    job = F.struct("company", "title", F.col("start_raw").alias("start"), F.col("end_raw").alias("end"), F.lit("").alias("summary"))
    study = F.struct(F.col("school").alias("institution"), "degree", F.lit("").alias("field"), "end_year")
    place = F.struct("city", F.lit("").alias("region"), "country").cast(PLACE)
    links = F.struct(F.col("linkedin_raw").alias("linkedin"), F.lit("").alias("github"), F.col("portfolio_raw").alias("portfolio"), F.array().cast("array<string>").alias("other")).cast(LINKS)
    return person(spark, sf_dir).select(
        "rec_idx", F.col("grp").alias("cluster_id"), "source", "priority", "source_file", F.array("rec_idx").alias("at"), "full_name", some("email_raw").alias("emails"), some("phone_raw").alias("phones"),
        place.alias("location"), links.alias("links"), "headline", F.col("years").alias("years_experience"), F.lit("").alias("current_company"), some("skill_raw").alias("skills"),
        F.when(F.col("company") != "", F.array(job)).otherwise(F.array()).cast(X.EXPERIENCE).alias("experience"), F.when(F.col("school") != "", F.array(study)).otherwise(F.array()).cast(X.EDUCATION).alias("education"),
    )
